"""The corpus pipeline: quality, line dedup, near-duplicates, benchmark decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casegraph.llm import decontam, linedup, mixing, nearcopies, quality
from casegraph.llm.common import cut, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more stay as they are.

    Null and empty texts score the labels' own share; equal texts fare alike; ids may repeat or be null; further columns stay,
    whatever their names; an empty table gives an empty one.
    """
    return quality.quality_survivors(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned blocks of lines that an earlier document holds go from the later one's text; every document stays.

    Null and empty texts stay as they are, rows that repeat id and text are one document, ids may repeat or be null; further
    columns stay, whatever their names; an empty table gives an empty one.
    """
    return linedup.line_deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by Jaccard similarities of 0.8 or more of their five-word shingles the one with the smallest id stays.
    Candidates are fingerprints within 3 bits, by op2's grid range-join, and MinHash bands for the pairs these lose.

    Texts without a word, null ones too, are one group; rows that repeat id and text leave one; null ids come last and tell
    nothing apart; further columns stay, whatever their names; an empty table gives an empty one.
    """
    return nearcopies.near_survivors(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of an item's five-word shingles go, the others stay as they are.

    Null, empty and short texts hold nothing; items that repeat count once; ids may repeat or be null; further columns stay,
    whatever their names; an empty table or benchmark drops nothing.
    """
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken: doc_id, size, source, source_size, target, copies and taken of every row.

    Null texts have size 0 and are never copied; null is a source, the last; ids may repeat or be null; other columns are
    ignored; an empty table gives no rows.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: Neither compression, patience diff nor rounding by drawn lots can be said in SQL: the stages are tested apart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
