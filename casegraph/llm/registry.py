"""Queries of the corpus operators, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, embeddings, licenses, linedup, mixing, pii, quality, simhash, suffixes, warc
from .common import table


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": lambda s, d: pii.op1_pii(table(s, d, "documents")),
    "op2_simhash": lambda s, d: simhash.op2_simhash(table(s, d, "documents")),
    "op3_mixing": lambda s, d: mixing.op3_mixing(table(s, d, "documents")),
    "op4_suffix_dedup": lambda s, d: suffixes.op4_suffix_dedup(table(s, d, "documents")),
    "op5_embedding_dedup": lambda s, d: embeddings.op5_embedding_dedup(table(s, d, "embeddings")),
    "op6_license_scan": lambda s, d: licenses.op6_license_scan(table(s, d, "documents")),
    "op7_quality": lambda s, d: quality.quality_scores(table(s, d, "documents"), table(s, d, "labels")),
    "op8_decontamination": lambda s, d: decontam.op8_decontamination(table(s, d, "documents"), table(s, d, "benchmark")),
    "op9_line_dedup": lambda s, d: linedup.op9_line_dedup(table(s, d, "documents")),
    "op10_warc_revisits": lambda s, d: warc.op10_warc_revisits(table(s, d, "pages")),
    "pipeline": _pipeline,
}
ORACLES: dict[str, str] = {
    "op6_license_scan": licenses.SQL,
    "op8_decontamination": decontam.SQL,
    "op10_warc_revisits": warc.SQL,
}
