"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

Items are partitioned by their number of shingles, each class spanning a factor of two. An item's sketch is its
smallest shingle hashes; the class fixes how many: one more than the largest item of the class may lack at the
threshold. So a document that contains enough of an item has one of the sketch's hashes whatever its own length,
and the search loses nothing. Documents' shingle hashes are probed against the sketches; the pairs found are
verified on the shingles themselves. DataFrame functions only. What is broadcast the planner chooses by measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, same_row, text_hash, unpacked

SHINGLE, THRESHOLD = 5, 0.8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(w: str, make) -> Column:
    """One value for each run of SHINGLE words of the array column w; none for fewer words."""
    at = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(0), F.size(w) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: make([F.get(F.col(w), i + k) for k in range(SHINGLE)]))


def hashes(w: str) -> Column:
    return _shingles(w, lambda parts: F.xxhash64(*parts))


def strings(w: str) -> Column:
    return _shingles(w, lambda parts: F.concat_ws(" ", *parts))


def may_lack(n: Column, threshold: float) -> Column:
    """How many of n shingles may be missing at the threshold."""
    return n - F.ceil(n * threshold - 1e-9).cast("int")


def item_shingles(benchmark: DataFrame, make) -> DataFrame:
    """(item_id, s): the distinct shingles of each item; rows with one id are one item."""
    rows = benchmark.select("item_id", "text").distinct().select("item_id", words(F.col("text")).alias("w"))
    return rows.select("item_id", F.explode(make("w")).alias("s")).distinct()


def sketches(benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, n, needed, hash): the size class's number of smallest hashes of each item."""
    own = cut(item_shingles(benchmark, hashes))
    sizes = own.groupBy(F.col("item_id").alias("i")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    widest = (F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1).cast("int")
    keep = F.least(F.col("n"), may_lack(widest, threshold) + 1)
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("s")))
    rows = ranked.join(sizes, F.col("item_id").eqNullSafe(F.col("i"))).where(F.col("rank") <= keep)
    return rows.select("item_id", "n", F.greatest(keep - may_lack(F.col("n"), threshold), F.lit(1)).alias("needed"), F.col("s").alias("hash"))


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, item_id, n_shingles, n_shared): the items of which a document holds enough.

    Words are runs of letters and digits, lower-cased; shingles are counted once. A text or item of fewer than five
    words has no shingle and matches nothing, so null and empty texts don't either. Rows that repeat id and text give
    one row an item; null ids are ids; rows of the benchmark with one id are one item, that of all their shingles, so
    an item that is repeated counts once. Other columns are ignored; empty tables give no rows.
    """
    docs = documents.select("doc_id", text_hash().alias("text_hash"), "text")
    index = cut(sketches(benchmark, threshold))
    probes = docs.select("doc_id", "text_hash", words(F.col("text")).alias("w")).select("doc_id", "text_hash", F.explode(hashes("w")).alias("hash"))
    found = probes.join(index, "hash").groupBy("doc_id", "text_hash", "item_id", "needed").agg(F.countDistinct("hash").alias("hits"))
    pairs = cut(found.where("hits >= needed").select("doc_id", "text_hash", "item_id"))
    items = cut(item_shingles(benchmark, strings).withColumnRenamed("item_id", "i_id"))
    sizes = items.groupBy(F.col("i_id").alias("n_id")).agg(F.count(F.lit(1)).cast("int").alias("n_shingles"))
    wanted = pairs.join(items, F.col("item_id").eqNullSafe(F.col("i_id"))).select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), "item_id", F.col("s").alias("w_shingle"))
    keys = pairs.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct()
    texts = docs.join(keys, same_row("k_id", "k_hash"), "left_semi")
    have = texts.select("doc_id", "text_hash", words(F.col("text")).alias("w")).select("doc_id", "text_hash", F.explode(strings("w")).alias("shingle")).distinct()
    shared = have.join(wanted, same_row("w_id", "w_hash") & (F.col("shingle") == F.col("w_shingle")))
    out = shared.groupBy("doc_id", "text_hash", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    out = out.join(sizes, F.col("item_id").eqNullSafe(F.col("n_id"))).select("doc_id", "text_hash", "item_id", "n_shingles", "n_shared")
    return out.where(F.col("n_shared") >= F.col("n_shingles") - may_lack(F.col("n_shingles"), threshold))


def decontaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that hold no item, as they are.

    Null, empty and short texts hold none and stay; of rows that repeat id and text all stay or go; ids may repeat or
    be null; further columns are kept, whatever their names; empty tables give no rows.
    """
    gone = cut(contaminated(documents, benchmark, threshold).select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")).distinct())
    return unpacked(packed(documents).join(gone, same_row("g_id", "g_hash"), "left_anti"), documents.columns)


def op8_decontamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The items that each document holds, with shingle counts and containment; hard inputs are treated as by contaminated."""
    found = contaminated(documents, benchmark)
    return found.select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_shared", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"))


SQL = r"""
WITH d AS (SELECT doc_id, text, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w != '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w != '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, text, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' '))) AS s FROM d),
s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' '))) AS s FROM i),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id)
SELECT ds.doc_id, s.item_id, any_value(n.n) AS n_shingles, count(*) AS n_shared, round(count(*) / any_value(n.n), 6) AS containment
FROM ds JOIN s USING (s) JOIN n ON s.item_id IS NOT DISTINCT FROM n.item_id
GROUP BY ds.doc_id, ds.text, s.item_id HAVING count(*) >= ceil(any_value(n.n) * 0.8 - 1e-9)
"""
