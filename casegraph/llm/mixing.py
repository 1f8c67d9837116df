"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies x of each of its documents; the whole copies are taken and
what remains is a probability. Two documents with fractions trade mass, words for words, until one fraction is 0 or
1; which way is drawn so that each keeps its expectation. So the source's words are kept by every trade and all but
one document end integral. Documents are dealt to buckets by a hash; each bucket trades within its sources and
leaves one residual a source, and residuals of FAN buckets meet in the next level of a tree until one is left, which
a coin decides: a source ends within one document of its target. Draws are hashes of the traders' keys, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, text_hash

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, 42
#: Documents in a bucket (about), and buckets whose residuals meet.
BUCKET, FAN = 50_000, 64
TINY = 1e-9


def words(col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    Sharing a budget by weight and sharing the excess over the caps again ends where every source has the lesser of its
    cap and its weight times one common level. Each round takes the sources that the last level brings to their caps out
    of the budget and shares the rest; it is one aggregate over the sources, which are ranked in ranges, so that there
    may be any number of them.
    """
    ranked = numbered(sizes.withColumn("lost", F.col("source").isNull()), ["lost", "source"], "rank")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    rows = cut(ranked.select("source", "source_size", w.alias("w"), (most * F.col("source_size")).alias("cap")))
    whole = rows.agg(F.sum("source_size").alias("n"), F.sum("w").alias("w")).first()
    budget, level, capped = share * (whole["n"] or 0), 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("w") if capped >= 0 else F.lit(False)
        now = rows.agg(F.sum(F.when(full, F.col("cap"))).alias("spent"), F.sum(F.when(~full, F.col("w"))).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if now["n"] == capped or not now["open"]:
            level = float("inf") if not now["open"] else level
            break
        level, capped = (budget - (now["spent"] or 0.0)) / now["open"], now["n"]
    aim = F.col("cap") if level == float("inf") else F.least("cap", F.lit(level) * F.col("w"))
    return rows.select("source", "source_size", aim.alias("target"))


def _draw(a: int, b: int, seed: int) -> float:
    return (xxhash.xxh64_intdigest(f"{seed}:{a}:{b}", seed) >> 11) / 2.0**53


def trade(size: list[int], x: list[float], key: list[int], seed: int) -> tuple[list[int], int]:
    """The whole numbers that fractions x end in, and the index of the one that stays fractional (else -1).

    Words are kept: what i gains, j loses. x of the residual is changed in place.
    """
    out = [0] * len(x)
    held = -1
    for j in range(len(x)):
        if x[j] <= TINY or x[j] >= 1 - TINY:
            out[j] = int(x[j] > 0.5)
            continue
        if held < 0:
            held = j
            continue
        i = held
        up = min((1 - x[i]) * size[i], x[j] * size[j])  # words that may move from j to i
        down = min(x[i] * size[i], (1 - x[j]) * size[j])
        moved = up if _draw(key[i], key[j], seed) * (up + down) < down else -down
        x[i] += moved / size[i]
        x[j] -= moved / size[j]
        held = -1
        for k in (i, j):
            if x[k] <= TINY or x[k] >= 1 - TINY:
                out[k] = int(x[k] > 0.5)
            else:
                held = k
    return out, held


_COLS = "doc_id long, key long, source string, size long, copies long, x double, bucket long"


def _round(seed: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "doc_id", "size"], kind="stable").reset_index(drop=True)
        group["done"] = True
        for _, rows in group.groupby("source", dropna=False, sort=False):
            at = rows.index.to_numpy()
            x = rows["x"].tolist()
            got, held = trade(rows["size"].tolist(), x, rows["key"].tolist(), seed)
            if held >= 0 and last:
                got[held], held = int(_draw(rows["key"].iloc[held], -1, seed) < x[held]), -1
            group.loc[at, "copies"] += np.array(got)
            group.loc[at, "x"] = 0.0
            if held >= 0:
                group.loc[at[held], "x"] = x[held]
                group.loc[at[held], "done"] = False
        return group

    return run


def _round_arrow(seed: int, last: bool):
    run = _round(seed, last)

    def arrow(t: pa.Table) -> pa.Table:
        types = {pa.int64(): pd.Int64Dtype()}
        return pa.Table.from_pandas(run(t.to_pandas(types_mapper=types.get)), t.schema.append(pa.field("done", pa.bool_())), preserve_index=False)

    return arrow


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and taken of every row of documents.

    Null texts have size 0; empty documents are never copied. Null is a source, the last. Ids may repeat or be null;
    other columns are ignored; an empty table gives no rows.
    """
    docs = cut(documents.select("doc_id", F.xxhash64(F.coalesce("doc_id", F.lit(0)), text_hash(), F.lit(seed)).alias("key"), "source", words().alias("size")))
    sizes = cut(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    aims = cut(targets(sizes.drop("n"), weights, share, most).withColumnRenamed("source", "s"))
    x = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(x + TINY)
    buckets = max(1, -(-n // BUCKET))
    rows = docs.join(aims, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "key", "source", "size", whole.cast("long").alias("copies"), F.greatest(x - whole, F.lit(0.0)).alias("x"), F.pmod("key", F.lit(buckets)).alias("bucket"))
    done = None
    while True:
        last = buckets == 1
        level = cut(rows.groupBy("bucket").applyInArrow(_round_arrow(seed, last), f"{_COLS}, done boolean"))
        settled = level.where("done")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        rows = level.where("NOT done").drop("done").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
        buckets = -(-buckets // FAN)
    return done.join(aims, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op3_mixing(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of documents; hard inputs are treated as by mix."""
    return mix(documents).select("doc_id", "size", "source_size", "target", "taken")
