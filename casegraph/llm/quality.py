"""Quality by compression: zstandard dictionaries of good and of bad text, and a calibrated size difference.

A text is compressed block by block with either dictionary (a dictionary helps at a block's start only, so one long
frame would hide it); the normalised difference of the two sizes says which text it is more like, and a logistic fit
on labelled rows turns that into the chance of label 1. Fitting takes a bounded sample of rows: for each label at most
DICTIONARY rows with the smallest hashes build the dictionaries, at most as many others calibrate. A dictionary's whole
texts are cut into blocks and it is trained on the BLOCKS with the smallest hashes, from wherever in a text they are.
Scoring reads every whole text, once, and moves none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_hash, unpacked

#: Labelled rows of each label for the dictionaries, and as many for calibration; blocks that a dictionary is trained on.
DICTIONARY, BLOCKS = 1500, 8192
#: Bytes of a dictionary and of a block, and the compression level.
DICT_BYTES, BLOCK, LEVEL = 64 << 10, 2048, 3
#: Bytes that damp a short text's differences.
DAMP = 300


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows kept from learning. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def dictionary(parts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; with too few blocks to train on, their own last bytes."""
    try:
        return zstd.train_dictionary(size, parts, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"".join(parts)[-size:]


def _compressor(data: bytes) -> zstd.ZstdCompressor | None:
    if not data:
        return None
    made = zstd.ZstdCompressionDict(data)
    made.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(dict_data=made, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)


def features(text: str | None, good: zstd.ZstdCompressor | None, bad: zstd.ZstdCompressor | None) -> list[float] | None:
    """How much better the good dictionary compresses than the bad one, over the plain and over the compressed size
    (both damped for short texts), and the compressed over the plain size. None where there is no text."""
    data = (text or "").encode("utf-8", "replace")
    if not data or good is None or bad is None:
        return None
    a = b = 0
    for i in range(0, len(data), BLOCK):
        block = data[i : i + BLOCK]
        a += len(good.compress(block))
        b += len(bad.compress(block))
    return [(b - a) / (len(data) + DAMP), (b - a) / (a + b + DAMP / 5), a / len(data)]


@dataclass
class Model:
    """Both dictionaries and the logistic fit; weights and bias are for plain features."""

    good: bytes
    bad: bytes
    weights: list[float]
    bias: float
    #: The score's log odds where there is no text: the labels' own shares.
    empty: float

    def features(self, column: Column) -> Column:
        good, bad = self.good, self.bad

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            a, b = _compressor(good), _compressor(bad)
            for texts in batches:
                yield pd.Series([features(t, a, b) for t in texts], dtype=object)

        return run(column)

    def score(self, column: Column) -> Column:
        """The chance of label 1."""
        good, bad, weights, bias, empty = self.good, self.bad, self.weights, self.bias, self.empty

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            a, b = _compressor(good), _compressor(bad)
            for texts in batches:
                found = (features(t, a, b) for t in texts)
                odds = [empty if x is None else sum(w * v for w, v in zip(weights, x)) + bias for x in found]
                yield pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds], dtype="float64")

        return run(column)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[list[float], float]:
    """Weights and bias by Newton's method on standardised columns, slightly ridged so that separable samples stay finite."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge * len(x)] * x.shape[1] + [1e-9])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    plain = w[:-1] / scale
    return plain.tolist(), float(w[-1] - plain @ mean)


def train(documents: DataFrame, labels: DataFrame, rows: int = DICTIONARY) -> Model:
    """Learn from labelled rows that aren't held out. With one label or none the score is a smoothed share of label 1."""
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("y"))
    order = F.xxhash64("l_id", F.lit(7))
    picked = [marked.where(F.col("y") == y).dropDuplicates(["l_id"]).orderBy(order, "l_id").limit(2 * rows) for y in (0, 1)]
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    odds = float(np.log(prior / (1 - prior)))
    base = Model(b"", b"", [], odds, odds)
    if len(counts) < 2:
        return base
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most 4 x rows ids
    sample = documents.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("l_id")).where("text IS NOT NULL AND text != ''")
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2))
    data = F.encode("text", "utf-8")
    starts = F.sequence(F.lit(0), F.octet_length("text") - 1, F.lit(BLOCK))
    blocks = sample.where(part == 0).select("y", F.xxhash64("doc_id").alias("o"), text_hash().alias("h"), data.alias("d"), F.explode(starts).alias("i"))
    blocks = blocks.select("y", "o", "h", "i", F.substr("d", F.col("i") + 1, F.lit(BLOCK)).alias("b"))
    pick = F.xxhash64("o", "h", "i", F.lit(13))
    texts = {}
    for y in (0, 1):
        got = blocks.where(F.col("y") == y).orderBy(pick, "o", "h", "i").limit(BLOCKS).select("o", "h", "i", "b").collect()
        texts[y] = [bytes(r["b"]) for r in sorted(got, key=lambda r: (r["o"], r["h"], r["i"]))]
    least = min(sum(map(len, texts[y])) for y in (0, 1))
    if not least:
        return base
    size = int(min(DICT_BYTES, max(256, least // 4)))  # both dictionaries of one size
    model = Model(dictionary(texts[1], size), dictionary(texts[0], size), [], 0.0, odds)
    fit = sample.where(part == 1).select("y", model.features(F.col("text")).alias("x")).collect()
    x, y = np.array([r["x"] for r in fit]).reshape(len(fit), -1), np.array([r["y"] for r in fit], float)
    if len(set(y.tolist())) < 2:
        return base
    model.weights, bias = fit_logistic(x, y)
    # the sample holds as many bad rows as good ones where there are enough: back to the labels' own shares
    model.bias = bias + float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents.

    Null texts count as empty, and empty ones score the labels' own share; ids may repeat or be null; other columns are ignored; an empty table gives no rows.
    """
    score = train(documents, labels).score(F.col("text"))
    out = documents.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_survivors(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the classifier doesn't reject, as they are.

    Null and empty texts score the labels' own share and stay or go together; equal texts fare alike; ids may repeat or
    be null; further columns are kept, whatever their names; an empty table gives no rows.
    """
    score = train(documents, labels).score(F.col("text"))
    rows = documents.select(F.struct("*").alias("row"), score.alias("score"))
    return unpacked(rows.where("score >= 0.5"), documents.columns)
