"""Near-duplicates by the Jaccard similarity of word shingles.

Distinct shingle sets are nodes, so copies enter once. A node's MinHash signature is cut into BANDS bands of ROWS values;
nodes that share a band share a cell, and of cells with the same nodes one stays. Cells get the shingle sets themselves and
compare them exactly: an emitted link is always right, and a pair of similarity s is met but for a chance of
(1 - s ** ROWS) ** BANDS, 3e-6 at 0.8.

Candidates are also the nodes whose SimHash fingerprints of the same shingles are within 3 bits, by op2's embedding and grid
range-join; the exact check follows. Alone they would not do: at 0.8 sixty-four bits differ in ten places on average.

First every node is compared with one member of each of its cells, the one with most company, which links a group of
copies to its original whatever its size; it is a join, so no cell meets in one task. Cells whose nodes are in one
component by then are done. In the others components grow one by one: a node that is reached is compared once with
the nodes not reached yet, and what is emitted is a spanning forest, never all pairs; cells of more than HOT nodes are
split into parts, and each two parts meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, discard, text_hash
from .simhash import DISTANCE, SEED, STEP, bit_counts, grid_links, majority, survivors

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Shingles whose permuted hashes are made at once, and nodes of a cell above which it is split.
BLOCK, HOT = 4096, 512
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_FACTOR, _SHIFT = _MIX[0] * np.uint64(2) + np.uint64(1), _MIX[1]


def hashes(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the lower-cased words' shingles, repeats included; of fewer words all are one; none where there is no word."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    whole, n, size = b" ".join(words), max(1, len(words) - shingle + 1), min(shingle, len(words))
    at = [0, *accumulate(len(w) + 1 for w in words)]
    return np.fromiter((xxhash.xxh64_intdigest(whole[s : e - 1], SEED) for s, e in zip(at[:n], at[size:])), np.uint64, n)


def shingles(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(hashes(data, shingle))


def simhash(h: np.ndarray) -> int:
    """The fingerprint of shingles' hashes, as simhash.fingerprint makes it; 0 where there is none."""
    return majority(sum(bit_counts(h[lo : lo + STEP]) for lo in range(0, len(h), STEP)), len(h)) if len(h) else 0


def cells(s: np.ndarray) -> np.ndarray:
    """A hash for each band of the signature of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for lo in range(0, len(s), BLOCK):
        x = s[None, lo : lo + BLOCK] * _FACTOR + _SHIFT
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1))
    rows = np.ascontiguousarray(least.reshape(BANDS, ROWS))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64)


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


def _bytes(column: pa.Array) -> Iterator[bytes]:
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.cast(pa.large_binary()))


def _sketched(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row's node, its fingerprint and, for a set that is not empty, its cells."""
        for b in batches:
            nodes, fps, found = [], [], []
            for x in _bytes(b.column(2)):
                h = hashes(x, shingle)
                s = np.unique(h)
                nodes.append(_node(s))
                fps.append(simhash(h))
                found.append(cells(s).view("<i8") if len(s) else np.empty(0, "<i8"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(nodes, "<u8").view("<i8")), pa.array(np.array(fps, "<u8").view("<i8")), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_hash", "node", "fp", "cells"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingles(x, shingle) for x in _bytes(b.column(0))]
            nodes = np.array([_node(s) for s in made], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.tobytes() for s in made], pa.binary())], ["node", "s"])

    return run


def links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest, as positions, of the pairs whose Jaccard similarity is at least that."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order])
    flat = np.concatenate([sets[i] for i in order])
    start = np.r_[0, np.cumsum(size)]
    left, out = np.arange(len(sets)), []  # places in order, so by size
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            own, n = sets[order[x]], size[x]
            near = left[(size[left] >= similarity * n - 1e-9) & (similarity * size[left] <= n + 1e-9)]
            hit = []
            for lo in range(0, len(near), 256):
                some = near[lo : lo + 256]
                rows = np.concatenate([flat[start[y] : start[y + 1]] for y in some])
                at = np.minimum(np.searchsorted(own, rows), n - 1)
                shared = np.add.reduceat((own[at] == rows).astype(np.int64), np.r_[0, np.cumsum(size[some])[:-1]])
                hit += some[shared >= similarity * (n + size[some] - shared) - 1e-9].tolist()
            out += [(order[x], order[y]) for y in hit]
            left = np.setdiff1d(left, hit, assume_unique=True)
            todo += hit
    return out


def _cell_links(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; what is held is the last, unfinished cell."""
        cell, nodes, held = None, [], []

        def found() -> pa.RecordBatch:
            pairs = links([np.frombuffer(x, "<u8") for x in held], similarity) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.int64()), pa.array([nodes[j] for _, j in pairs], pa.int64())], ["a", "b"])

        for b in batches:
            for c, node, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if c != cell:
                    if len(held) > 1:
                        yield found()
                    cell, nodes, held = c, [], []
                nodes.append(node)
                held.append(s)
        if len(held) > 1:
            yield found()

    return run


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of pairs of nodes (a, b, their sets) those that are similar."""
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int((large[at] == small).sum())
                if shared >= similarity * (len(x) + len(y) - shared) - 1e-9:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def sketches(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, node, fp, cells), one row for each row."""
    texts = documents.select("doc_id", text_hash().alias("text_hash"), "text")
    return texts.mapInArrow(_sketched(shingle), "doc_id long, text_hash long, node long, fp long, cells array<long>")


def simhash_pairs(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) nodes of sketches that are linked by fingerprints within the distance: of one fingerprint all nodes with the
    smallest, and the smallest ones of fingerprints that op2's grid links. Empty texts are left out."""
    held = cut(docs.where(F.size("cells") > 0).select("fp", "node").distinct())
    first = cut(held.groupBy("fp").agg(F.min("node").alias("first")))
    found = cut(grid_links(first, distance))
    of = lambda fp, node: first.select(F.col("fp").alias(fp), F.col("first").alias(node))
    same = held.join(first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    pairs = cut(found.select(F.col("a").alias("x"), F.col("b").alias("y")).join(of("x", "a"), "x").join(of("y", "b"), "y").select("a", "b").unionAll(same).where("a != b").distinct())
    discard(held, first, found)
    return pairs


def near_components(documents: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash and rep, one row for each row: rows with one rep are reachable over links of that similarity.

    Texts without a word, null ones too, are one component. Ids may repeat or be null; other columns are ignored; an
    empty table gives no rows.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("the bands are chosen for similarities of 0.8 or more")
    texts = documents.select("doc_id", text_hash().alias("text_hash"), "text")
    docs = cut(sketches(documents, shingle))
    close = simhash_pairs(docs)
    nodes = docs.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("cells").alias("cells"))
    every = cut(nodes.select("node", "text_hash", F.explode("cells").alias("cell")))
    shared = every.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    chosen = cut(shared.groupBy("n", "x", "y").agg(F.min("cell").alias("cell")).select("cell", "n"))
    member = cut(every.join(chosen, "cell").select("cell", "n", "node", "text_hash"))
    ends = close.select(F.col("a").alias("node")).unionAll(close.select("b"))
    used = cut(member.select("text_hash").unionAll(nodes.join(ends, "node", "left_semi").select("text_hash")).distinct())
    made = texts.join(used, "text_hash", "left_semi").select("text").mapInArrow(_sets(shingle), "node long, s binary")
    sets = cut(made.groupBy("node").agg(F.first("s").alias("s")))
    # the node with most company speaks for its cell
    company = member.groupBy("node").agg(F.sum("n").alias("company"))
    ranked = member.join(company, "node").select("cell", "node", "company")
    heads = ranked.groupBy("cell").agg(F.max(F.struct("company", "node")).alias("m")).select("cell", F.col("m.node").alias("head"))
    headed = member.join(heads, "cell").where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    pairs = cut(headed.unionAll(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("s_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("s").alias("s_b")), "b").select("a", "b", "s_a", "s_b")
    star = cut(both.mapInArrow(_alike(similarity), "a long, b long"))
    first = cut(connected_components(star))
    # cells that still hold several components
    held = member.join(first, "node", "left").select("cell", "n", "node", F.coalesce("rep", "node").alias("rep"))
    open_ = held.groupBy("cell").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low != high").select("cell")
    rows = cut(held.join(open_, "cell").select("cell", "n", "node"))
    parts = F.ceil(F.col("n") / HOT).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("n") / HOT)).cast("int")
    rows = rows.select("cell", "node", parts.alias("parts"), own.alias("own"))
    other = rows.select("cell", "node", "own", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    part = F.when(F.col("parts") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")))
    met = other.select(part.alias("cell"), "node").join(sets, "node").select("cell", "node", "s")
    more = cut(met.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links(similarity), "a long, b long"))
    reps = cut(connected_components(star.unionByName(more)))
    discard(close, every, chosen, member, used, sets, pairs, star, first, more)
    return docs.select("doc_id", "text_hash", "node").join(reps.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("doc_id", "text_hash", F.coalesce("rep", "node").alias("rep"))


def near_survivors(documents: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of documents without near copies of an earlier one: see survivors.

    Texts without a word, null ones too, are one component; ids may repeat or be null; further columns are kept, whatever
    their names; an empty table gives no rows.
    """
    return survivors(documents, near_components(documents, shingle, similarity))
