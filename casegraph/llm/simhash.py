"""SimHash near-duplicates by segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is embedded as 32 bit counts, one for each two-bit segment. The Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints. A pair within 3 has a half (16 segments) whose
embeddings are within 1: the grid's cells are the embedded halves, each fingerprint is stored in two cells and
probes the neighbours one step up, so that of such a pair one finds the other. The embedding is kept as a
thermometer code (0 -> 00, 1 -> 01, 2 -> 11), which makes the Manhattan distance a popcount of an exclusive or.

Copies share a fingerprint and enter the grid once. A cell holds distinct fingerprints whose half has one embedding,
so no number of copies fills it, and what it emits is a spanning forest of its links, never all pairs. A cell with more
than HOT fingerprints is split by salts: each part stores its share and is probed by the others' and by all probes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, discard, packed, same_row, text_hash, unpacked

DISTANCE, SHINGLE, SEED = 3, 3, 42
_EVEN = np.uint64(0x5555555555555555)
#: Fingerprints compared at once in a cell, and those above which a cell is split.
BLOCK, HOT = 2048, 50_000
#: Hashes whose bits are counted at once.
STEP = 255 * 64


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of at most STEP hashes have each bit."""
    bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
    return np.add.reduceat(bits, np.arange(0, len(h), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that over half of n hashes have."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased words' shingles; 0 where there is no word."""
    words = data.lower().split()  # bytes: A-Z only, and white space is \\x20 and \\x09 to \\x0d
    if not words:
        return 0
    whole, n = b" ".join(words), max(1, len(words) - shingle + 1)
    at = [0, *accumulate(len(w) + 1 for w in words)]
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, STEP):
        hi = min(n, lo + STEP)
        counts += bit_counts(np.array([digest(whole[s : e - 1], SEED) for s, e in zip(at[lo:hi], at[lo + size : hi + size])], "<u8"))
    return majority(counts, n)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column(2).cast(pa.large_binary())], "<u8")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made.view("<i8"))], ["doc_id", "text_hash", "fp"])


def embed(x: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, as thermometer codes."""
    high, low = (x >> np.uint64(1)) & _EVEN, x & _EVEN
    return (high | low) | ((high & low) << np.uint64(1))


def _grid(probes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two stored rows for each fingerprint and, if wanted, a probe for each cell one step up in a half."""
        for b in batches:
            fp = b.column(0).to_numpy().astype("<i8").view("<u8")
            code = embed(fp)
            for half in (0, 1):
                cell = (code >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                mark = np.uint64(half << 32)
                cells, kinds, whose = [cell | mark], [np.zeros(len(fp), np.int8)], [fp]
                for i in range(16 * probes):
                    field = (cell >> np.uint64(2 * i)) & np.uint64(3)
                    up = field < 3
                    cells.append((cell[up] | ((field[up] + np.uint64(1)) << np.uint64(2 * i))) | mark)
                    kinds.append(np.ones(up.sum(), np.int8))
                    whose.append(fp[up])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).view("<i8")), pa.array(np.concatenate(kinds)), pa.array(np.concatenate(whose).view("<i8"))], ["cell", "kind", "fp"])

    return run


_cells, _stored = _grid(True), _grid(False)


def cell_rows(nodes: DataFrame) -> DataFrame:
    """(cell, kind, fp): the stored (0) and probing (1) fingerprints of each cell or part of one."""
    schema = "cell long, kind byte, fp long"
    sizes = nodes.select("fp").mapInArrow(_stored, schema).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    hot = cut(sizes.select(F.col("cell").alias("hot"), F.ceil(F.col("n") / HOT).cast("int").alias("parts")))
    rows = nodes.select("fp").mapInArrow(_cells, schema)
    if hot.isEmpty():
        return rows
    both = rows.join(hot, F.col("cell") == F.col("hot"), "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # a stored one probes the parts that follow its own, so that two of one cell meet once
    least = F.when(F.col("kind") == 0, F.col("own")).otherwise(0)
    parts = F.when(F.col("hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(least, F.col("parts") - 1))
    both = both.select("*", F.explode(parts).alias("part"))
    kind = F.when((F.col("kind") == 0) & (F.col("hot").isNull() | (F.col("part") == F.col("own"))), 0).otherwise(1).cast("byte")
    return both.select(F.when(F.col("hot").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", "part")).alias("cell"), kind.alias("kind"), "fp")


class Forest:
    """Union-find that reports the unions that joined something."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while up.get(x, x) != r:
            up[x], x = r, up[x]
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(stored: np.ndarray, probes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a cell's fingerprints and those that probe it."""
    everyone, forest, out = np.concatenate([stored, probes]), Forest(), []
    code = embed(everyone)
    for lo in range(0, len(stored), BLOCK):
        for at in range(lo, len(everyone), BLOCK):
            a, b = slice(lo, min(lo + BLOCK, len(stored))), slice(at, at + BLOCK)
            near = np.bitwise_count(code[a, None] ^ code[None, b]) <= distance  # the lower bound
            i, j = np.nonzero(near)
            i, j = i + lo, j + at
            i, j = i[i < j], j[i < j]
            exact = np.bitwise_count(everyone[i] ^ everyone[j]) <= distance
            out += [(int(everyone[x]), int(everyone[y])) for x, y in zip(i[exact].tolist(), j[exact].tolist()) if forest.join(x, y)]
    return out


def _cell_links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell and kind; what is held is the last, unfinished cell."""
        held: list[np.ndarray] = []

        def found(cell: np.ndarray, kind: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            edges = []
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            ends = np.r_[starts[1:], len(cell)]
            for s, e in zip(starts[(ends - starts > 1) & (kind[starts] == 0)].tolist(), ends[(ends - starts > 1) & (kind[starts] == 0)].tolist()):
                own = s + int(np.searchsorted(kind[s:e], 1))
                edges += _links(fp[s:own], fp[own:e], distance)
            pairs = np.array(edges, "<u8").reshape(-1, 2).view("<i8")
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().astype("<i8").view("<u8")]
            if held and held[0][0][0] == cols[0][-1]:
                held.append(tuple(cols))
                continue
            if held:
                cols = [np.concatenate([h[i] for h in held] + [cols[i]]) for i in range(3)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield found(*(c[:last] for c in cols))
            held = [tuple(c[last:] for c in cols)]
        if held:
            yield found(*(np.concatenate([h[i] for h in held]) for i in range(3)))

    return run


def grid_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links within the distance among distinct fingerprints (fp), a spanning forest of each cell's."""
    return cell_rows(nodes).repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(_cell_links(distance), "a long, b long")


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): one row for each row of documents; a null text counts as empty."""
    return documents.select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def simhash_components(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, text_hash, fp, component_id (the smallest doc_id reachable over links) and rep (the component's smallest
    fingerprint, which tells components apart where ids are null or repeat), one row for each row.

    Null and empty texts have fingerprint 0 and are linked like others; ids may repeat or be null (null only where
    no id of the component is known); columns besides doc_id and text are ignored; an empty table gives no rows.
    """
    if not 0 <= distance <= 3:
        raise ValueError("one of two halves is within 1 only up to distance 3")
    docs = cut(fingerprints(documents))
    nodes = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    reps = connected_components(grid_links(nodes, distance))
    linked = cut(nodes.join(reps, nodes.fp == reps.node, "left").select("fp", "first", F.coalesce("rep", "fp").alias("rep")))
    least = cut(linked.groupBy("rep").agg(F.min("first").alias("component_id")))
    named = cut(linked.join(least, "rep").select("fp", "component_id", "rep"))
    discard(nodes, linked, least)
    return docs.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "rep")


def survivors(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of documents that stay, by found (doc_id, text_hash, rep): of each component, which rep tells, the row with
    the smallest id (null last); of rows that repeat it, id and text, one."""
    found = cut(found.select("doc_id", "text_hash", "rep"))
    keep = found.groupBy("rep").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias("k_id"), F.col("k.text_hash").alias("k_hash"))
    repeats = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    told = cut(repeats.join(keep, same_row("k_id", "k_hash"), "left").select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"), "n", F.col("k_hash").isNotNull().alias("kept")))
    rows = packed(documents)
    gone = told.where("NOT kept OR n > 1")
    stay = rows.join(gone, same_row("g_id", "g_hash"), "left_anti").select("row")
    doubled = cut(told.where("kept AND n > 1"))
    if not doubled.isEmpty():
        twice = rows.join(doubled, same_row("g_id", "g_hash"), "left_semi")
        stay = stay.unionByName(twice.groupBy("doc_id", "text_hash").agg(F.first("row").alias("row")).select("row"))
    return unpacked(stay, documents.columns)


def simhash_survivors(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of documents without near copies of an earlier one, by fingerprints within the distance.

    Null and empty texts are one component. Ids may repeat or be null: see survivors. Further columns are kept, whatever
    their names; an empty table gives no rows.
    """
    return survivors(documents, simhash_components(documents, distance))


def op2_simhash(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of documents; hard inputs: see simhash_components."""
    return simhash_components(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
