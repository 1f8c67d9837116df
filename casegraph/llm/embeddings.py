"""Embedding near-duplicates through an inverted multi-index.

Two codebooks, one for each half of the vectors, form a product grid. A vector is stored in the cell of its nearest
codewords; as a query it visits cells by growing distance (a multi-sequence traversal: of the sums of two sorted
lists, those whose ranks' product exceeds the number wanted can't be among the smallest). How many it visits is
calibrated for the target recall on sample vectors and partners made for them at exactly the threshold; there is no
most, and where the calibration asks for every cell, every pair is compared. Every pair met is
verified by its cosine in double precision; a pair counts if either side meets the other.

Cells are gathered into blocks of about BLOCK stored vectors; a block larger than what a task holds is split by salts on
both sides, so a task holds its stored vectors (at most about SPLIT_BYTES) and streams its queries. Equal vectors enter
once with their number. A task counts links and emits a spanning forest, never the pairs. The codebooks come from at most
SAMPLE vectors and SAMPLE_BYTES bytes; the table of cell sizes is at most CODEWORDS squared. Vectors of different
width have no cosine: each width has an index of its own, and widths of at most FEW vectors are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, discard

THRESHOLD, RECALL = 0.95, 0.99
SAMPLE, CODEWORDS, PER_CELL, BLOCK = 20_000, 512, 200, 500
#: Bytes of the sample and of a task's stored vectors; vectors of a width that needs no index; numbers made at once.
SAMPLE_BYTES, SPLIT_BYTES, FEW, AT_ONCE = 64 << 20, 4 << 20, 1000, 1 << 22


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(batch: np.ndarray) -> np.ndarray:
    """Rows over their lengths, in double precision, padded to an even width of two at least."""
    x = np.asarray(batch, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflows nor vanishes when squared
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.pad(x, ((0, 0), (0, 2 - x.shape[1] if x.shape[1] < 2 else x.shape[1] % 2)))


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    """Lloyd's algorithm from distinct sample rows; an empty codeword keeps its place."""
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = _squared(x, c).argmin(1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class Index:
    a: np.ndarray
    b: np.ndarray
    visits: int = 1
    #: By cell: its block. By block: the salts it is split into.
    block: np.ndarray | None = None
    salts: np.ndarray | None = None

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = x.shape[1] // 2
        return _squared(x[:, :m], self.a), _squared(x[:, m:], self.b)

    def cells(self, x: np.ndarray) -> np.ndarray:
        da, db = self._halves(x)
        return da.argmin(1) * len(self.b) + db.argmin(1)

    def visits_for(self, q: np.ndarray, partners: np.ndarray, recall: float) -> int:
        """The least number of visits with which that share of the queries meets its partner; every cell meets all."""
        every, most, home = len(self.a) * len(self.b), 128, self.cells(partners)[:, None]
        while most < every:
            met = (self.nearest(q, most) == home).sum(0).cumsum()
            if met[-1] >= recall * len(q):
                return int(np.searchsorted(met, recall * len(q)) + 1)
            most *= 4
        if every == 1 or every > 512:
            return every
        met = (self.nearest(q, every - 1) == home).sum(0).cumsum()
        return int(min(every, np.searchsorted(met, recall * len(q)) + 1))

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row, by growing distance."""
        if n >= len(self.a) * len(self.b):
            return np.tile(np.arange(len(self.a) * len(self.b)), (len(x), 1))
        i = np.concatenate([np.full(min(n // (r + 1), len(self.b)), r) for r in range(min(n, len(self.a)))])
        j = np.concatenate([np.arange(min(n // (r + 1), len(self.b))) for r in range(min(n, len(self.a)))])
        step = max(1, AT_ONCE // len(i))
        return np.concatenate([self._nearest(x[s : s + step], n, i, j) for s in range(0, max(1, len(x)), step)])

    def _nearest(self, x: np.ndarray, n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        da, db = self._halves(x)
        oa, ob = np.argsort(da, 1, "stable")[:, :n], np.argsort(db, 1, "stable")[:, :n]
        sa, sb = np.take_along_axis(da, oa, 1), np.take_along_axis(db, ob, 1)
        order = np.argsort(sa[:, i] + sb[:, j], 1, "stable")[:, :n]
        return np.take_along_axis(oa, i[order], 1) * len(self.b) + np.take_along_axis(ob, j[order], 1)


def fit(sample: np.ndarray, n: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 7) -> Index:
    """Codebooks for n vectors, and the visits that meet a partner at the threshold with the wanted recall."""
    rng = np.random.default_rng(seed)
    x = unit(sample)
    k = int(min(CODEWORDS, max(1, round((n / PER_CELL) ** 0.5))))
    m = x.shape[1] // 2
    index = Index(_codebook(x[:, :m], k, rng), _codebook(x[:, m:], k, rng))
    q = x[rng.choice(len(x), min(len(x), 1000), replace=False)]
    away = rng.normal(size=q.shape)
    away -= (away * q).sum(1, keepdims=True) * q
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
    s = threshold * q + (1 - threshold**2) ** 0.5 * away
    index.visits = index.visits_for(q, s, recall)
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 2))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes, with their width; a batch may hold several widths."""
    for b in batches:
        values = b.column(2).flatten().to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
        at, made = np.r_[0, np.cumsum(sizes)], [b""] * b.num_rows
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            for i, r in zip(rows.tolist(), unit(np.stack([values[at[k] : at[k] + d] for k in rows]))):
                made[i] = r.tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(made, pa.binary())], ["node", "n", "width", "v"])


def _cells(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(index.cells(_matrix(b.column(0))), pa.int64())], ["cell"])

    return run


def _deal(index: Index):
    """A stored row for each vector in its block (for each query salt), and query rows for the blocks it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(2))
            own = index.block[index.cells(x)]
            seen = index.block[index.nearest(x, index.visits)]
            salt = (b.column(0).to_numpy().astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            rows: list[tuple[int, int, int, int]] = []  # row, task, kind, own block
            visits = [np.unique(r) for r in seen]
            for i, (home, to) in enumerate(zip(own.tolist(), visits)):
                s = int(index.salts[home])
                mine = int(salt[i] % np.uint64(s))
                rows += [(i, (home << 32) | (mine * s + q), 0, home) for q in range(s)]
                for t in to.tolist():
                    s = int(index.salts[t])
                    q = int(salt[i] % np.uint64(s))
                    rows += [(i, (t << 32) | (m * s + q), 1, home) for m in range(s)]
            at, task, kind, home = np.array(rows, np.int64).T
            take = pa.array(at)
            lists = pa.array([v.tolist() for v in visits], pa.list_(pa.int32()))
            seen_by = pa.concat_arrays([lists, pa.array([[]], pa.list_(pa.int32()))]).take(pa.array(np.where(kind == 0, at, len(visits))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(task), pa.array(kind.astype(np.int8)), b.column(0).take(take), b.column(1).take(take), pa.array(home.astype(np.int32)), seen_by, b.column(2).take(take)],
                ["task", "kind", "rep", "n", "home", "seen", "v"],
            )

    return run


class _Block:
    """One task's stored vectors, and the links that its queries find."""

    def __init__(self) -> None:
        self.rep, self.n, self.v = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        self.seen: list[set[int]] = []

    def store(self, rep: np.ndarray, n: np.ndarray, seen: list[list[int]], v: np.ndarray) -> None:
        self.rep, self.n = np.r_[self.rep, rep], np.r_[self.n, n]
        self.v = v if self.v is None else np.vstack([self.v, v])
        self.seen += map(set, seen)
        self.group = np.arange(len(self.rep))

    def query(self, rep: np.ndarray, n: np.ndarray, home: np.ndarray, v: np.ndarray, threshold: float, links: list, edges: list) -> None:
        if self.v is None:
            return
        step = max(1, AT_ONCE // len(self.rep))
        for s in range(0, len(rep), step):
            self._query(rep[s : s + step], n[s : s + step], home[s : s + step], v[s : s + step], threshold, links, edges)

    def _query(self, rep: np.ndarray, n: np.ndarray, home: np.ndarray, v: np.ndarray, threshold: float, links: list, edges: list) -> None:
        hit = (v @ self.v.T >= threshold) & (rep[:, None] != self.rep)
        q = np.flatnonzero(hit.any(1))
        if not len(q):
            return
        hit, rep, n, home = hit[q], rep[q], n[q], home[q]
        links += zip(rep.tolist(), (hit @ self.n).tolist())
        # a stored vector that doesn't visit the query's block hears of the link here
        for b in np.unique(home).tolist():
            deaf = np.array([b not in s for s in self.seen])
            heard = n[home == b] @ hit[home == b]
            links += [(int(self.rep[i]), int(heard[i])) for i in np.flatnonzero(deaf & (heard > 0)).tolist()]
        for r, row in zip(rep.tolist(), hit):
            groups = np.unique(self.group[row])
            edges.append((r, int(self.rep[groups[0]])))
            for g in groups[1:].tolist():
                edges.append((int(self.rep[groups[0]]), int(self.rep[g])))
                self.group[self.group == g] = groups[0]


def _meet(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by width and task, the stored ones first. Links have b null, edges n null."""
        task, block = None, _Block()
        for b in batches:
            widths, tasks, kinds = (b.column(i).to_numpy() for i in range(3))
            if not len(tasks):
                continue
            links: list[tuple[int, int]] = []
            edges: list[tuple[int, int]] = []
            new = np.r_[True, (widths[1:] != widths[:-1]) | (tasks[1:] != tasks[:-1]) | (kinds[1:] != kinds[:-1])]
            starts = np.flatnonzero(new).tolist()
            for s, e in zip(starts, [*starts[1:], len(tasks)]):
                if (widths[s], tasks[s]) != task:
                    task, block = (widths[s], tasks[s]), _Block()
                part = b.slice(s, e - s)
                rep, n, v = part.column(3).to_numpy(), part.column(4).to_numpy(), _matrix(part.column(7))
                if kinds[s] == 0:
                    block.store(rep, n, part.column(6).to_pylist(), v)
                else:
                    block.query(rep, n, part.column(5).to_numpy(), v, threshold, links, edges)
            a = [x for x, _ in links] + [x for x, _ in edges]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([None] * len(links) + [y for _, y in edges], pa.int64()), pa.array([y for _, y in links] + [None] * len(edges), pa.int64())], ["a", "b", "n"])

    return run


def _dealt(vectors: DataFrame, dims: int, threshold: float, recall: float) -> DataFrame:
    """The stored and query rows of vectors of one width."""
    total = vectors.count()
    most = int(min(SAMPLE, max(64, SAMPLE_BYTES // (8 * dims))))
    sample = vectors.orderBy(F.xxhash64("node"), "node").limit(most).select("v").collect()
    index = fit(np.array([np.frombuffer(r["v"], np.float64) for r in sample]), total, threshold, recall)
    sizes = np.zeros(len(index.a) * len(index.b), np.int64)
    for r in vectors.select("v").mapInArrow(_cells(index), "cell long").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["cell"]] = r["n"]
    split = max(2 * BLOCK, SPLIT_BYTES // (8 * dims))
    index.block, salts, held = np.zeros(len(sizes), np.int64), [1], 0
    for cell, n in enumerate(sizes.tolist()):
        if held and held + n > BLOCK:
            salts.append(1)
            held = 0
        index.block[cell] = len(salts) - 1
        held += n
        salts[-1] = max(1, -(-held // split))
    index.salts = np.array(salts)
    rows = vectors.select("node", "n", "v").mapInArrow(_deal(index), "task long, kind byte, rep long, n long, home int, seen array<int>, v binary")
    return rows.select(F.lit(dims).alias("width"), "*")


def _met(dealt: DataFrame, threshold: float) -> DataFrame:
    rows = dealt.repartition("width", "task").sortWithinPartitions("width", "task", "kind")
    return cut(rows.mapInArrow(_meet(threshold), "a long, b long, n long"))


def embedding_links(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row for each row of embeddings.

    Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different width
    don't link with each other. Ids may repeat or be null: each row is a vector and counts in others' links; a
    component's id is its smallest that isn't null, and null where all are (those rows are kept). Other columns are
    ignored; an empty table gives no rows.
    """
    rows = embeddings.select("vec_id", F.when(_usable(F.col("embedding")), F.col("embedding")).alias("v"))
    rows = cut(rows.withColumns({"k1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "k2": F.when(F.col("v").isNotNull(), F.hash("v"))}))
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = rows.where("v IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))  # written once, so the numbers stay
    vectors = cut(classes.select("node", "n", F.col("v").cast("array<double>").alias("v")).mapInArrow(_vectors, "node long, n long, width int, v binary"))
    widths = {r["width"]: r["n"] for r in vectors.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = sorted(d for d, n in widths.items() if n > FEW)
    whole = vectors.where(~F.col("width").isin(wide)) if wide else vectors
    ones = [F.lit(0).cast("long").alias("task"), F.explode(F.array(F.lit(0), F.lit(1)).cast("array<tinyint>")).alias("kind"), F.col("node").alias("rep"), "n", F.lit(0).alias("home"), F.array(F.lit(0)).alias("seen"), "v"]
    met = _met(whole.select("width", *ones), threshold)
    for d in wide:
        met = met.unionByName(_met(_dealt(vectors.where(F.col("width") == d), d, threshold, recall), threshold))
    links = met.where("b IS NULL").groupBy(F.col("a").alias("of")).agg(F.sum("n").alias("others"))
    reps = connected_components(met.where("b IS NOT NULL").select("a", "b"))
    named = classes.select("node", "k1", "k2", "n", "first").join(reps.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").drop("of")
    named = cut(named.withColumn("rep", F.coalesce("rep", "node")).join(links, F.col("node") == F.col("of"), "left").drop("of"))
    least = named.groupBy("rep").agg(F.min("first").alias("component_id"))
    known = cut(named.join(least, "rep").select("k1", "k2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"))
    found = rows.where("v IS NOT NULL").select("vec_id", "k1", "k2").join(known, ["k1", "k2"])
    discard(classes, vectors, named)
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone)


def op5_embedding_dedup(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of embeddings; hard inputs are treated as by embedding_links."""
    return embedding_links(embeddings)
