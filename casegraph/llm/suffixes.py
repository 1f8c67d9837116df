"""Removal of repeated 200-byte strings over a sparse, sampled suffix array.

Only some suffixes are sorted: those at anchors. A window of LENGTH bytes has as its anchor the GRAM-byte string in it
with the smallest hash (the leftmost of equals), so equal windows have their anchors at equal places. Neighbouring
windows with one anchor form a run, about 50 windows; a run's suffix is read as two tokens, the anchor's hash and
the hash of all bytes that the run's windows cover, 64 bits each. Splitters sampled from the suffixes range-partition them
by their leading tokens (ties go by a salt, document and place, so a passage in a third of all documents fills many buckets);
a bucket sorts its suffixes by multikey quicksort on the tokens and compares neighbours:

* an anchor that occurs once: none of the run's windows occurs elsewhere;
* both tokens occur again: all windows do, and their union is the bytes that the run covers;
* the anchor occurs again but not the run, or the anchor is a bucket's first or last and may go on in the next one:
  the run lies at the edge of a repeated passage and its windows are compared one by one.

For the edges the bytes that the runs cover are read from the texts, range-partitioned by anchor in the same way, and a
bucket compares the windows of one anchor byte by byte. Anchors at a bucket's boundary are compared across buckets too:
windows outside what the own bucket found ask, by hashes of 128 bits, and each bucket sends one of a kind of those that
may answer, so that a hot passage's runs may lie in any number of buckets. Windows that repeat within a run share the anchor, hence overlap: a run removes one interval.

What tells whole runs apart is 128 bits of two independent hashes, not their bytes; everything else is compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, text_hash

LENGTH, GRAM = 200, 104
#: Suffixes in a bucket and edge runs in one, about; bytes of a text that are hashed at once; the tokens' salts.
BUCKET, EDGES, CHUNK, SALTS = 400_000, 20_000, 1 << 19, 64
#: Rows that a task yields at once, and windows of a part in which they are compared across buckets.
ROWS, WINDOWS = 20_000, 1 << 21

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_rng = np.random.default_rng(20)
_TABLES = [_rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = [int(x) | 1 for x in _rng.integers(1 << 40, 1 << 62, 2)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


_UP = [_powers(b, CHUNK + 1) for b in _BASES]
_DOWN = [_powers(pow(b, -1, 1 << 64), CHUNK + 1) for b in _BASES]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def _prefixes(data: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[which][data] * _UP[which][: len(data)], out=out[1:])
    return out


def _of(prefix: np.ndarray, which: int, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the strings [s, e), wherever they stand."""
    return _mixed((prefix[e] - prefix[s]) * _DOWN[which][s])


def _smallest(keys: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours: the lesser of a suffix and a prefix minimum of blocks of w."""
    n = len(keys)
    blocks = np.pad(keys, (0, -n % w), constant_values=np.iinfo(np.uint64).max).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor's hash, hash of the covered bytes and the anchor's place, that place) of each run of a chunk."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
    w = length - gram + 1
    first, second = _prefixes(data, 0), _prefixes(data, 1)
    at = np.arange(len(data) - gram + 1)
    hashes = _mixed((first[gram:] - first[: len(at)]) * _DOWN[0][: len(at)])
    low = np.uint64((1 << 20) - 1)
    anchor = (_smallest((hashes & ~low) | at.astype(np.uint64), w) & low).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    ends = np.r_[starts[1:], len(anchor)] - 1
    a = anchor[starts]
    return starts, ends, hashes[a], _of(second, 1, starts, ends + length) + (a - starts).astype(np.uint64) * _MIX, a - starts


def _chunks(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces that hold every window once."""
    step = CHUNK - length + 1
    for s in range(0, max(1, len(data) - length + 1), step):
        yield s, data[s : s + CHUNK]


def _bytes(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column.cast(pa.large_binary()):
        yield np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(0, np.uint8)


_SUFFIX = "anchor long, covered long, salt byte, doc_id long, key long, p long, shape int"


def _suffixes(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run. shape: the windows after its first, and the anchor's place in it, times 1024."""
        salt = 0
        for b in batches:
            for row, data in enumerate(_bytes(b.column(2))):
                salt = (salt + 1) % SALTS
                for s, piece in _chunks(data, length):
                    p, q, anchor, covered, at = runs(piece, length, gram)
                    if len(p):
                        take = pa.array(np.full(len(p), row))
                        cols = [pa.array(anchor.view(np.int64)), pa.array(covered.view(np.int64)), pa.array(np.full(len(p), salt, np.int8)), b.column(0).take(take), b.column(1).take(take), pa.array(p + s), pa.array((q - p + at * 1024).astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(cols, ["anchor", "covered", "salt", "doc_id", "key", "p", "shape"])

    return run


def multikey_order(tokens: list[np.ndarray], small: int = 1 << 14) -> np.ndarray:
    """The order of token sequences by multikey quicksort: rows are parted into those with a lesser, an equal and a greater
    token than the pivot's; the equal ones go on with the next token. Parts of few rows are sorted at once."""
    order = np.arange(len(tokens[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        mine = order[lo:hi]
        if depth == len(tokens) or hi - lo < 2:
            continue
        if hi - lo <= small:
            order[lo:hi] = mine[np.lexsort([t[mine] for t in tokens[depth:][::-1]])]
            continue
        x = tokens[depth][mine]
        pivot = np.sort(x[:: max(1, len(x) // 9)])[4]
        less, more = x < pivot, x > pivot
        same = ~(less | more)
        a, b = lo + int(less.sum()), hi - int(more.sum())
        order[lo:hi] = np.concatenate([mine[less], mine[same], mine[more]])
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bucket's runs that matter: whole (every window occurs again) and edge (its windows are to be compared)."""
    t = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if t is None:
        return
    t = t.combine_chunks()
    anchor, covered = t.column("anchor").to_numpy(), t.column("covered").to_numpy()
    order = multikey_order([anchor, covered])
    a, c = anchor[order], covered[order]
    new_a = np.r_[True, a[1:] != a[:-1]]
    new_c = new_a | np.r_[True, c[1:] != c[:-1]]
    size = lambda new: np.diff(np.r_[np.flatnonzero(new), len(a)])[np.cumsum(new) - 1]
    alike, same = size(new_a), size(new_c)
    kinds = np.bincount(np.cumsum(new_a) - 1, weights=new_c)[np.cumsum(new_a) - 1]
    border = (a == a[0]) | (a == a[-1])  # may go on in the next bucket
    whole = same > 1
    edge = ((alike > 1) & (kinds > 1) | border) & (~whole | new_c)  # of runs that are whole, one speaks for its kind
    keep = whole | edge
    take = pa.array(order[keep])
    yield from t.take(take).append_column("whole", pa.array(whole[keep])).append_column("edge", pa.array(edge[keep])).select(["anchor", "doc_id", "key", "p", "shape", "whole", "edge"]).to_batches()


_RUN = "anchor long, doc_id long, key long, p long, shape int, whole boolean, span binary"


def _spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edge runs of each text with the bytes that they cover."""
        for b in batches:
            for row, (data, todo) in enumerate(zip(_bytes(b.column(2)), b.column(3).to_pylist())):
                for s in range(0, len(todo), ROWS):
                    some = todo[s : s + ROWS]
                    take = pa.array(np.full(len(some), row))
                    span = [data[r["p"] : r["p"] + (r["shape"] & 1023) + length].tobytes() for r in some]
                    col = lambda name, kind: pa.array([r[name] for r in some], kind)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([col("anchor", pa.int64()), b.column(0).take(take), b.column(1).take(take), col("p", pa.int64()), col("shape", pa.int32()), col("whole", pa.bool_()), pa.array(span, pa.binary())], [x.split()[0] for x in _RUN.split(", ")])

    return run


def shared_windows(spans: list[bytes], shapes: list[int], ask: list[bool], length: int) -> list[tuple[int, int, int]]:
    """(run, first, last): of runs of one anchor that ask, their first and last window that another window equals."""
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    more, place = [x & 1023 for x in shapes], [x >> 10 for x in shapes]
    # windows that are equal have their anchors at equal places: only those d bytes before it are compared
    for d in range(max(place), min(p - m for p, m in zip(place, more)) - 1, -1):
        seen: dict[bytes, int] = {}
        for i, span in enumerate(spans):
            w = place[i] - d
            if 0 <= w <= more[i]:
                window = span[w : w + length]
                j = seen.setdefault(window, i)
                if j != i:
                    for k in (i, j):
                        if ask[k]:
                            u = place[k] - d
                            first[k], last[k] = min(first.get(k, u), u), max(last.get(k, u), u)
    return [(i, first[i], last[i]) for i in sorted(first)]


def _compared(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor. Runs that ask give the interval [s, e) that they lose to others of the bucket; runs of the
        bucket's first and last anchor are handed on with their bytes too, whether they found one or not."""
        names = ["anchor", "doc_id", "key", "p", "shape", "whole", "span", "s", "e"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64()]
        group: list[tuple] = []
        leading, out = None, []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return batch

        def settle(border: bool) -> None:
            got = {}
            if len(group) > 1 and not all(r[5] for r in group):
                got = {i: (s, e) for i, s, e in shared_windows([r[6] for r in group], [r[4] for r in group], [not r[5] for r in group], length)}
            for i, r in enumerate(group):
                if border or i in got:
                    s, e = got.get(i, (None, None))
                    out.append((*r[:6], r[6] if border else None, None if s is None else r[3] + s, None if e is None else r[3] + e + length))
            group.clear()

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                leading = r[0] if leading is None else leading
                if group and group[0][0] != r[0]:
                    settle(group[0][0] == leading)
                    if len(out) >= ROWS:
                        yield made()
                group.append(r)
        if group:
            settle(True)
        if out:
            yield made()

    return run


_BLOCK = "part int, h1 array<long>, h2 array<long>, doc_id array<long>, key array<long>, p array<long>, w array<long>, ask array<boolean>"


def _windows(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """128 bits of the runs' windows, in one row for each part that the hashes are dealt to. Windows ask, but for those of
        whole runs and those between the first and the last that the bucket knows to be shared; of the latter, which only
        answer, one of a kind is enough."""
        for b in batches:
            shapes = b.column(4).to_numpy() & 1023
            for lo in range(0, b.num_rows, 2000):
                out = []
                for i in range(lo, min(b.num_rows, lo + 2000)):
                    data = np.frombuffer(b.column(6)[i].as_buffer(), np.uint8)
                    at = np.arange(shapes[i] + 1)
                    one, two = (_of(_prefixes(data, k), k, at, at + length) for k in (0, 1))
                    whole, p, s, e = (b.column(k)[i].as_py() for k in (5, 3, 7, 8))
                    ask = np.full(len(at), not whole)
                    if s is not None:
                        ask &= (at + p < s) | (at + p + length > e)
                    out.append((np.full(len(at), i), one.view(np.int64), two.view(np.int64), at, ask))
                row, one, two, at, ask = map(np.concatenate, zip(*out))
                quiet = np.flatnonzero(~ask)
                _, kinds = np.unique(np.column_stack([one[quiet], two[quiet]]), axis=0, return_index=True)
                keep = np.r_[np.flatnonzero(ask), quiet[kinds]]
                part = (one[keep].view(np.uint64) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                keep, part = keep[order], part[order]
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                ends = pa.array(np.r_[starts, len(part)].astype(np.int32))
                take = pa.array(row[keep])
                p = b.column(3).take(take)
                cols = [pa.array(one[keep]), pa.array(two[keep]), b.column(1).take(take), b.column(2).take(take), p, pc.add(p, pa.array(at[keep])), pa.array(ask[keep])]
                yield pa.RecordBatch.from_arrays([pa.array(part[starts]), *(pa.ListArray.from_arrays(ends, c) for c in cols)], [x.split()[0] for x in _BLOCK.split(", ")])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part: the windows that ask and whose hashes another window has."""
    part, held = None, []

    def settle() -> pa.RecordBatch:
        one, two, doc_id, key, p, w, ask = (pa.concat_arrays([h.column(i).flatten() for h in held]) for i in range(1, 8))
        a, b = one.to_numpy(), two.to_numpy()
        order = np.lexsort([b, a])
        new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
        alike = np.diff(np.r_[np.flatnonzero(new), len(order)])[np.cumsum(new) - 1]
        take = pa.array(order[(alike > 1) & ask.to_numpy(zero_copy_only=False)[order]])
        return pa.RecordBatch.from_arrays([x.take(take) for x in (doc_id, key, p, w)], ["doc_id", "key", "p", "w"])

    for b in batches:
        parts = b.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else []
        for s, e in zip(starts, [*starts[1:], len(parts)]):
            if parts[s] != part and held:
                yield settle()
                held = []
            part = parts[s]
            held.append(b.slice(s, e - s))
    if held:
        yield settle()


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, spans, digest = [], [], [], []
        for data, parts in zip(_bytes(b.column(1)), b.column(2).to_pylist()):
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in parts or []):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            h, at = hashlib.sha256(), 0
            for s, e in merged:
                h.update(data[at:s])
                at = e
            h.update(data[at:])
            n.append(len(data))
            gone.append(sum(e - s for s, e in merged))
            spans.append(len(merged))
            digest.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", text_hash().alias("key"), "text")


def _with(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs with the array that found has for an id and key."""
    found = found.withColumnsRenamed({"doc_id": "f_id", "key": "f_key"})
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")), how).drop("f_id", "f_key")


def repeated_intervals(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, cuts): byte intervals [s, e) to remove, for each document that has any. key is text_hash()."""
    docs = _texts(documents)
    n_bytes = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-n_bytes // (BUCKET * (length - gram + 2) // 2)))
    dealt = docs.mapInArrow(_suffixes(length, gram), _SUFFIX).repartitionByRange(buckets, "anchor", "covered", "salt", "doc_id", "p")
    found = cut(dealt.mapInArrow(_neighbours, "anchor long, doc_id long, key long, p long, shape int, whole boolean, edge boolean"))
    n_edges = found.where("edge").count()
    todo = found.where("edge").groupBy("doc_id", "key").agg(F.collect_set(F.struct("anchor", "p", "shape", "whole")).alias("todo"))
    # rows that repeat id and text count as two: each window of theirs occurs twice
    spans = cut(_with(docs, todo, "inner").select("doc_id", "key", "text", "todo").mapInArrow(_spans(length), _RUN))
    # a number of each row, so that rows that repeat fill several buckets
    near = spans.withColumn("i", F.monotonically_increasing_id()).repartitionByRange(max(8, -(-n_edges // EDGES)), "anchor", "doc_id", "key", "p", "i")
    near = cut(near.drop("i").sortWithinPartitions("anchor").mapInArrow(_compared(length), f"{_RUN}, s long, e long"))
    border = near.where("span IS NOT NULL")
    parts = max(64, -(-border.count() * (length - gram) // WINDOWS))
    dealt = border.mapInArrow(_windows(length, parts), _BLOCK).repartition(parts, "part").sortWithinPartitions("part")
    edges = dealt.mapInArrow(_answers, "doc_id long, key long, p long, w long").groupBy("doc_id", "key", "p").agg(F.min("w").alias("s"), (F.max("w") + length).alias("e"))
    whole = found.where("whole").select("doc_id", "key", F.col("p").alias("s"), (F.col("p") + F.expr("shape & 1023") + length).alias("e"))
    # a run's shared windows hold its anchor, so what its bucket and the others find overlaps
    both = whole.unionByName(near.where("s IS NOT NULL").select("doc_id", "key", "s", "e")).unionByName(edges.select("doc_id", "key", "s", "e"))
    cuts = cut(both.groupBy("doc_id", "key").agg(F.collect_set(F.struct("s", "e")).alias("cuts")))
    discard(found, spans, near)
    return cuts


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of documents.

    Null texts count as empty and texts under the length lose nothing. Rows that repeat lose all bytes that windows
    cover, being copies of each other. Ids may repeat or be null; other columns are ignored; an empty table gives no rows.
    """
    cuts = repeated_intervals(documents, length, gram)
    return _with(_texts(documents), cuts, "left").select("doc_id", "text", "cuts").mapInArrow(_cuts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_dedup(documents: DataFrame) -> DataFrame:
    """What each document loses to strings of 200 bytes that also start elsewhere; hard inputs are treated as by remove_repeats."""
    return remove_repeats(documents)
