"""Line dedup by pairwise alignment.

Lines of at least MIN_WORDS words are hashed. Rare lines, held by at most RARE documents, pair documents first: each
later holder with the line's first one. A pair's line hashes are aligned by patience diff (lines that both documents hold
once, longest increasing run, then within the gaps; a longest common subsequence where a gap has no such line), and the
aligned blocks that hold a hashed line are deleted from the later document. Hashed lines that stay, the frequent ones
among them, pair their document in further rounds with the line's first holder and then the next 4, 16, ... earlier ones,
until each is deleted or has met all of them: a hashed line goes if any earlier document that holds it aligns it. So a line
in a third of all documents makes one pair for each where it aligns, whatever its number of holders.
Documents are ordered by id, nulls last, then by a hash of the text; only line hashes are moved to form and align pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, packed, same_row, text_hash, unpacked

MIN_WORDS = 5
#: Documents that hold a rare line, at most.
RARE = 32
#: Cells of a table of common subsequences; larger ones are halved.
CELLS = 1 << 22


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_hash(line: Column) -> Column:
    """Of the line without outer white space; 0 for a blank line, which aligns with nothing."""
    bare = F.trim(F.regexp_replace(line, r"^[\t-\r ]+|[\t-\r ]+$", ""))
    return F.when(bare == "", F.lit(0)).otherwise(F.xxhash64(bare)).cast("long")


def _long(line: Column, least: int) -> Column:
    return F.regexp_like(line, F.lit(rf"^\s*+(?:\S++\s++){{{least - 1}}}\S"))


def _lengths(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """For each prefix of a the lengths of its longest common subsequence with b's prefixes."""
    row = np.zeros(len(b) + 1, np.int32)
    yield row
    for x in a:
        row = np.r_[0, np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))].astype(np.int32)
        yield row


def common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence."""
    if not len(a) or not len(b):
        return []
    if len(a) > 1 and len(a) * len(b) > CELLS:
        mid = len(a) // 2
        for front in _lengths(a[:mid], b):
            pass
        for back in _lengths(a[mid:][::-1], b[::-1]):
            pass
        k = int(np.argmax(front + back[::-1]))
        return common(a[:mid], b[:k]) + [(i + mid, j + k) for i, j in common(a[mid:], b[k:])]
    table = list(_lengths(a, b))
    i, j, out = len(a), len(b), []
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal lines, increasing in both. 0 aligns with nothing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            if a[alo]:
                out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            if a[ahi]:
                out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        at_a: dict[int, int] = {}
        at_b: dict[int, int] = {}
        for side, lo, hi, at in ((a, alo, ahi, at_a), (b, blo, bhi, at_b)):
            for i in range(lo, hi):
                at[side[i]] = -1 if side[i] in at else i
        once = [(i, at_b[h]) for h, i in at_a.items() if h and i >= 0 and at_b.get(h, -1) >= 0]
        once.sort()
        tops: list[int] = []
        last: list[int] = []
        back = [-1] * len(once)
        for k, (_, j) in enumerate(once):
            p = bisect_left(tops, j)
            tops[p : p + 1] = [j]
            last[p : p + 1] = [k]
            back[k] = last[p - 1] if p else -1
        run = []
        k = last[-1] if last else -1
        while k >= 0:
            run.append(once[k])
            k = back[k]
        i, j = alo, blo
        for x, y in reversed(run):
            out.append((x, y))
            todo.append((i, x, j, y))
            i, j = x + 1, y + 1
        if run:
            todo.append((i, ahi, j, bhi))
            continue
        left = [i for i in range(alo, ahi) if a[i] and a[i] in at_b]
        right = [j for j in range(blo, bhi) if b[j] and b[j] in at_a]
        out += [(left[i], right[j]) for i, j in common(np.array([a[i] for i in left], np.int64), np.array([b[j] for j in right], np.int64))]
    return sorted(out)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair the later document's deleted lines, as starts and ends of runs."""
    for b in batches:
        ids, gone = [], []
        for row, (first, later, anchors) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())):
            runs: list[list[int]] = []  # blocks: aligned lines that follow each other in both
            before = (-2, -2)
            for x, y in patience(first, later):
                if (x, y) == (before[0] + 1, before[1] + 1):
                    runs[-1][1] = y + 1
                else:
                    runs.append([y, y + 1])
                before = (x, y)
            marked = [False] * len(later)
            for i in anchors:
                marked[i] = True
            kept = [r for r in runs if any(marked[r[0] : r[1]])]
            if kept:
                ids.append(row)
                gone.append([{"s": s, "e": e} for s, e in kept])
        take = pa.array(ids, pa.int64())
        run = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(gone, run)], ["doc_id", "text_hash", "runs"])


def deletions(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, runs, partners): line runs [s, e) to delete, for each document that loses any."""
    docs = documents.select("doc_id", text_hash().alias("text_hash"), lines(F.col("text")).alias("l"))
    hashed = docs.select("doc_id", "text_hash", F.transform("l", _line_hash).alias("h"), F.transform("l", lambda x: _long(x, min_words)).alias("k"))
    # rows that repeat id and text are one document here
    whole = cut(hashed.select("doc_id", "text_hash", "h", F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.get("k", i)).alias("anchors")))
    hashed = whole.where("size(anchors) > 0")  # of what is written: a filter before it would hash the lines twice
    key = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_hash")
    held = hashed.select(key.alias("d"), F.explode(F.array_distinct(F.transform("anchors", lambda i: F.get("h", i)))).alias("h"))
    shared = held.groupBy("h").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n")).where("first != last").drop("last")
    later = cut(held.join(shared, "h").where("d != first").select("d", "h", "first", "n"))
    used = later.select("d").union(later.select("first")).distinct()
    known = cut(hashed.select(key.alias("d"), "h", "anchors").join(used, "d", "left_semi").groupBy("d").agg(F.first("h").alias("h"), F.first("anchors").alias("anchors")))
    early = known.select(F.col("d").alias("first"), F.col("h").alias("early"))

    def align(pairs: DataFrame) -> DataFrame:
        both = pairs.join(known.withColumnRenamed("h", "later"), "d").join(early, "first")
        rows = both.select("d.doc_id", "d.text_hash", "early", "later", "anchors")
        return cut(rows.mapInArrow(_aligned, "doc_id long, text_hash long, runs array<struct<s:int,e:int>>"))

    def staying(open_: DataFrame, aligned: DataFrame) -> DataFrame:
        """Those of open_ (d, h and more) of which the document still has an occurrence."""
        runs = aligned.groupBy(key.alias("d")).agg(F.flatten(F.collect_set("runs")).alias("runs"))
        left = F.filter("anchors", lambda i: ~F.exists("runs", lambda r: (r["s"] <= i) & (i < r["e"])))
        gone = known.join(runs, "d").select("d", "h", "anchors", left.alias("left"))
        gone = gone.select("d", F.explode(F.array_except(F.transform("anchors", lambda i: F.get("h", i)), F.transform("left", lambda i: F.get("h", i)))).alias("h"))
        return open_.join(gone, ["d", "h"], "left_anti")

    tried = cut(later.where(F.col("n") <= RARE).select("first", "d").distinct())
    aligned = align(tried)
    left = cut(staying(later, aligned))
    fresh = cut(left.where(F.col("n") > RARE).select("first", "d").distinct().join(tried, ["first", "d"], "left_anti"))
    met, step = 1, 4
    while True:
        if not fresh.isEmpty():
            aligned, tried = cut(aligned.unionByName(align(fresh))), cut(tried.unionByName(fresh))
            left = cut(staying(left, aligned))
        if left.isEmpty():
            break
        # of each line only the holders that are next: the window keeps few rows a line in every task before it shuffles
        lines_ = left.select("h").distinct()
        holders = later.select("h", "d").union(later.select("h", F.col("first").alias("d"))).distinct().join(lines_, "h", "left_semi")
        top = holders.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("d"))).where(F.col("rank") <= met + step)
        top = cut(top.where(F.col("rank") > met))
        next_ = top.select("h", F.col("d").alias("next"))
        fresh = cut(left.join(next_, "h").where("next < d").select(F.col("next").alias("first"), "d").distinct().join(tried, ["first", "d"], "left_anti"))
        met, step = met + step, step * 4
        beyond = top.where(F.col("rank") == met).select("h", F.col("d").alias("edge"))
        open_ = cut(left.join(beyond, "h").where("edge < d").select("d", "h", "first", "n"))
        if open_.isEmpty():
            if not fresh.isEmpty():
                aligned = cut(aligned.unionByName(align(fresh)))
            break
        left = open_
    discard(whole, later)
    return aligned.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"), F.count(F.lit(1)).alias("partners"))


def _with_runs(documents: DataFrame, min_words: int) -> DataFrame:
    found = cut(deletions(documents, min_words).withColumnsRenamed({"doc_id": "r_id", "text_hash": "r_hash"}))
    return packed(documents).join(found, same_row("r_id", "r_hash"), "left")


def _kept() -> Column:
    """The text without its deleted lines."""
    stay = F.filter(lines(F.col("text")), lambda x, i: ~F.exists("runs", lambda r: (r["s"] <= i) & (i < r["e"])))
    return F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))


def line_deduplicated(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """documents with the deleted lines gone from text, and n_chars counted anew where that column exists.

    Null and empty texts stay as they are; documents that lose every line stay with an empty text; rows that repeat
    id and text are one document and get one treatment; ids may repeat or be null; further columns are kept,
    whatever their names; an empty table gives no rows.
    """
    rows = _with_runs(documents, min_words).withColumn("kept", _kept())
    instead = {"text": F.col("kept")}
    if "n_chars" in documents.columns:
        instead["n_chars"] = F.when(F.col("runs").isNull(), F.col("row").getField("n_chars")).otherwise(F.length("kept").cast("long"))
    return unpacked(rows, documents.columns, **instead)


def op9_line_dedup(documents: DataFrame) -> DataFrame:
    """Lines before, lines deleted, partners and the kept text's digest of every row of documents.

    A null text is one empty line. Rows that repeat id and text get equal results, ids may repeat or be null, other
    columns are ignored and an empty table gives no rows; see line_deduplicated.
    """
    rows = _with_runs(documents.select("doc_id", "text"), MIN_WORDS)
    all_lines = F.size(lines(F.col("text")))
    stay = F.filter(F.sequence(F.lit(0), all_lines - 1), lambda i: F.exists("runs", lambda r: (r["s"] <= i) & (i < r["e"])))
    return rows.select(
        "doc_id", all_lines.cast("long").alias("n_lines"), F.when(F.col("runs").isNull(), 0).otherwise(F.size(stay)).cast("long").alias("n_deleted"),
        F.coalesce("partners", F.lit(0)).alias("n_partners"), F.sha2(F.coalesce(_kept(), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
