"""Repeated rows, clashing names, hot groups and null ids: one case for each, all small."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SMALL, brute_components, brute_repeats, brute_targets, empty, frame, hard

from casegraph.llm import decontam, embeddings, linedup, mixing, nearcopies, pii, quality, simhash, suffixes, warc
from casegraph.llm.common import table

CLASHING = ("g_id", "g_hash", "__h", "__score", "__runs", "row", "rep", "n", "kept", "runs", "r_id", "k_id", "score")


def same(df, sql, **tables):
    """Like the other tests' same(), but null ids stay integers."""
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    cols = sorted(df.columns)
    want = con.execute(sql).to_arrow_table().select(cols).to_pylist()
    got = [r.asDict() for r in df.select(cols).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    return got


def clashing(spark):
    return hard(spark).withColumns({c: F.lit(c) for c in CLASHING if c not in hard(spark).columns})


def test_clashing_columns_stay(spark):
    df = clashing(spark)
    bench, labels = table(spark, SMALL, "benchmark"), table(spark, SMALL, "labels")
    made = {
        "decontaminated": decontam.decontaminated(df, bench), "simhash": simhash.simhash_survivors(df), "near": nearcopies.near_survivors(df),
        "lines": linedup.line_deduplicated(df), "quality": quality.quality_survivors(df, labels),
    }
    for name, out in made.items():
        rows = out.collect()
        assert out.columns == df.columns, name
        assert all(r["__h"] == "__h" and r["g_id"] == "g_id" and r["__score"] == "__score" for r in rows), name
    assert decontam.decontaminated(df, bench).count() == df.count()


def test_repeated_benchmark_items(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    docs = frame(spark, (1, "x " + " ".join(words[:26]) + " y", "s"), (2, "x " + " ".join(words[:38]) + " y", "s"), (3, item, "s"))
    schema = "item_id long, text string"
    once = spark.createDataFrame([(7, item), (None, "some other item of a few words here")], schema)
    twice = once.unionByName(once).unionByName(spark.createDataFrame([(7, item)], schema))
    got = [sorted(map(tuple, decontam.op8_decontamination(docs, b).collect())) for b in (once, twice)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [2, 3] and all(r[4] <= 1 for r in got[0])
    # one id with two texts is one item, as in the SQL
    parted = once.unionByName(spark.createDataFrame([(7, " ".join(f"v{i}" for i in range(12)))], schema))
    same(decontam.op8_decontamination(docs, parted), decontam.SQL, documents=docs, benchmark=parted)


def test_repeated_and_null_pages(spark):
    pages = table(spark, SMALL, "pages")
    once = sorted(map(str, warc.op10_warc_revisits(pages).collect()))
    assert sorted(map(str, warc.op10_warc_revisits(pages.unionByName(pages)).collect())) == once
    odd = spark.createDataFrame([(None, "http://a.example/x", "h"), (3, None, "h"), (3, "http://a.example/y", None), (5, "http://a.example/y", ""), (5, "http://a.example/y#z", "other"), (2_000_000, "http://a.example/y", "late")], pages.schema)
    both = pages.unionByName(odd)
    got = same(warc.op10_warc_revisits(both), warc.SQL, pages=both)
    assert sum(r["outcome"] == "missing" for r in got) >= 2
    assert warc.op10_warc_revisits(spark.createDataFrame([], pages.schema)).count() == 0


def test_equal_later_documents_leave_one_copy_of_a_line(spark):
    a, b = "the first line of the text here", "a second line of the same text"
    rows = [(1, f"{b}\n{a}", "s"), (2, f"{a}\n{b}", "s"), (3, f"{a}\n{b}", "s")]
    got = {r["doc_id"]: r["text"] for r in linedup.line_deduplicated(frame(spark, *rows)).collect()}
    assert got[1] == rows[0][1] and got[2] in (a, b) and got[3] == ""


def test_frequent_lines_pair_when_rare_ones_have_not(spark, monkeypatch):
    monkeypatch.setattr(linedup, "RARE", 2)
    common = "a notice that every document repeats at its end"
    rows = [(i, f"text number {i} with words of its own\n{common}", "s") for i in range(12)] + [(20, f"text number 3 with words of its own\nx\n{common}\ny", "s")]
    got = {r["doc_id"]: r["text"] for r in linedup.line_deduplicated(frame(spark, *rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"text number {i} with words of its own" for i in range(1, 12)) and got[20] == "x\ny"


def test_hot_cells_are_split(spark, monkeypatch):
    """Components do not change when a cell's fingerprints meet in parts."""
    monkeypatch.setattr(simhash, "HOT", 3)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(120)})
    nodes = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    rows = simhash.cell_rows(nodes)
    assert rows.where("kind = 0").groupBy("cell").count().agg(F.max("count")).first()[0] <= 12
    edges = rows.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(simhash._cell_links(3), "a long, b long").collect()
    up = simhash.Forest()
    for r in edges:
        up.join(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1)
    want = brute_components(fps, fps)
    groups = lambda roots: sorted(sorted(x for x, r in zip(fps, roots) if r == root) for root in set(roots))
    assert groups([up.root(x) for x in fps]) == groups(want)


def test_near_copies_in_split_cells(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "HOT", 2)
    rng = random.Random(8)
    texts = []
    for _ in range(4):
        words = [f"w{rng.randrange(3000)}" for _ in range(150)]
        chain = list(words)
        for k in range(12):  # each is near the one before, not the first
            chain[k * 10 : k * 10 + 3] = [f"v{rng.randrange(3000)}" for _ in range(3)]
            texts.append(" ".join(chain))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    up = simhash.Forest()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) - 1e-9:
                up.join(i, j)
    got = sorted(r["doc_id"] for r in nearcopies.near_survivors(frame(spark, *((i, t, "a") for i, t in enumerate(texts)))).collect())
    assert got == sorted({up.root(i) for i in range(len(texts))})


def test_targets_of_many_sources(spark):
    rng = random.Random(3)
    sizes = {f"s{i:03d}": rng.choice([0, 1, 5, 50, 500, 5000]) for i in range(60)} | {None: 40}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = brute_targets(Counter(sizes))
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


@pytest.mark.parametrize("edges", [20_000, 3])
def test_repeats_of_repeated_rows_and_long_runs(spark, monkeypatch, edges):
    monkeypatch.setattr(suffixes, "EDGES", edges)
    monkeypatch.setattr(suffixes, "BUCKET", 40)
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    passage, whole = word(420), word(700)
    rows = [(i, word(50) + passage[rng.randint(0, 100) : rng.randint(320, 420)] + word(50), "s") for i in range(25)]
    rows += [(None, whole, "s")] * 5 + [(77, whole, "s")] * 4 + [(78, "x" * 3000, "s"), (79, "ab" * 700 + word(300) + "ab" * 300, "s")]
    df = frame(spark, *rows)
    assert sorted(map(tuple, suffixes.op4_suffix_dedup(df).collect()), key=str) == brute_repeats([(i, t) for i, t, _ in rows], 200)


def test_embeddings_of_several_widths_and_repeated_ids(spark):
    rows = [(10, [1.0, 2.0]), (11, [1.0, 2.0]), (1, [0.1, 0.2, 0.3]), (2, [0.1, 0.2, 0.31]), (None, [0.1, 0.2, 0.3]), (5, [9.0, -1.0, 0.0]), (5, [0.1, 0.2, 0.3]), (None, [0.0, 5.0, -9.0]), (7, None)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.op5_embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() if r["vec_id"] is not None)
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (5, 0, 5, True), (5, 3, 1, False), (7, 0, 7, True), (10, 1, 10, True), (11, 1, 10, False)]


def test_embeddings_that_need_every_cell(spark, monkeypatch):
    """Where no number of visits reaches the recall, every pair is compared."""
    monkeypatch.setattr(embeddings, "PER_CELL", 2)
    monkeypatch.setattr(embeddings, "BLOCK", 20)
    monkeypatch.setattr(embeddings, "FEW", 10)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 6)).astype(np.float32)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_links(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), 0.5, 1.0).collect()}
    e = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = (e @ e.T >= 0.5).sum(1) - 1
    assert sum(got.values()) >= 0.999 * want.sum() and all(got[i] <= want[i] for i in got)


def test_dense_embeddings_split_by_salts(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "FEW", 10)
    monkeypatch.setattr(embeddings, "BLOCK", 20)
    monkeypatch.setattr(embeddings, "SPLIT_BYTES", 1)
    rng = np.random.default_rng(6)
    x = (np.ones(8) + rng.normal(size=(300, 8)) * 0.01).astype(np.float32)
    got = embeddings.embedding_links(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    assert {r["n_links"] for r in got} == {299} and {r["component_id"] for r in got} == {0}


def test_quality_learns_from_whole_texts(spark):
    """What tells labels apart stands after 20,000 characters of equal text."""
    rng = random.Random(2)
    head = " ".join(f"w{rng.randrange(400)}" for _ in range(4500))
    tails = [["zq", "xj", "kv", "wq"], ["the", "tree", "stood", "there"]]
    rows, labels = [], []
    for i in range(160):
        y = i % 2
        rows.append((i, head[: 20_000] + " " + " ".join(rng.choice(tails[y]) + str(rng.randrange(9)) for _ in range(1500)), "s"))
        labels.append((i, y, 0))
    got = quality.quality_scores(frame(spark, *rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    out = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in out) >= 0.9 * len(out)


def test_reliabilities_follow_agreement(spark):
    """Expectation-maximisation on made votes: candidates that most labelers favour end likelier than those that most reject."""
    rng = random.Random(1)
    votes = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.4
        vote = lambda good: (1 if truth else -1) if rng.random() < good else (-1 if truth else 1)  # noqa: B023, E731
        votes[(0, vote(0.95), vote(0.9), vote(0.85), rng.choice([0, 0, vote(0.8)]), vote(0.5))] += 1
    rows = [(*k, n) for k, n in votes.items()]
    schema = "kind int, " + ", ".join(f"v_{n} int" for n in pii.VOTES) + ", n long"
    got = pii.reliabilities(spark.createDataFrame(rows, schema)).collect()
    assert all(r["p"] > 0.9 for r in got if r["v_regex"] == r["v_check"] == r["v_gazetteer"] == 1)
    assert all(r["p"] < 0.1 for r in got if r["v_regex"] == r["v_check"] == r["v_gazetteer"] == -1)
    found = sum(r["n"] * r["p"] for r in got) / sum(votes.values())
    assert abs(found - 0.4) < 0.05


def test_added_spans_are_right(spark):
    rows, planted = [], set()
    for i in range(120):
        rows.append((i, f"write to me{i}@mail.example.com or call +1 (743) 555-38{i % 100:02d} today", "s"))
    for i in range(40):
        text = f"my mail is user{i} (at) host (dot) com and more"
        rows.append((1000 + i, text, "s"))
        planted.add((1000 + i, f"email:{text.index('user')}:{text.index(' and more')}"))
        rows.append((2000 + i, f"order {100 + i} 200 3000 and release {i}.2.3 of serial 123-45{i % 10}-678", "s"))
    got = pii.op1_pii(frame(spark, *rows)).collect()
    added = {(r["doc_id"], s) for r in got if r["n_added"] for s in r["spans"].split(",")}
    assert planted <= added and len(added) <= 1.1 * len(planted)


def test_empty_tables(spark):
    bench, labels = table(spark, SMALL, "benchmark"), table(spark, SMALL, "labels")
    none = empty(spark)
    assert decontam.op8_decontamination(table(spark, SMALL, "documents"), bench.limit(0)).count() == 0
    assert mixing.op3_mixing(none).count() == 0 and quality.quality_survivors(none, labels).count() == 0
    assert suffixes.op4_suffix_dedup(none).count() == 0 and linedup.line_deduplicated(none).count() == 0
