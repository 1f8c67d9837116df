"""The corpus operators against brute force, SQL or held-out labels, and on hard inputs."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from casegraph.llm import decontam, embeddings, licenses, linedup, mixing, nearcopies, pii, quality, simhash, suffixes, warc
from casegraph.llm.common import table

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents")


def frame(spark, *rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def hard(spark):
    """Nulls anywhere, empty and long texts, repeated rows and ids, columns whose names clash with inner ones."""
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", None), (None, "some words with no id at all here", "a"), (3, long_text, "b"), (3, long_text, "b"), (3, "other text under the same id 3", "b"), (4, "one", "c"), (5, "é ü 😀 mail 😀@x", None)]
    return frame(spark, *rows).withColumns({"fp": F.lit(1), "key": F.lit("k"), "t": F.lit("x"), "h": F.lit(0), "score": F.lit(0.0), "size": F.lit(9), "target": F.lit(1), "text_hash": F.lit(7)})


def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- op 1 --------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def base_spans(text):
    out, n = [], []
    for kind, pattern in PATTERNS.items():
        found = 0
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            bad = kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15
            if not bad:
                found += 1
                out.append(f"{kind}:{m.start()}:{m.end()}")
        n.append(found)
    return n, out


def check_pii(df):
    texts = {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}
    got = pii.op1_pii(df).collect()
    for r in got:
        n, spans = base_spans(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == n, r
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(",")) | {""} and (r["n_added"] or r["spans"] == ",".join(spans))
    return got


def test_pii_base_spans(spark, docs):
    assert len(check_pii(docs)) == docs.count()


def test_pii_hard_matches(spark):
    cases = [
        "a@b.com_x@d.org 1.2.3.4.5.6.7.8 999.1.1.1", "+1 (743) 555-3824 +12 +1-", "4111 1111 1111 1111 4111-1111-1111-1111-1 41111111111111112", "😀 x@y.z 😀 10.0.0.1",
        "a" * 30_000 + "@", "x@" + ".a" * 5_000, "x@y" + ".a" * 5_000, "1" * 30_000 + " " + "1 " * 5_000, "++1++1 2 3 4 5 6 7 8 9", "00000000000000 1.02.003.0004", "",
        "a.@-.b %@x.y@z.w", "1.1.1.1.1.1.1.1 +999999999 +99999999 5-5-5",
    ]
    check_pii(frame(spark, *((i, t, "s") for i, t in enumerate(cases))))


def test_pii_random_against_regex(spark):
    rng = random.Random(4)
    check_pii(frame(spark, *((i, "".join(rng.choice("0123456789.@+- ()ab%_") for _ in range(rng.randint(0, 120))), "s") for i in range(400))))


def test_pii_adds_spelled_out_addresses(spark):
    rows = [(i, f"write to me{i}@mail.example.com or call +1 (743) 555-38{i:02d} today", "s") for i in range(60)]
    rows += [(100 + i, f"mail user{i} (at) host (dot) com please, phone (743) 555-38{i:02d}", "s") for i in range(20)] + [(200 + i, "nothing at all to see here. 12 34", "s") for i in range(30)]
    got = {r["doc_id"]: r for r in check_pii(frame(spark, *rows))}
    assert all(got[i]["n_added"] == 0 for i in [*range(60), *range(200, 230)]) and sum(got[100 + i]["n_added"] > 0 for i in range(20)) == 20


# -- op 2 --------------------------------------------------------------------------------------------------


def brute_simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                up[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min((y for y in (least.get(root(i)), x) if y is not None), default=None)
    return [least[root(i)] for i in range(len(ids))]


def test_simhash(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_simhash(r["text"]) for r in rows]
    want = {r["doc_id"]: (f"{fp:016x}", c) for r, fp, c in zip(rows, fps, brute_components([r["doc_id"] for r in rows], fps))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash(docs).collect()}
    assert got == want


def test_simhash_links_in_dense_cells():
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(300):
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    fps = sorted(fps)
    code = simhash.embed(np.array(fps, "<u8"))
    for i, a in enumerate(fps[:60]):
        for j, b in enumerate(fps[:60]):
            assert int(code[i] ^ code[j]).bit_count() <= (a ^ b).bit_count()
    import pyarrow as pa

    cells = pa.Table.from_batches(simhash._cells([pa.RecordBatch.from_arrays([pa.array(np.array(fps, "<u8").view("<i8"))], ["fp"])])).combine_chunks()
    order = np.lexsort([cells.column(1).to_numpy(), cells.column(0).to_numpy()])
    cells = cells.take(pa.array(order))
    edges = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for batch in simhash._cell_links(3)(cells.to_batches(max_chunksize=37)) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    forest, want = simhash.Forest(), simhash.Forest()
    for a, b in edges:
        forest.join(a, b)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                want.join(a, b)
    assert [forest.root(x) for x in fps] == [want.root(x) for x in fps]


def test_simhash_survivors(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    df = frame(spark, (2, text, "a"), (1, text, "b"), (1, text, "b"), (3, "something else entirely with other words in it", "c"), (None, "no id but words of its own", "d"), (4, None, "e"), (5, "", "f"))
    got = simhash.simhash_survivors(df).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 3, 4] and len(got[0]) == 5


def test_simhash_survivors_of_unrelated_components(spark):
    texts = ["no id and words of its own in a row", "another row lacks its id and shares nothing here", "rain fell over hills while trains kept going south", "seven green boats drift slowly past a quiet harbour wall"]
    df = frame(spark, (None, texts[0], "a"), (None, texts[1], "a"), (None, texts[1], "b"), (3, texts[2], "a"), (3, texts[3], "a"))
    assert sorted(r["text"] for r in simhash.simhash_survivors(df).collect()) == sorted(texts)


def test_near_copies(spark):
    """Components against all pairs; SimHash within 3 bits links few of these."""
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(100, 300))]
        texts.append(" ".join(words))
        for share in (0.01, 0.02, 0.03, 0.04):
            texts.append(" ".join(f"v{rng.randrange(5000)}" if rng.random() < share else w for w in words))
    texts += ["", " ", "one", "one two three four", "One two  three four"]

    def parts(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [parts(t) for t in texts]
    up = simhash.Forest()
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b) - 1e-9]
    for i, j in near:
        up.join(i, j)
    df = frame(spark, *((i, t, "a") for i, t in enumerate(texts)))
    got = sorted(r["doc_id"] for r in nearcopies.near_survivors(df).collect())
    assert got == sorted({up.root(i) for i in range(len(texts))}) and len(near) > 50
    fps = [simhash.fingerprint(t.encode()) for t in texts]
    assert sum((fps[i] ^ fps[j]).bit_count() <= 3 for i, j in near) < len(near) / 2


def test_near_copies_meet_by_fingerprints(spark):
    """The SimHash step of near copies against all pairs of five-word fingerprints."""
    rng = random.Random(9)
    texts = ["", " ", "one", "One"]
    for _ in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(600)]
        for k in range(5):
            texts.append(" ".join(words[:300] + [f"v{k}"] * (k > 0) + words[300:]))
    texts += [texts[5] + " " + texts[5], texts[5].upper()]
    docs = nearcopies.sketches(frame(spark, *((i, t, "a") for i, t in enumerate(texts))))
    rows = {r["doc_id"]: r for r in docs.collect()}
    fps = {i: simhash.fingerprint(t.encode(), 5) for i, t in enumerate(texts)}
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in rows.items()} == fps
    want, got = simhash.Forest(), simhash.Forest()
    for i in range(2, len(texts)):
        for j in range(2, i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                want.join(i, j)
    by_node = {}
    for i in range(2, len(texts)):
        got.join(by_node.setdefault(rows[i]["node"], i), i)
    for r in nearcopies.simhash_pairs(docs).collect():
        got.join(by_node[r["a"]], by_node[r["b"]])
    assert [got.root(i) for i in range(2, len(texts))] == [want.root(i) for i in range(2, len(texts))] and len({want.root(i) for i in range(2, len(texts))}) < 20


def test_near_copies_of_hard_rows(spark):
    got = nearcopies.near_survivors(hard(spark)).collect()
    assert sorted((r["doc_id"] or 0, len(r["text"] or "") > 99) for r in got) == [(0, False), (1, False), (3, False), (3, True), (4, False), (5, False)]
    assert nearcopies.near_survivors(empty(spark)).count() == 0


# -- op 3 --------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), 1.5 * sum(sizes.values())
    while left > 1e-9 and len(full) < len(names):
        total = sum(weight[s] for s in names if s not in full)
        share = {s: left * weight[s] / total for s in names if s not in full}
        left = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
    return target


@pytest.mark.parametrize("bucket", [50_000, 7])
def test_mixing(spark, docs, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "FAN", 3)
    df = docs.unionByName(frame(spark, (900, None, None), (901, "a b c", None), (902, "", "src1"))).withColumn("size", F.lit(1))
    got = mixing.mix(df).collect()
    assert len(got) == df.count()
    sizes, taken, most = Counter(), Counter(), Counter()
    want = {(r["doc_id"]): len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in df.collect()}
    for r in got:
        assert r["size"] == want[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    target = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= most[s] for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=str)  # reruns agree


def test_trades_keep_expectations():
    rng = random.Random(2)
    size = [rng.randint(1, 50) for _ in range(9)]
    total, runs = np.zeros(9), 4000
    for seed in range(runs):
        x = [0.3] * 9
        out, held = mixing.trade(size, x, list(range(9)), seed)
        if held >= 0:
            out[held] = x[held]
        assert abs(sum(o * s for o, s in zip(out, size)) - 0.3 * sum(size)) < 1e-6
        total += out
    assert np.abs(total / runs - 0.3).max() < 0.04


# -- op 4 --------------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    count = Counter()
    for _, t in rows:
        data = (t or "").encode()
        count.update(data[i : i + length] for i in range(len(data) - length + 1))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for j in range(len(data) - length + 1):
            if count[data[j : j + length]] > 1:
                gone[j : j + length] = True
        starts = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(data), int(gone.sum()), starts, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, suffixes.op4_suffix_dedup(docs).collect()), key=str) == brute_repeats(rows, 200)


@pytest.mark.parametrize("bucket", [400_000, 60])
def test_repeats_at_the_edges(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    passage, exact, odd = word(260), word(200), word(199)
    rows = [(i, word(rng.randint(0, 300)) + passage[: rng.choice([200, 201, 230, 260])] + word(rng.randint(0, 300)), "s") for i in range(30)]
    rows += [(100, exact + word(5), "s"), (101, word(7) + exact, "s"), (102, odd, "s"), (103, odd, "s"), (104, "ab " * 300, "s"), (105, passage + word(3) + passage, "s"), (106, None, "s"), (107, "", "s"), (108, word(500), "s"), (108, "x" * 450, "s")]
    rows += [(110, "twice " + passage[:210], "s")] * 2 + [(None, word(100) + passage[30:240], "s")]
    df = frame(spark, *rows)
    assert sorted(map(tuple, suffixes.op4_suffix_dedup(df).collect()), key=str) == brute_repeats([(i, t) for i, t, _ in rows], 200)


def test_long_texts_are_hashed_in_pieces(spark, monkeypatch):
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    found = [suffixes.runs(piece) for s, piece in [(0, np.frombuffer(text.encode(), np.uint8))]][0]
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(found[0], found[1])])
    assert (windows == np.arange(len(text) - 199)).all()
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    covered = []
    for s, piece in suffixes._chunks(np.frombuffer(text.encode(), np.uint8), 200):
        p, q, *_ = suffixes.runs(piece)
        covered += [x + s for a, b in zip(p, q) for x in range(a, b + 1)]
    assert sorted(covered) == list(range(len(text) - 199))


def test_multikey_order():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 200), rng.integers(0, 5, 200)
    order = suffixes.multikey_order([a, b])
    assert [(a[i], b[i]) for i in order] == sorted(zip(a, b))


# -- op 5 --------------------------------------------------------------------------------------------------


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PER_CELL", 20)
    monkeypatch.setattr(embeddings, "BLOCK", 30)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    near = x[:80] + rng.normal(size=(80, 16)) * 0.05 * np.linalg.norm(x[:80], axis=1)[:, None]
    dense = x[399] + rng.normal(size=(150, 16)) * 0.02
    v = np.vstack([x, near, dense]).astype(np.float32).tolist() + [x[5].astype(np.float32).tolist()] * 3
    rows = [(i, e, 0) for i, e in enumerate(v)] + [(900, None, 0), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, None), (903, [1.0], 0), (None, v[0], 0), (904, [float("inf")] * 16, 0)]
    got = {r["vec_id"]: r for r in embeddings.op5_embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("k1", F.lit(1))).collect()}
    assert len(got) == len(rows)
    # the row without an id is a vector like any other: it counts in others' links, but names no component
    e = np.array(v + [v[0]], np.float64)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    link = e @ e.T >= 0.95
    np.fill_diagonal(link, False)
    ids = [*range(len(v)), None]
    n = np.array([got[i]["n_links"] for i in ids])
    assert (n <= link.sum(1)).all() and n.sum() >= 0.9 * link.sum()
    for i in range(len(v)):
        assert got[i]["component_id"] <= i and got[i]["kept"] == (got[i]["component_id"] == i)
        assert n[i] or got[i]["kept"]
    assert got[None]["component_id"] == 0 and not got[None]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (900, 901, 902, 903, 904))
    assert {got[i]["component_id"] for i in range(480, 630)} == {399}
    if n.sum() == link.sum():
        forest = simhash.Forest()
        for a, b in zip(*np.nonzero(link)):
            forest.join(int(a), int(b))
        assert [got[i]["component_id"] for i in ids] == [forest.root(i) for i in range(len(ids))]


def test_embedding_links_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embeddings.op5_embedding_dedup(spark.createDataFrame([], schema)).count() == 0
    assert embeddings.op5_embedding_dedup(spark.createDataFrame([(1, None, 0)], schema)).first()["kept"]


# -- op 7 --------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = table(spark, d, "labels")
    got = quality.quality_scores(table(spark, d, "documents"), labels)
    import zlib

    rows = got.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.93 * len(out)
    assert got.count() == 1000


def test_quality_without_two_labels(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality_scores(docs, labels).select("score").distinct().collect()} == {2 / 3}
    assert quality.quality_scores(empty(spark), labels).count() == 0


# -- ops 6, 8, 10 against SQL --------------------------------------------------------------------------------


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toPandas())
    cols = sorted(df.columns)
    res = con.execute(sql)
    at = [x[0] for x in res.description]
    want = sorted(([r[at.index(c)] for c in cols] for r in res.fetchall()), key=str)
    got = sorted(([r[c] for c in cols] for r in df.collect()), key=str)
    assert str(got) == str(want)
    return got


def test_licenses(spark, docs):
    texts = [licenses.TEMPLATES["MIT-text"][1], "intro\n\n" + licenses.TEMPLATES["BSD-2-text"][1].replace(" with", "\nwith") + "\n\nend", "LICENSED under the Apache Licence, version 2.0", "Released under the MIT License. And more words that follow it here", "under CC BY 4.0", None, "", "License"]
    df = docs.unionByName(frame(spark, *((1000 + i, t, "s") for i, t in enumerate(texts)), (1001, texts[1], "s")))
    got = same(licenses.op6_license_scan(df), licenses.SQL, documents=df)
    assert {1000, 1001, 1002, 1004} <= {r[1] for r in got} and not {1003, 1005, 1006, 1007} & {r[1] for r in got}


def test_whole_licenses(spark, docs):
    t = {n: x for n, (_, x) in licenses.TEMPLATES.items()}
    mit = "MIT License\n\nCopyright (c) 2021 Example Authors\n\n" + t["MIT-text"] + "\n\n" + t["MIT-warranty"]
    texts = [mit, t["MIT-full"], t["BSD-3-full"].replace(" 1. ", "\n1. ").replace(" 2. ", "\n2. ").replace(" 3. ", "\n3. "), t["GPL-2.0-header"], "Copyright 2021 Example Authors. " + t["ISC-full"]]
    df = docs.unionByName(frame(spark, *((1000 + i, x, "s") for i, x in enumerate(texts))))
    got = same(licenses.op6_license_scan(df), licenses.SQL, documents=df)
    names = lambda i: {r["template"] for r in licenses.license_matches(df).where(F.col("doc_id") == i).collect()}
    assert names(1000) == {"MIT-text", "MIT-warranty"} and names(1001) == {"MIT-full"} and "BSD-3-full" in names(1002)
    assert names(1003) == {"GPL-2.0-header"} and names(1004) == {"ISC-full"} and len(got) >= 7


def test_licenses_in_sentences(spark):
    texts = ["Copyright 2021 Example Authors. Licensed under the Apache License, Version 2.0.", "Before it. Released under the MIT License. And more words that follow it here", "No word of the kind. Nor here.", None, ""]
    df = frame(spark, *((i, x, "s") for i, x in enumerate(texts)))
    got = licenses.license_matches(df, sentences=True).collect()
    assert {(r["doc_id"], r["kind"], r["passage"], r["template"]) for r in got} == {(0, "sentence", 1, "Apache-2.0-notice"), (1, "sentence", 1, "MIT-notice")}


def test_telling_words_lose_no_template():
    for name, (_, text) in licenses.TEMPLATES.items():
        own = licenses._bigrams(text)
        rest = sum(not set(b.split()) & set(licenses.telling()) for b in own)
        assert 2 * rest / (rest + len(own)) < licenses.THRESHOLD, name


def test_decontamination_of_items_without_id(spark):
    item = "seven words of a benchmark item without any id"
    docs = frame(spark, (1, f"before it {item} and after", "a"), (2, "nothing of the kind is held by this other text", "a"))
    bench = spark.createDataFrame([(None, item), (5, "some other question that no document here holds at all")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["n_shared"]) for r in decontam.op8_decontamination(docs, bench).collect()] == [(1, None, 5)]
    assert [r["doc_id"] for r in decontam.decontaminated(docs, bench).collect()] == [2]


def test_oracles_are_sql():
    from casegraph.llm import registry

    assert all(isinstance(x, str) for x in registry.ORACLES.values())


def test_decontamination(spark, docs):
    bench = table(spark, SMALL, "benchmark")
    items = bench.collect()
    words = items[0]["text"].split()
    cut = " ".join(words[: int(len(words) * 0.9)])
    more = [(1000, "x " * 5000 + items[1]["text"].upper() + " y" * 5000, "s"), (1001, cut, "s"), (1002, " ".join(words[: len(words) // 2]), "s"), (1003, None, "s"), (1004, "", "s"), (1000, "x " * 5000 + items[1]["text"].upper() + " y" * 5000, "s"), (1005, "four words are few", "s")]
    df = docs.unionByName(frame(spark, *more))
    odd = bench.unionByName(spark.createDataFrame([(5000, None), (5001, "too short"), (5002, "four words are few")], bench.schema))
    got = same(decontam.op8_decontamination(df, odd), decontam.SQL, documents=df.dropDuplicates(["doc_id", "text"]), benchmark=odd)
    ids = {(r[1], r[2]) for r in got}
    assert (1000, items[1]["item_id"]) in ids and (1001, items[0]["item_id"]) in ids and not {i for i, _ in ids} & {1002, 1003, 1004, 1005}
    kept = decontam.decontaminated(df, odd)
    assert kept.columns == df.columns and kept.count() == df.count() - sum(r["doc_id"] in {i for i, _ in ids} for r in df.collect())


def test_revisits(spark):
    pages = table(spark, SMALL, "pages")
    same(warc.op10_warc_revisits(pages), warc.SQL, pages=pages)
    hot = pages.withColumn("url", F.when(F.col("page_id") % 3 > 0, F.lit("http://www.Hot.example.com:80/a/?b=1&a=2&utm_source=x")).otherwise(F.col("url")))
    e = F.array_sort(F.transform(F.map_entries("headers"), lambda x: F.concat_ws("=", x["key"], x["value"])))
    got = warc.resolve_revisits(warc.crawl(hot), 7).select("record_id", "canonical_url", "refers_to", "outcome", F.array_join(e, ";").alias("headers"))
    same(got, warc.SQL, pages=hot)


def test_revisits_hard(spark):
    cols = "record_id long, url string, ts long, record_type string, status int, headers map<string,string>, extra string"
    rows = [
        (1, "http://a.example/", 10, "response", 200, {"ETag": '"x"', "Content-Type": "t", "Age": "1"}, "e"), (2, "HTTPS://www.A.example#f", 20, "revisit", 304, {"etag": 'W/"x"', "content-length": "0", "AGE": "2"}, None),
        (3, "http://a.example", 5, "revisit", 304, {"etag": '"x"'}, None), (4, "http://a.example", 30, "response", 500, None, None), (5, "http://a.example", 40, "revisit", 304, {"etag": '"y"'}, None),
        (6, None, 50, "revisit", 304, None, None), (7, "http://a.example/", None, "revisit", 304, None, None), (8, "http://a.example/", 60, "revisit", 304, None, None),
    ]
    got = {r["record_id"]: (r["refers_to"], r["outcome"], r["headers"]) for r in warc.resolve_revisits(spark.createDataFrame(rows, cols), 2).collect()}
    assert got[2] == (1, "resolved", {"etag": 'W/"x"', "content-type": "t", "age": "2"})
    assert got[3][:2] == (None, "missing") and got[5][:2] == (1, "mismatch") and got[5][2] == {"etag": '"y"'}
    assert got[6][:2] == (None, "missing") and got[7][:2] == (None, "missing") and got[8][:2] == (1, "unchecked")
    assert warc.resolve_revisits(spark.createDataFrame([], cols)).count() == 0


# -- op 9 --------------------------------------------------------------------------------------------------


def diff(a, b):
    """Positions that a patience diff aligns: equal ends, then lines that both sides hold once, in longest increasing order,
    then the gaps between them; a gap without such lines is aligned by a longest common subsequence. 0 is no line."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head) if a[i]] + [(len(a) - 1 - i, len(b) - 1 - i) for i in range(tail) if a[len(a) - 1 - i]]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    once = [(i, y.index(h)) for i, h in enumerate(x) if h and x.count(h) == 1 and y.count(h) == 1]
    if once:
        # longest increasing subsequences by patience piles, read back from the last pile
        piles, back = [], {}
        for i, j in once:
            k = sum(p[-1][1] < j for p in piles)
            back[i, j] = piles[k - 1][-1] if k else None
            piles[k : k + 1] = [(piles[k] if k < len(piles) else []) + [(i, j)]]
        chain, at = [], piles[-1][-1]
        while at:
            chain.append(at)
            at = back[at]
        i = j = 0
        for p, q in [*reversed(chain), (len(x), len(y))]:
            out += [(head + i + u, head + j + v) for u, v in diff(x[i:p], y[j:q])]
            out += [(head + p, head + q)] * (p < len(x))
            i, j = p + 1, q + 1
    elif x and y:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if u == v and u else max(best[i][j + 1], best[i + 1][j])
        i, j = len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((head + i, head + j))
    return sorted(out)


def brute_lines(rows):
    """By document: its lines, the long lines that any earlier document that shares a long line aligns, and all lines of the
    aligned blocks that hold a long line."""
    bare = lambda x: x.strip("\t\n\x0b\x0c\r ")
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    lines = [(r[1] or "").split("\n") for r in rows]
    hashed = [[bare(x) for x in t] for t in lines]
    long_ = [{x for x, full in zip(h, t) if len(full.split()) >= 5} for h, t in zip(hashed, lines)]
    out = {}
    for k, r in enumerate(rows):
        anchors, most = {i for i, x in enumerate(lines[k]) if len(x.split()) >= 5}, set()
        for e in range(k):
            if long_[e] & long_[k]:
                run, before = [], (-2, -2)
                for x, y in [*diff(hashed[e], hashed[k]), (-9, -9)]:
                    if (x, y) != (before[0] + 1, before[1] + 1):
                        most |= set(run) if set(run) & anchors else set()
                        run = []
                    run.append(y)
                    before = (x, y)
        out[r[0]] = (lines[k], most & anchors, most)
    return out


def test_line_dedup(spark, docs):
    """The long lines that go are those of all overlapping pairs; short ones go with some of them."""
    want = brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    runs = {r["doc_id"]: {i for x in r["runs"] for i in range(x["s"], x["e"])} for r in linedup.deletions(docs).collect()}
    for i, (lines, long_, most) in want.items():
        gone = runs.get(i, set())
        assert long_ <= gone <= most, i
    got = {r["doc_id"]: (r["n_lines"], r["n_deleted"], r["kept_sha256"]) for r in linedup.op9_line_dedup(docs).collect()}
    kept = lambda i: "\n".join(x for j, x in enumerate(want[i][0]) if j not in runs.get(i, set()))
    assert got == {i: (len(want[i][0]), len(runs.get(i, set())), hashlib.sha256(kept(i).encode()).hexdigest()) for i in want}
    assert sum(len(x[1]) for x in want.values())


def test_line_dedup_alignment(spark):
    a, b, c = "the first line of the text here", "a second line of the same text", "and then a third line of it"
    rows = [(1, "\n".join([a, "x", b, c]), "s"), (2, "\n".join(["new", a, "x", "mine alone is this line", c]), "s"), (3, "x\nnew", "s"), (4, None, "s"), (5, "", "s"), (6, "\n".join([c, a]), "s"), (7, a, "s"), (7, a, "s")]
    got = {r["doc_id"]: r["text"] for r in linedup.line_deduplicated(frame(spark, *rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "new\nmine alone is this line" and got[3] == "x\nnew" and got[4] is None and got[5] == "" and got[7] == ""
    assert got[6] in (a, c)  # crossing lines don't align


def test_patience_is_an_alignment():
    rng = random.Random(6)
    for _ in range(300):
        x, y = ([rng.randint(0, 6) for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = linedup.patience(x, y)
        assert all(x[i] == y[j] != 0 for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert linedup.patience([1, 2, 3, 4], [1, 2, 3, 4]) == [(i, i) for i in range(4)]


def test_line_dedup_meets_every_holder(spark):
    """Deleted long lines against the alignments of all overlapping pairs."""
    rng = random.Random(11)
    names = [f"line number {i} of the common stock" for i in range(6)]
    p = names[0]
    rows = [(1, f"x\n{p}\ny\n{p}\nz"), (2, f"q\n{p}\nr"), (3, f"s\n{p}\nt"), (4, "\n".join(["a", *names[1:3] * 2, "b"])), (5, "\n".join(["c", *names[1:3] * 2, "d"]))]
    rows += [(6 + i, "\n".join([f"u{i}", *rng.choices(names, k=rng.randint(1, 6)), f"e{i}"])) for i in range(40)]
    lines = {i: t.split("\n") for i, t in rows}
    number = {x: i + 1 for i, x in enumerate(sorted({x for t in lines.values() for x in t}))}
    want = {}
    for i, t in lines.items():
        gone = set()
        for e in range(1, i):
            if set(lines[e]) & set(t) & set(names):
                gone |= {y for _, y in linedup.patience([number[x] for x in lines[e]], [number[x] for x in t]) if t[y] in names}
        want[i] = "\n".join(x for y, x in enumerate(t) if y not in gone)
    got = {r["doc_id"]: r["text"] for r in linedup.line_deduplicated(frame(spark, *((i, t, "s") for i, t in rows))).collect()}
    assert got == want and got[3] == "s\nt" and got[5] == "c\nd"


def test_common_subsequences_in_halves(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (rng.integers(0, 4, rng.integers(0, 20)) for _ in range(2))
        whole = linedup.common(a, b)
        monkeypatch.setattr(linedup, "CELLS", 8)
        halves = linedup.common(a, b)
        monkeypatch.undo()
        assert len(halves) == len(whole) and all(a[i] == b[j] for i, j in halves) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(halves, halves[1:]))


# -- all -----------------------------------------------------------------------------------------------------


def test_hard_and_empty_tables(spark):
    bench, labels = table(spark, SMALL, "benchmark"), table(spark, SMALL, "labels")
    for df in (hard(spark), empty(spark)):
        n = df.count()
        assert pii.op1_pii(df).count() == n
        assert simhash.op2_simhash(df).count() == n
        assert mixing.op3_mixing(df).count() == n
        assert suffixes.op4_suffix_dedup(df).count() == n
        assert licenses.op6_license_scan(df).count() == 0
        assert quality.quality_scores(df, labels).count() == n
        assert decontam.op8_decontamination(df, bench).count() == 0
        assert linedup.op9_line_dedup(df).count() == n


def test_pipeline(spark):
    import corpus_pipeline as p

    names = [n for n, _ in p.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "decontamination", "mixing"] and p.ORACLE_SQL is None
    got = p.run(spark, SMALL).collect()
    docs = table(spark, SMALL, "documents")
    assert 0 < len(got) <= docs.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    df = hard(spark).withColumn("more", F.lit(1))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, df, SMALL)
        assert out.columns == df.columns, name
        assert out.count() <= df.count()
        assert stage(spark, empty(spark), SMALL).count() == 0
    assert p.mix_sources(spark, df, SMALL).count() == df.count()
