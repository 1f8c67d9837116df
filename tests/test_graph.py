import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegraph.operators import assess, correlate, enrich, extract, govern, graph, network, resolve, risk, transforms
from casegraph.operators.components import connected_components, middles, numbered
from casegraph.sources import readers

ROWS = "kind string, label string, dedup_key string, attributes map<string,string>, tags array<string>, sources array<string>, sensitive boolean, ord long"
EDGES = "source_id string, rel_type string, target_id string, confidence double, source_reference string, ord long"


def entities(spark, *rows):
    made = [(k, label, f"{k}::{label.lower()}", a, t, s, False, i) for i, (k, label, a, t, s) in enumerate(rows)]
    return graph.upsert_entities(spark.createDataFrame(made, ROWS))


def edges(spark, *rows):
    return spark.createDataFrame([(a, r, b, 0.5, None, i) for i, (a, r, b) in enumerate(rows)], EDGES)


def test_upsert_first_wins(spark):
    e = entities(spark, ("person", "Ann", {"a": "1"}, ["x"], ["s1"]), ("person", "ANN", {"a": "2", "b": "3"}, ["y", "x"], ["s2", "s1"])).first()
    assert (e["label"], e["attributes"], e["tags"], e["sources"]) == ("Ann", {"a": "1", "b": "3"}, ["x", "y"], ["s1", "s2"])


def test_edges_once_and_clamped(spark):
    df = spark.createDataFrame([("a", "r", "b", 1.5, "first", 1), ("a", "r", "b", 0.2, "second", 2)], EDGES)
    assert [(r["confidence"], r["source_reference"]) for r in graph.add_edges(df).collect()] == [(1.0, "first")]


def test_degrees_count_parallel_edges_and_loops(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {r["id"]: r["degree"] for r in graph.degrees(e, edges(spark, ("a", "x", "b"), ("a", "y", "b"), ("a", "z", "a"))).collect()}
    assert got == {"a": 4, "b": 2, "c": 0}


def metrics(spark, n, pairs):
    nodes = spark.createDataFrame([(str(i), i) for i in range(n)], "id string, ord long")
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string")
    return {int(r["id"]): r for r in network.analyze(nodes, df).collect()}, nodes, df


@pytest.mark.parametrize(
    ("n", "pairs", "between", "rank", "community"),
    [
        (4, [(0, 1), (1, 2), (2, 3)], [0, 1, 1, 0], [0.541, 1, 1, 0.541], [0, 0, 0, 0]),
        (5, [(0, 1), (0, 2), (0, 3), (0, 4)], [1, 0, 0, 0, 0], [1, 0.276, 0.276, 0.276, 0.276], [0] * 5),
        (7, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)], [0, 0, 1, 1, 0, 0, 0], [0.702, 0.702, 1, 1, 0.702, 0.702, 0.12], [0] * 6 + [1]),
    ],
)
def test_micro_graphs(spark, n, pairs, between, rank, community):
    got, *_ = metrics(spark, n, pairs)
    assert [got[i]["betweenness"] for i in range(n)] == between
    assert [round(got[i]["pagerank"], 3) for i in range(n)] == rank
    assert [got[i]["community"] for i in range(n)] == community


def test_large_components_agree(spark):
    pairs = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    exact, nodes, df = metrics(spark, 7, pairs)
    got = {int(r["id"]): r for r in network.analyze(nodes, df, max_nodes=3).collect()}
    for i in range(7):
        assert abs(got[i]["pagerank"] - exact[i]["pagerank"]) < 1e-9
        assert abs(got[i]["betweenness"] - exact[i]["betweenness"]) < 1e-9  # seven pivots or more are all nodes
    assert not got[0]["exact"] and got[6]["exact"]


def test_large_components_whole(spark):
    edges_ = [(0, 3), (0, 7), (1, 3), (1, 8), (2, 3), (2, 9), (3, 4), (4, 10), (5, 7), (5, 8), (6, 9), (6, 10), (7, 8), (9, 10), (12, 13), (12, 14), (12, 15)]
    exact, nodes, df = metrics(spark, 16, edges_)
    got = {int(r["id"]): r for r in network.analyze(nodes, df, max_nodes=3, pivots=None, at_once=10).collect()}
    for i in range(16):
        assert got[i]["exact"] and got[i]["community"] == exact[i]["community"], i
        assert abs(got[i]["betweenness"] - exact[i]["betweenness"]) < 1e-9 and abs(got[i]["pagerank"] - exact[i]["pagerank"]) < 1e-9


def test_trees_are_folded(spark):
    """A component beyond MAX_NODES that is small once its outermost nodes are folded is worked on whole."""
    n = network.MAX_NODES + 1_000
    pairs = [(0, 1), (1, 2)] + [(i % 3, i) for i in range(3, n)]
    nodes = spark.range(n).selectExpr("cast(id AS string) AS id", "id AS ord")
    got = {int(r["id"]): r for r in network.analyze(nodes, spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string")).collect()}
    sizes = [(n + 2) // 3, (n + 1) // 3, n // 3]
    raw = [((n - 1) ** 2 - (x - 1) - (n - x) ** 2) / 2 for x in sizes]
    raw[1] += sizes[0] * sizes[2]
    assert all(got[i]["exact"] for i in range(n)) and [got[i]["community"] for i in range(n)] == [got[i % 3]["community"] for i in range(n)]
    assert [round(got[i]["betweenness"], 9) for i in (0, 1, 2, 3, n - 1)] == [round(x / max(raw), 9) for x in (*raw, 0, 0)]


@pytest.mark.parametrize("max_nodes", [17, 3])
def test_trees_agree_with_whole_components(spark, max_nodes):
    """Rings with trees, folded and gathered or by joins, against the plain functions over all nodes."""
    n, rng = 24, np.random.default_rng(5)
    ring = [(i, i + 4) for i in range(0, 20, 4)] + [(0, 20), (4, 16), (0, 12)]
    trees = [(1, 0), (2, 0), (3, 0), (5, 4), (6, 5), (7, 5), (9, 8), (10, 9), (11, 9), (13, 12), (14, 12), (15, 16), (17, 15), (18, 15), (19, 20), (21, 20), (22, 20), (23, 20)]
    turn = rng.permutation(n)  # names and turns differ
    pairs = [(turn[a], turn[b]) for a, b in ring + trees]
    nodes = spark.createDataFrame([(str(99 - i), i) for i in range(n)], "id string, ord long")
    df = spark.createDataFrame([(str(99 - a), str(99 - b)) for a, b in pairs], "a string, b string")
    got = {99 - int(r["id"]): r for r in network.analyze(nodes, df, max_nodes=max_nodes, pivots=None, at_once=4).collect()}
    starts, ends = network.adjacency_rows(n, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    between, label, rank, degree = network.betweenness(starts, ends), network.communities(starts, ends), np.full(n, 1 / n), np.diff(starts)
    for _ in range(network.ROUNDS):
        rank = 0.15 / n + 0.85 * np.bincount(ends, np.repeat(rank / degree, degree), n)
    for i in range(n):
        assert got[i]["exact"] and abs(got[i]["betweenness"] - between[i] / between.max()) < 1e-9 and abs(got[i]["pagerank"] - rank[i] / rank.max()) < 1e-9
        assert [got[j]["community"] == got[i]["community"] for j in range(n)] == (label == label[i]).tolist()


@pytest.mark.parametrize("max_nodes", [5_000, 40, 3])
def test_brokers_agree_with_plain_betweenness(spark, max_nodes):
    """Rings with trees, a path, a star, a pair and a node alone: gathered at once, gathered without trees, and by joins."""
    ring = [(i, i + 4) for i in range(0, 20, 4)] + [(0, 20), (4, 16), (0, 12)]
    trees = [(1, 0), (2, 0), (3, 0), (5, 4), (6, 5), (7, 5), (9, 8), (10, 9), (11, 9), (13, 12), (14, 12), (15, 16), (17, 15), (18, 15), (19, 20), (21, 20), (22, 20), (23, 20)]
    rest = [(i, i + 1) for i in range(24, 32)] + [(33, i) for i in range(34, 39)] + [(39, 40), (42, 43), (43, 44), (42, 44), (44, 45), (45, 46)]
    n = 47
    turn = np.random.default_rng(5).permutation(n)  # names and turns differ
    pairs = [(turn[a], turn[b]) for a, b in ring + trees + rest]
    nodes = spark.createDataFrame([(str(99 - i), i) for i in range(n)], "id string, ord long")
    df = spark.createDataFrame([(str(99 - a), str(99 - b)) for a, b in pairs], "a string, b string")
    got = {99 - int(r["id"]): r["betweenness"] for r in network.brokers(nodes, df, max_nodes=max_nodes, at_once=8).collect()}
    want = network.betweenness(*network.adjacency_rows(n, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])))
    assert len(got) == n and all(abs(got[i] - want[i] / want.max()) < 1e-9 for i in range(n))
    empty = network.brokers(nodes, df.limit(0))
    assert empty.count() == n and network.top_broker(empty).count() == 0


def test_top_broker_seeks_no_components_of_trees(spark, monkeypatch):
    """The places are trees: the query takes their nodes off and needs neither components nor ranks of all nodes."""
    from casegraph.plans import adapters, graph_queries

    d = "/root/testdata/sf0.001"
    nodes = sorted((r["ord"], r["id"]) for r in adapters.place_nodes(spark, d).collect())
    place = {name: i for i, (_, name) in enumerate(nodes)}
    pairs = [(place[r["a"]], place[r["b"]]) for r in adapters.place_pairs(spark, d).collect()]
    between = network.betweenness(*network.adjacency_rows(len(nodes), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])))
    monkeypatch.setattr(network, "connected_components", None)
    assert [tuple(r) for r in graph_queries.q_top_broker(spark, d).collect()] == [(nodes[between.argmax()][1], 1.0)]


def test_brokerage_equals_betweenness():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 12, 30):
        for extra in (0, 2, 9):
            pairs = {(int(rng.integers(i)), i) for i in range(1, n)} | {tuple(sorted(map(int, rng.choice(n, 2, False)))) for _ in range(extra) if n > 1}
            a, b = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
            starts, ends = network.adjacency_rows(n, a, b)
            assert np.allclose(network.brokerage(starts, ends, np.ones(n), np.zeros(n)), network.betweenness(starts, ends))


def test_empty_graph(spark):
    nodes = spark.createDataFrame([], "id string, ord long")
    assert network.analyze(nodes, spark.createDataFrame([], "a string, b string")).count() == 0
    assert network.modularity(spark.createDataFrame([], "a string, b string"), spark.createDataFrame([], "id string, community long")).first()["modularity"] == 0


def test_components_and_numbers(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["rep"] for r in connected_components(e).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    rows = spark.createDataFrame([(x,) for x in "dbca"], "k string")
    assert sorted((r["k"], r["n"]) for r in numbered(rows, ["k"], "n").collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_link_prediction_square(spark):
    e = edges(spark, ("0", "x", "2"), ("0", "x", "3"), ("1", "x", "2"), ("1", "x", "3"))
    got = [(r["a"], r["b"], r["common"], round(r["score"], 4)) for r in network.predict_links(e).collect()]
    assert got == [("0", "1", 2, round(2 / math.log(2), 4)), ("2", "3", 2, round(2 / math.log(2), 4))]
    assert [round(r["confidence"], 6) for r in network.predicted_edges(network.predict_links(e)).collect()] == [0.7, 0.7]


def test_hubs_beyond_the_limit_say_nothing(spark):
    ids = [f"p{i}" for i in range(13)]
    e = spark.createDataFrame([("h", "ip", "1.1.1.1"), ("g", "ip", "2.2.2.2"), *((i, "account", i) for i in ids)], "id string, kind string, label string")
    out = correlate.shared_hubs(e, edges(spark, *((i, "x", "h") for i in ids), *((i, "x", "g") for i in ids[:3])))
    assert out.count() == 3 and {r["source_reference"] for r in out.collect()} == {"shared:2.2.2.2"}


def test_near_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(5)
    pts = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [(200 + i, 60 + rng.uniform(0, 0.2), 179.9 + rng.uniform(0, 0.2)) for i in range(30)] + [(300 + i, 89.99 + rng.uniform(0, 0.009), rng.uniform(-180, 180)) for i in range(20)]
    pts = [(i, a, b - 360 if b > 180 else b) for i, a, b in pts]

    def km(p, q):
        a, b = math.radians(p[1]), math.radians(q[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))

    want = {(p[0], q[0]) for p in pts for q in pts if p[0] < q[0] and km(p, q) <= 5}
    got = [(r["a"], r["b"]) for r in correlate.near_pairs(spark.createDataFrame(pts, "id long, lat double, lon double")).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20


def test_similar_texts_lose_nothing(spark):
    import random

    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(4, 16))).strip() or "x" for _ in range(40)]
    texts = {t for b in base for t in (b, b[:3] + "z" + b[4:], b[1:], b + "q") if t}

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    want = {(a, b) for a in texts for b in texts if a < b and 1 - lev(a, b) / max(len(a), len(b)) >= 0.8}
    got = {(r["x"], r["y"]) for r in correlate.similar_texts(spark.createDataFrame([("k", t) for t in texts], "kind string, text string"), 0.8, tokens=False).collect()}
    assert want <= got and want


def test_close_pairs_in_blocks_and_pieces(spark, monkeypatch):
    """Names that differ in digits are compared in blocks, other kinds and long texts by pieces: every close pair once, none else."""
    rng = np.random.default_rng(2)
    long_ = "x" * 30 + "Supplier" * 4
    dense = [f"Supplier#{i:07d}"[: 16 - i % 3] for i in range(0, 4_000, 29)] + ["Supplier#", "Supplies#0000", long_ + "ab", long_ + "abcde", long_[:60], "é" + long_ + "ab"]
    loose = ["".join(chr(97 + c) for c in rng.integers(0, 20, 12)) for _ in range(60)]
    rows = [("organization", t) for t in dict.fromkeys(dense)] + [("person", t) for t in loose + [t[:5] + "Z" + t[6:] for t in loose[:9]]]
    items = [(k, i, t) for i, (k, t) in enumerate(rows)]

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    want = {}
    for k, i, x in items:
        for m, j, y in items:
            if k == m and i < j and x != y and abs(len(x) - len(y)) <= 14 and (sim := 1 - lev(x, y) / max(len(x), len(y))) >= 0.86:
                want[i, j] = sim
    df = spark.createDataFrame(items, "kind string, no long, text string")
    proposed, texts = [], correlate.similar_texts
    monkeypatch.setattr(correlate, "BLOCK", 50)
    monkeypatch.setattr(correlate, "similar_texts", lambda *a, **k: proposed.append(texts(*a, **k)) or proposed[-1])
    got = [((r["a"], r["b"]), r["sim"]) for r in correlate.close_pairs(df, 0.86).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert len(want) > 300 and proposed[0].where("kind = 'organization'").count() < 20  # pieces proposed nearly all pairs


def test_identity_signals_once(spark):
    """A pair that several signals propose comes once with all of them; other pairs by the signal that they have."""
    a = lambda **k: k
    rows = [("person", "ann.lee@x.example", a(phone="1", address="Q")), ("person", "ann.lee@y.example", a(phone=" 1 ", address="q")), ("person", "Bo", a(address="q")), ("account", "ann.lee@z.example", a(phone="1")), ("device", "Bo", a(phone="1"))]
    e = entities(spark, *((k, n, v, [], []) for k, n, v in rows))
    label = {r["id"]: r["label"] for r in e.collect()}
    got = sorted((*sorted((label[r["canonical_id"]], label[r["alias_id"]])), r["confidence"], r["signals"]) for r in resolve.scored_pairs(e, edges(spark)).collect())
    x, y = "ann.lee@x.example", "ann.lee@y.example"
    sim = 1 - 1 / 17
    assert got == [("Bo", x, 0.85, ["matching address"]), ("Bo", y, 0.85, ["matching address"]), (x, y, sim, ["label similarity 94%", "same mail name ann.lee", "matching phone", "matching address"])]


def test_identity_strong_and_weak(spark):
    e = entities(spark, *(("person", n, {}, [], ["s"]) for n in ("Alexandre Silva", "Alexandre Silvaa", "Alexandre Silvva")), ("device", "d1", {}, [], ["s"]))
    ids = {r["label"]: r["id"] for r in e.collect()}
    links = edges(spark, *((ids[n], "uses_device", ids["d1"]) for n in ids if n != "d1"))
    done = resolve.resolve_identities(e, links).collect()
    assert sum(r["decision"] == "merged" for r in done) == 2 and all(r["confidence"] == 1.0 for r in done)
    merged, kept = graph.merge_entities(e, links, spark.createDataFrame([(r["canonical_id"], r["alias_id"]) for r in done if r["decision"] == "merged"], "canonical_id string, alias_id string"))
    people = merged.where("kind = 'person'").collect()
    assert len(people) == 1 and len(people[0]["label"]) == 16 and people[0]["tags"] == ["resolved-identity"] and kept.count() == 1
    weak = entities(spark, ("person", "John Smith", {}, [], []), ("person", "Jon Smyth", {}, [], []))
    assert resolve.resolve_identities(weak, edges(spark)).count() == 0


def test_documents_veto(spark):
    e = entities(spark, ("person", "Ann Marie Lee", {"document_id": "1"}, [], []), ("person", "Ann Marie Leee", {"document_id": "2"}, [], []))
    got = resolve.resolve_identities(e, edges(spark)).collect()
    assert [(r["decision"], round(r["confidence"], 2)) for r in got] == [("suggested", 0.81)]


def records(spark, *rows):
    return spark.createDataFrame([(0, "f.csv", i, list(r), r, None) for i, r in enumerate(rows)], readers.SCHEMA)


def test_extract_and_links(spark):
    r = records(spark, {"Full_Name": "Ann Lee", "email": "ann@mail.example", "city": "Oslo", "notes": "see 10.0.0.1 and 10.0.0.1", "cpf": "1-2"})
    x = extract.extract_entities(r)
    got = {(e["kind"], e["label"]) for e in x.collect()}
    assert got == {("person", "Ann Lee"), ("account", "ann@mail.example"), ("location", "Oslo"), ("ip", "10.0.0.1"), ("domain", "mail.example")}
    keys = {e["kind"]: e["dedup_key"] for e in x.collect()}
    assert keys["person"] == "person::ann lee::12" and keys["location"] == "location::oslo"
    rel = {(e["rel_type"]) for e in extract.infer_links(x).collect()}
    assert rel == {"owns_account", "resides_in", "logged_in_from_ip", "uses_email_domain"}


def test_extract_sensitive_geojson_and_mappings(spark):
    r = records(spark, {"victim_id": "V 1"}, {"geometry.coordinates.0": "2", "geometry.coordinates.1": "1", "properties.name": "Site", "type": "Feature"}, {"box": "acme"}, {})
    x = extract.extract_entities(r, [("box", "organization")]).collect()
    assert sorted((e["kind"], e["label"].split(":")[0]) for e in x) == [("facility", "Site"), ("organization", "acme"), ("victim", "victim")]
    org = next(e for e in x if e["kind"] == "organization")
    assert org["sources"] == ["f.csv#2:box"] and org["attributes"] == {"derived_from_column": "box"}


def test_profile(spark):
    df = spark.createDataFrame([(0, "Ann Lee", "a@b.example", "10.0.0.1", "Oslo", "Acme"), (1, "Bo Dahl", "c@b.example", "10.0.0.2", "Bergen", "Beta")], "row long, holder string, contact string, logged_from string, origin_city string, company string")
    p = {r["name"]: (r["semantic"], r["kind"], r["is_primary"]) for r in extract.profile_columns(extract.cells_of(df, "row")).collect()}
    assert p["holder"] == ("person_name", "person", True) and p["contact"][:2] == ("email", "account") and p["logged_from"][:2] == ("ip", "ip")
    assert p["origin_city"][:2] == ("location", "location") and p["company"][:2] == ("organization", "organization")


def test_references(spark):
    groups = spark.createDataFrame([(["AA" * 16], None, "feed", "bad", None, 0), (["00ff00ff00ff00ff"], "perceptual", "near", "bad", "low", 1)], "values array<string>, kind string, source string, category string, severity string, ord long")
    refs = enrich.load_refs(groups)
    e = entities(spark, ("media", "m1", {"file_hash": "aa" * 16}, [], []), ("media", "m2", {"perceptual_hash": "00ff00ff00ff00fe"}, [], []), ("media", "m3", {"perceptual_hash": "ffffffffffffffff"}, [], []))
    got = {r["label"]: r for r in enrich.mark_refs(e, enrich.match_refs(e, refs)).collect()}
    assert got["m1"]["attributes"]["ref_match"] == "exact" and got["m1"]["tags"] == ["known-file-hash", "high"] and got["m1"]["sources"] == ["ref:feed"]
    assert got["m2"]["attributes"]["ref_similarity"] == "0.98" and "ref_source" not in got["m3"]["attributes"]


def test_risk_and_feedback(spark):
    e = entities(spark, ("person", "Ann", {"note": "inactive"}, [], []), ("victim", "v", {}, [], []))
    ids = {r["kind"]: r["id"] for r in e.collect()}
    m = graph.degrees(e, edges(spark, (ids["person"], "x", ids["victim"]))).withColumns({"betweenness": F.lit(0.0), "anomaly_score": F.lit(None).cast("double"), "adjustment": F.lit(0.0)})
    r = {x["kind"]: x for x in risk.score_risk(e, m, edges(spark, (ids["person"], "x", ids["victim"])), "child-protection").collect()}
    assert "signal:active" in r["person"]["top_factors"]  # substrings count
    assert round(r["person"]["base"], 6) == 0.7 and round(r["person"]["risk_score"], 6) == round(0.7 + 0.18 * 0.85, 6)
    assert r["victim"]["recommended_action"] == "prioritize_victim_identification" and "1 matched" in r["person"]["explanation"]
    f = spark.createDataFrame([("kind:person", 1.0, 1.0)] * 3 + [("tag:x", -1.0, 1.0)] * 5, "key string, signal double, weight double")
    a = {x["key"]: round(x["adjustment"], 6) for x in risk.reward_adjustments(f).collect()}
    assert a == {"kind:person": 0.045, "tag:x": -0.066964}


def test_monitor(spark):
    shot = lambda *rows: spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "label string, risk_score double, ord long")
    c = govern.diff(shot(("a", 0.1), ("b", 0.2), ("c", 0.3)), shot(("a", 0.1), ("b", 0.35), ("d", 0.0)))
    assert {r["label"]: r["change"] for r in c.collect()} == {"b": "risk_raised", "c": "removed", "d": "new"}
    assert govern.summary(c, 3, 5).first()["text"] == "1 new, 1 removed, 1 at higher risk, 2 edges more"


@pytest.mark.parametrize("k", [1, 3, 5])
def test_audit_chain_finds_the_first_break(spark, tmp_path, k):
    event = lambda i: {"audit_event_id": f"e{i}", "timestamp": "t", "user_id": "u", "action_performed": "a", "stage": "s", "entity_scope": "x", "sensitive_data_viewed": False}
    path = str(tmp_path / "log.jsonl")
    govern.append_chain(path, [event(i) for i in range(3)])
    govern.append_chain(path, [event(i) for i in range(3, 5)])
    import json

    log = [json.loads(x) for x in open(path)]
    cols = [*event(0), "prev_hash", "hash"]
    df = lambda es: spark.createDataFrame([(i + 1, *(e[c] for c in cols)) for i, e in enumerate(es)], "seq long, " + ", ".join(f"{c} {'boolean' if c.startswith('sens') else 'string'}" for c in cols))
    assert govern.verify_chain(df(log)).first()["broken_at"] is None
    log[k - 1]["stage"] = "other"
    got = govern.verify_chain(df(log)).first()
    assert (got["broken_at"], got["reason"]) == (k, "altered")
    if k < 5:
        del log[k - 1]
        assert govern.verify_chain(df(log)).first()["broken_at"] == k


def test_assess_words(spark):
    e = entities(spark, ("account", "a", {}, [], []), ("account", "b", {}, ["hypothesis"], [])).withColumns({"betweenness": F.lit(0.5), "community": F.lit(1), "anomaly_score": F.lit(None).cast("double")})
    r = spark.createDataFrame([("x", "a", 0.9, "critical", True, 0)], "entity_id string, label string, risk_score double, risk_band string, requires_human_review boolean, ord long")
    for lang in ("en", "pt", "es"):
        got = {x["rule"]: x["confidence"] for x in assess.assess(e, edges(spark), r, risk.case_risk(r), lang).collect()}
        assert got == {"posture": 0.8, "risk": 0.81, "broker": 0.65}
    acts = [x["action"] for x in assess.next_actions(e, edges(spark), r).collect()]
    assert acts == ["trace_sources", "verify_top_risk", "confirm_hypotheses", "enrich_isolated"] or set(acts) == {"trace_sources", "verify_top_risk", "confirm_hypotheses", "enrich_isolated"}


def test_transforms_and_agents(spark):
    e = entities(spark, ("account", "x@mail.example", {}, [], []), ("selector", "529.982.247-25", {}, [], []))
    assert [r["label"] for r in transforms.run_transform(e, "email_domain").collect()] == ["mail.example"]
    assert [r["label"] for r in transforms.run_transform(e, "cpf").collect()] == ["52998224725"]
    out = transforms.run_command(e, ("account",), ["python3", "-c", "import sys,json; json.load(sys.stdin); print(json.dumps({'entities':[{'kind':'ip','label':'1.1.1.1'}],'relationships':[]}))"])
    assert [(r["kind"], r["label"], r["rel_type"]) for r in out.collect()] == [("ip", "1.1.1.1", "related_to")]
    a = transforms.parse_agent("x", "---\nname: X\ndomains: [fraud]\ntriggers: wallet\nauto: true\n---\nbody")
    assert a["domains"] == ["fraud"] and a["triggers"] == ["wallet"] and a["auto"] and a["body"] == "body" and transforms.parse_agent("y", "no front matter") is None


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name, city \n Ann ,Oslo,extra\n,\n\"Bo\nDahl\",x\n".encode())
    got = [r["fields"] for r in readers.read_source(spark, str(tmp_path / "a.csv")).orderBy("index").collect()]
    assert got == [{"name": "Ann", "city": "Oslo", "col_2": "extra"}, {}, {"name": "Bo\nDahl", "city": "x"}]
    (tmp_path / "b.json").write_text('{"meta": 1, "rows": [{"a": {"b": [1, null, "x"]}, "t": true}]}')
    assert [r["fields"] for r in readers.read_source(spark, str(tmp_path / "b.json")).collect()] == [{"a.b.0": "1", "a.b.2": "x", "t": "true"}]
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n\n{"a": ""}\n')
    assert [r["fields"] for r in readers.read_source(spark, str(tmp_path / "c.jsonl")).orderBy("index").collect()] == [{"a": "1"}, {"a": ""}]
    (tmp_path / "d.mcp").write_text('{"server": "s", "tool": "t", "arguments": {"q": 1}}')
    assert readers.read_source(spark, str(tmp_path / "d.mcp")).first()["fields"]["mcp_tool"] == "t"
    (tmp_path / "e.csv").write_bytes("name\nJosé\n".encode("cp1252"))
    assert readers.read_source(spark, str(tmp_path / "e.csv")).first()["fields"] == {"name": "José"}
    with pytest.raises(ValueError):
        readers.read_source(spark, "x.bin")


def test_streaming_batches(spark, tmp_path):
    from casegraph.streaming import events as stream

    src = str(tmp_path / "ev")
    spark.createDataFrame([(1, "2024-01-01 00:05:00", "a", 1.0), (1, "2024-01-01 00:50:00", "a", 2.0), (2, "2024-01-01 05:00:00", "b", 3.0)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    df = stream.read_events(spark, src, "user_id long, ts timestamp, event_type string, value double")
    seen = []
    stream.each_batch(stream.windowed_activity(df), str(tmp_path / "ck"), lambda b, i: seen.extend(b.collect())).awaitTermination(60)
    assert (seen[0]["n"], seen[0]["total"]) == (2, 3.0)  # the last window is still open


def test_keys_that_differ_in_case(spark):
    # a map made of columns keeps their order
    fields = ("Name", "Ann Lee"), ("name", "Bo Ray"), ("NAME", "Cy"), ("lon", "2.5"), ("lat", "1.5"), ("properties.operator", "acme")
    r = records(spark, {}).withColumn("fields", F.create_map(*(F.lit(x) for kv in fields for x in kv)))
    assert r.select(extract.get_any(F.col("fields"), "name").alias("v")).first()["v"] == "Ann Lee"
    x = extract.extract_entities(r).where("kind = 'person'").collect()
    assert [(e["label"], e["attributes"]["longitude"], e["attributes"]["latitude"], e["attributes"]["operator"]) for e in x] == [("Ann Lee", "2.5", "1.5", "acme")]


def test_profile_takes_the_first_rows(spark):
    cells = spark.createDataFrame([(1000 + i, 0, "box", f"a{i}@mail.example" if i < 5 else "free words here") for i in range(20)], "row long, pos int, name string, value string")
    assert extract.profile_columns(cells, 5).first()["semantic"] == "email" and extract.profile_columns(cells, 5).first()["non_empty"] == 5
    assert extract.profile_columns(cells, None).first()["non_empty"] == 20


def test_betweenness_by_levels():
    """Against all shortest paths, enumerated."""
    import itertools

    rng = np.random.default_rng(2)
    for n in (1, 2, 6, 9):
        pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        near = {v: {w for p in pairs for w in p if v in p and w != v} for v in range(n)}
        want = np.zeros(n)
        for s, t in itertools.combinations(range(n), 2):
            paths, front = [], [[s]]
            while front and not paths:
                paths = [p for p in front if p[-1] == t]
                front = [p + [w] for p in front for w in near[p[-1]] if w not in p]
            for p in paths:
                want[p[1:-1]] += 1 / len(paths)
        a, b = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
        starts, ends = network.adjacency_rows(n, a, b)
        for at_once in (1, 1 << 22):
            assert np.allclose(network.betweenness(starts, ends, at_once), want)


def test_nearest_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(transforms, "QUERY_BYTES", 200)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    v[7] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, [0.0] * 5), (102, [1.0])]
    pool = spark.createDataFrame(rows, "id long, vec array<double>")
    got = transforms.nearest(pool.where("id % 6 = 0 AND id < 60").selectExpr("id AS q_id", "vec AS q_vec"), pool, 0.0, 3).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 60, 6):
        sims = sorted(((-round(float(u[q] @ u[i]), 9), i) for i in range(60) if i != q))[:3]
        mine = sorted((r["rank"], r["id"]) for r in got if r["q_id"] == q)
        assert [i for _, i in mine] == [i for s, i in sims if s <= 0]


def test_perceptual_matches_equal_all_pairs(spark):
    """Every block of own hashes against every block of the feed; joins on pieces of three bits gave nearly all pairs many times."""
    rng = np.random.default_rng(4)
    made = lambda k, size: [rng.integers(0, 256, size, np.uint8).tobytes().hex() for _ in range(k)]
    feed = [*made(40, 8), *made(9, 2), *made(9, 12)]
    refs = [(h.upper() if i % 3 else "0x" + h, "perceptual", f"s{i}", "c", None, int(rng.integers(9))) for i, h in enumerate(feed + feed[:5])] + [("zz", "perceptual", "s", "c", "low", 0), ("00" * 8, "hash", "s", "c", "low", 0)]
    own = [*made(60, 8), *made(9, 2), *made(9, 12), *feed[:4], feed[0], "abc", "q", "", None]
    items = spark.createDataFrame(list(enumerate(own)), "id long, hash string")
    want = {}
    for i, h in enumerate(own):
        near = []
        for v, kind, source, _, _, order in refs:
            v = v.lower().removeprefix("0x")
            if h and kind == "perceptual" and len(h) == len(v) and len(h) % 2 == 0:
                near.append(((int(h, 16) ^ int(v, 16)).bit_count(), order, v, source))
        if near and min(near)[0] <= 24:
            want[i] = (min(near)[0], min(near)[3], 1 - min(near)[0] / (4 * len(h)))
    frame = spark.createDataFrame(refs, "value string, kind string, source string, category string, severity string, ord long")
    for blocks in ((4096, 4096), (7, 5)):
        got = enrich.match_perceptual(items, frame, 24, *blocks).collect()
        assert {r["id"]: (r["distance"], r["source"], r["similarity"]) for r in got} == want and len(got) == len(want)
    assert enrich.match_perceptual(items, frame.limit(0), 24).count() == 0 and enrich.match_perceptual(items.limit(0), frame, 24).count() == 0


def test_nearest_perceptual(spark):
    refs = spark.createDataFrame([("ff00", "perceptual"), ("0x0001", "perceptual"), ("ff", "perceptual"), ("zz", "perceptual"), ("0000", "hash")], "value string, kind string")
    items = spark.createDataFrame([("a", "FF01"), ("b", "0000"), ("c", "abc"), ("d", "00"), ("e", "00000000")], "id string, hash string")
    for at_once in (100, 1):
        assert {r["id"]: r["distance"] for r in enrich.nearest_perceptual(items, refs, at_once).collect()} == {"a": 1, "b": 1, "d": 8}


def test_feeds_and_profiles_of_files(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"source": "s2", "category": "c", "values": ["AA"]}')
    (tmp_path / "a.json").write_text('[{"source": "s1", "category": "c", "kind": "perceptual", "severity": "low", "values": ["ff00", " "]}, {"source": "s1", "category": "d", "values": ["aa"]}]')
    (tmp_path / "c.json").write_text("not json at all {")
    got = {(r["value"], r["kind"]): (r["source"], r["severity"]) for r in enrich.load_refs(readers.read_feeds(spark, str(tmp_path))).collect()}
    assert got == {("ff00", "perceptual"): ("s1", "low"), ("aa", "hash"): ("s2", "high")}
    (tmp_path / "t.csv").write_text("who,box\nAnn Lee,ann@mail.example\nBo Ray,bo@mail.example\n")
    rows = {r["name"]: r for r in readers.profile_source(spark, str(tmp_path / "t.csv")).collect()}
    assert rows["box"]["semantic"] == "email" and rows["box"]["row_count"] == 2


def test_a_case_end_to_end(spark, tmp_path):
    from casegraph.operators.run import run_case
    from casegraph.sources import report

    rows = [
        {"report_id": "r1", "person_id": "p1", "full_name": "Ann Lee", "username": "ann77", "ip_address": "10.0.0.1", "full_url": "https://a.shop.example/x", "sha256": "a" * 32, "timestamp": "2026-01-05T02:11:00Z"},
        {"report_id": "r2", "person_id": "p2", "full_name": "Bo Ray", "username": "bo_ray", "ip_address": "10.0.0.1", "full_url": "https://b.shop.example/y", "sha256": "b" * 32, "timestamp": "2026-01-05T02:15:00Z"},
        {"report_id": "r3", "full_name": "Cy Dahl", "username": "ann77", "ip_address": "10.0.0.9", "urgency_level": "active"},
    ]
    refs = enrich.load_refs(spark.createDataFrame([("feed", "known", "critical", "hash", ["A" * 32], 0)], "source string, category string, severity string, kind string, values array<string>, ord int"))
    case = run_case(records(spark, *rows), refs)
    e = {(r["kind"], r["label"]): r for r in case.entities.collect()}
    assert ("domain", "shop.example") in e and e["ip", "10.0.0.1"]["attributes"]["ip_scope"] == "private"
    assert any("known-file-hash" in r["tags"] for r in e.values()) and sum("broker" in r["tags"] for r in e.values()) == 1
    assert all("pagerank" in r["attributes"] for r in e.values())
    rel = {r["rel_type"] for r in case.edges.collect()}
    assert {"belongs_to_domain", "logged_in_from_ip"} <= rel and any(x.startswith(("shares", "shared", "co_")) for x in rel)
    assert case.risk.count() == len(e) and case.findings.count() >= 2 and case.case.count() == 1
    written = report.write_case(case, str(tmp_path / "out"), "pt")
    assert len(written) == 10
    entities, edges = report.load_graph(spark, str(tmp_path / "out"))
    assert {(r["id"], r["label"]) for r in entities.collect()} == {(r["id"], r["label"]) for r in e.values()} and edges.count() == case.edges.count()
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out" / "brief")).collect())
    assert "# Resumo do caso" in text and "Ann Lee" in text
    none = run_case(records(spark).limit(0))
    assert none.entities.count() == 0 and none.risk.count() == 0


def test_middles(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 500), ("d", 501)) for v in rng.integers(-9, 9, n)] + [("hot", 0.0)] * 2000 + [("hot", 1.0), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in middles(df.withColumn("n", F.lit(1)), ["k"], "v", "n").collect()}
    assert set(got) == {"a", "b", "c", "d", "hot"}
    for k, r in got.items():
        own = sorted(v for x, v in rows if x == k)
        assert (r["total"], r["lower"], r["upper"]) == (len(own), own[(len(own) - 1) // 2], own[len(own) // 2])
    weighted = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    assert {r["k"]: r for r in middles(weighted, ["k"], "v", "n").collect()} == got
    assert middles(df.limit(0).withColumn("n", F.lit(1)), ["k"], "v", "n").count() == 0


def test_outliers_against_plain_medians(spark):
    rng = np.random.default_rng(6)
    rows = [(f"{k}{i}", k, int(rng.integers(0, 6)) + 90 * (i == 3), 0.0, float(rng.random()), 1) for k, n in (("account", 60), ("ip", 61), ("person", 3)) for i in range(n)]
    features = spark.createDataFrame(rows, "id string, kind string, degree long, betweenness double, pagerank double, sources long")
    got = {(r["id"], r["feature"]): r for r in risk.outliers(features).collect()}
    want = {}
    for kind in ("account", "ip"):
        own = [r for r in rows if r[1] == kind]
        for c, feature in enumerate(risk.FEATURES, 2):
            values = np.array([float(r[c]) for r in own])
            mid = float(np.median(values))
            mad = float(np.median(np.abs(values - mid))) * 1.4826
            want |= {(r[0], feature): (mid, mad) for r in own if r[c] > mid}
    assert set(got) == set(want)
    assert all(math.isclose(got[x]["median"], m) and math.isclose(got[x]["mad"], s) for x, (m, s) in want.items())
