"""Queries over the event, order and place graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import iso_hour
from ..operators import assess, correlate, enrich, govern, graph, network, resolve, risk, transforms
from ..operators.components import cut
from .adapters import EVENTS, ORDERS, PLACES, customer_name, eid, event_edges, event_entities, order_edges, order_entities, place_nodes, place_pairs, rows, table
from .catalog import query


@query("q_entity_upsert", f"""
WITH {EVENTS}, x AS (SELECT 'person' AS kind, c_name AS label, c_custkey AS ord, c_mktsegment AS seg, NULL AS src FROM customer
  UNION ALL SELECT 'organization', s_name, s_suppkey, NULL, NULL FROM supplier UNION ALL SELECT 'account', acct, event_id, NULL, event_type FROM ev)
SELECT 'ent-' || substr(sha256(kind || '::' || lower(label)), 1, 32) AS id, kind, arg_min(label, ord) AS label, min(ord) AS ord, arg_min(seg, ord) AS segment, count(DISTINCT src) AS n_sources FROM x GROUP BY kind, lower(label), id
""")
def q_entity_upsert(s, d):
    c, p, ev = table(s, d, "customer"), table(s, d, "supplier"), table(s, d, "events")
    made = rows(c, "person", F.col("c_name"), F.col("c_custkey"), {"segment": F.col("c_mktsegment")}).unionByName(rows(p, "organization", F.col("s_name"), F.col("s_suppkey")))
    made = made.unionByName(rows(ev, "account", F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.col("event_id"), None, F.array("event_type")))
    return graph.upsert_entities(made).select("id", "kind", "label", "ord", F.try_element_at("attributes", F.lit("segment")).alias("segment"), F.size("sources").cast("long").alias("n_sources"))


@query("q_edge_dedup", f"WITH {EVENTS} SELECT a AS source_id, 'uses_device' AS rel_type, d AS target_id, 0.7::DOUBLE AS confidence, 'events#' || first AS source_reference FROM ee")
def q_edge_dedup(s, d):
    return event_edges(s, d).drop("ord")


@query("q_degree", f"WITH {EVENTS} SELECT id, kind, label, degree FROM dg")
def q_degree(s, d):
    e = event_entities(s, d)
    return graph.degrees(e, event_edges(s, d)).join(e.select("id", "kind", "label"), "id").select("id", "kind", "label", "degree")


@query("q_shared_hub", f"""
WITH {EVENTS}, h AS (SELECT d FROM ee GROUP BY d HAVING count(*) BETWEEN 2 AND 12),
p AS (SELECT x.a AS source_id, y.a AS target_id, x.d, x.dev FROM ee x JOIN ee y ON x.d = y.d AND x.a < y.a WHERE x.d IN (SELECT d FROM h))
SELECT source_id, 'same_device_as' AS rel_type, target_id, 0.5::DOUBLE AS confidence, 'shared:' || arg_min(dev, d) AS source_reference FROM p GROUP BY source_id, target_id
""")
def q_shared_hub(s, d):
    return graph.add_edges(correlate.shared_hubs(event_entities(s, d), event_edges(s, d))).drop("ord")


@query("q_activity_hour", "SELECT strftime(ts, '%H') AS hour, count(*) AS n FROM events GROUP BY ALL")
def q_activity_hour(s, d):
    return table(s, d, "events").groupBy(iso_hour(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("q_enrich_attributes", f"WITH {EVENTS} SELECT acct AS label, arg_min(strftime(ts, '%H'), event_id) AS activity_hour, true AS enriched FROM ev GROUP BY acct")
def q_enrich_attributes(s, d):
    e = enrich.derived_attributes(event_entities(s, d).where("kind = 'account'"))
    return e.select("label", F.try_element_at("attributes", F.lit("activity_hour")).alias("activity_hour"), F.array_contains("tags", "enriched").alias("enriched"))


@query("q_temporal_coactive", f"""
WITH {EVENTS}, b AS (SELECT DISTINCT {eid('account', 'acct')} AS id, ((((year(ts) - 2000) * 365 + month(ts) * 31 + day(ts)) * 24 + hour(ts)) * 60 + minute(ts)) // 60 AS bucket FROM ev),
g AS (SELECT bucket FROM b GROUP BY bucket HAVING count(*) BETWEEN 2 AND 10)
SELECT x.id AS source_id, y.id AS target_id, count(*) AS windows, min(x.bucket) AS first_bucket FROM b x JOIN b y ON x.bucket = y.bucket AND x.id < y.id WHERE x.bucket IN (SELECT bucket FROM g) GROUP BY ALL
""")
def q_temporal_coactive(s, d):
    ev = table(s, d, "events")
    from .adapters import account, node

    stamps = ev.select(node("account", account(F.col("user_id"))).alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"))
    out = correlate.co_active(stamps, event_edges(s, d))
    return out.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("windows"), F.min("bucket").alias("first_bucket"))


@query("q_link_prediction", f"""
WITH {EVENTS}, dz AS (SELECT node, count(*) AS deg FROM en GROUP BY node HAVING count(*) BETWEEN 2 AND 25),
p AS (SELECT x.other AS a, y.other AS b, deg FROM en x JOIN en y ON x.node = y.node AND x.other < y.other JOIN dz ON dz.node = x.node)
SELECT a, b, count(*) AS common, round(sum(1 / ln(deg)), 6) AS score FROM p GROUP BY ALL HAVING count(*) >= 2 ORDER BY round(sum(1 / ln(deg)), 9) DESC, common DESC, a, b LIMIT 12
""")
def q_link_prediction(s, d):
    return network.predict_links(event_edges(s, d)).select("a", "b", "common", F.round("score", 6).alias("score"))


@query("q_predicted_edges", f"""
WITH {EVENTS}, dz AS (SELECT node, count(*) AS deg FROM en GROUP BY node HAVING count(*) BETWEEN 2 AND 25),
p AS (SELECT x.other AS a, y.other AS b, deg FROM en x JOIN en y ON x.node = y.node AND x.other < y.other JOIN dz ON dz.node = x.node),
t AS (SELECT a, b, count(*) AS common, sum(1 / ln(deg)) AS score FROM p GROUP BY ALL HAVING count(*) >= 2 ORDER BY round(sum(1 / ln(deg)), 9) DESC, common DESC, a, b LIMIT 12)
SELECT a AS source_id, b AS target_id, 'predicted_link' AS rel_type, round(0.3 + 0.4 * score / max(score) OVER (), 6) AS confidence, common AS shared_neighbors FROM t
""")
def q_predicted_edges(s, d):
    out = network.predicted_edges(network.predict_links(event_edges(s, d)))
    return out.select("source_id", "target_id", "rel_type", F.round("confidence", 6).alias("confidence"), F.col("ord").cast("long").alias("shared_neighbors"))


@query("q_calibration_links", f"""
WITH {EVENTS}, dz AS (SELECT node, count(*) AS deg FROM en GROUP BY node HAVING count(*) BETWEEN 2 AND 25),
p AS (SELECT x.other AS a, y.other AS b, deg FROM en x JOIN en y ON x.node = y.node AND x.other < y.other JOIN dz ON dz.node = x.node),
t AS (SELECT a, b, count(*) AS common, round(sum(1 / ln(deg)), 9) AS score FROM p GROUP BY ALL), m AS (SELECT unnest([2, 3, 4]) AS min_shared)
SELECT min_shared, count(*) AS candidates, round(min(score), 6) AS least, round(list_sort(list(score))[count(*) // 2 + 1], 6) AS middle, round(max(score), 6) AS most FROM t JOIN m ON common >= min_shared GROUP BY ALL
""")
def q_calibration_links(s, d):
    p = network.predict_links(event_edges(s, d), 2, None).withColumn("score", F.round("score", 9))
    return risk.link_curve(p).select("min_shared", "candidates", *(F.round(c, 6).alias(c) for c in ("least", "middle", "most")))


def _event_features(s, d):
    e = event_entities(s, d)
    deg = graph.degrees(e, event_edges(s, d))
    hour = iso_hour(F.try_element_at("attributes", F.lit("timestamp"))).cast("int")
    return e.join(deg, "id").select("id", "kind", "label", "degree", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("pagerank"), F.size("sources").alias("sources"), hour.alias("activity_hour"))


_FEATURES = f"""{EVENTS}, sr AS (SELECT {eid('account', 'acct')} AS id, count(DISTINCT event_type) AS n, arg_min(hour(ts), event_id) AS h FROM ev GROUP BY acct),
ft AS (SELECT dg.id, kind, label, degree::DOUBLE AS degree, coalesce(n, 0)::DOUBLE AS sources, h FROM dg LEFT JOIN sr USING (id)),
lg AS (SELECT id, kind, 'degree' AS feature, degree AS value FROM ft UNION ALL SELECT id, kind, 'sources', sources FROM ft),
md AS (SELECT kind, feature, median(value) AS med, 1.4826 * mad(value) AS mad FROM lg GROUP BY ALL HAVING count(*) >= 4),
ol AS (SELECT id, feature, value, med, md.mad, CASE WHEN md.mad > 1e-6 THEN (value - med) / md.mad ELSE 0 END AS z, CASE WHEN med > 1e-6 THEN value / med ELSE 'infinity'::DOUBLE END AS ratio FROM lg JOIN md USING (kind, feature) WHERE value > med)"""


@query("q_anomaly_outliers", f"WITH {_FEATURES} SELECT id, feature, round(value, 6) AS value, round(med, 6) AS median, round(ol.mad, 6) AS mad, round(z, 6) AS z FROM ol")
def q_anomaly_outliers(s, d):
    r = lambda c: F.round(c, 6).alias(c)
    return risk.outliers(cut(_event_features(s, d))).select("id", "feature", r("value"), r("median"), r("mad"), r("z"))


@query("q_anomaly_mad", f"""
WITH {_FEATURES}, ht AS (SELECT id, CASE WHEN z >= 6 OR ratio >= 4 THEN 0.8 ELSE 0.62 END AS s FROM ol WHERE (ol.mad > 1e-6 AND z >= 3.5) OR (ol.mad <= 1e-6 AND ratio >= 2 AND value - med >= 2)
  UNION ALL SELECT id, 0.5 FROM ft WHERE h <= 5)
SELECT id, max(s)::DOUBLE AS score FROM ht GROUP BY id
""")
def q_anomaly_mad(s, d):
    return risk.detect_anomalies(_event_features(s, d)).select("id", "score")


@query("q_off_hours", f"WITH {_FEATURES} SELECT label, printf('seen at night, %02d h', h) AS reason FROM ft WHERE h <= 5")
def q_off_hours(s, d):
    f = _event_features(s, d).withColumns({c: F.lit(0.0) for c in ("degree", "sources")})
    out = risk.detect_anomalies(f).select("id", "reason")
    return out.join(f.select("id", "label"), "id").select("label", "reason")


@query("q_calibration_anomaly", f"""
WITH {_FEATURES}, bs AS (SELECT id, max(z) AS z FROM (SELECT id, CASE WHEN ol.mad <= 1e-6 AND ratio >= 2 AND value - med >= 2 THEN 'infinity'::DOUBLE WHEN ol.mad > 1e-6 THEN z ELSE 0 END AS z FROM ol
  UNION ALL SELECT id, 'infinity'::DOUBLE FROM ft WHERE h <= 5) GROUP BY id),
ct AS (SELECT t.z, count(*) FILTER (bs.z >= t.z) AS flagged FROM bs, (SELECT unnest([2.5, 3.0, 3.5, 4.0])::DOUBLE AS z) t GROUP BY t.z)
SELECT z, flagged, z = coalesce((SELECT min(z) FROM ct WHERE flagged <= greatest(1, ceil((SELECT count(*) FROM nn) * 0.02))), 4.0) AS recommended FROM ct
""")
def q_calibration_anomaly(s, d):
    f = cut(_event_features(s, d))
    return risk.anomaly_curve(f, f.count())


@query("q_modularity", f"""
WITH {PLACES}, cm AS (SELECT 'r' || r_regionkey AS id, r_regionkey AS c FROM region UNION ALL SELECT 'n' || n_nationkey, n_nationkey % 7 FROM nation UNION ALL SELECT 's' || s_suppkey, s_nationkey % 7 FROM supplier UNION ALL SELECT 'c' || c_custkey, c_nationkey % 7 FROM customer),
x AS (SELECT ca.c AS a, cb.c AS b FROM pe JOIN cm ca ON pe.a = ca.id JOIN cm cb ON pe.b = cb.id), m AS (SELECT count(*) AS m FROM x),
dd AS (SELECT c, count(*) AS d FROM (SELECT a AS c FROM x UNION ALL SELECT b FROM x) GROUP BY c)
SELECT round((SELECT count(*) FROM x WHERE a = b) / (SELECT m FROM m) - (SELECT sum(d * d) FROM dd) / (4.0 * (SELECT m * m FROM m)), 9) AS modularity
""")
def q_modularity(s, d):
    r, n, p, c = (table(s, d, t) for t in ("region", "nation", "supplier", "customer"))
    one = lambda df, k, i, g: df.select(F.concat(F.lit(k), F.col(i).cast("string")).alias("id"), g.cast("long").alias("community"))
    com = one(r, "r", "r_regionkey", F.col("r_regionkey")).unionAll(one(n, "n", "n_nationkey", F.col("n_nationkey") % 7)).unionAll(one(p, "s", "s_suppkey", F.col("s_nationkey") % 7)).unionAll(one(c, "c", "c_custkey", F.col("c_nationkey") % 7))
    return network.modularity(place_pairs(s, d), com).select(F.round("modularity", 9).alias("modularity"))


@query("q_adjacency", f"WITH {EVENTS} SELECT least(a, d) AS a, greatest(a, d) AS b FROM ee")
def q_adjacency(s, d):
    return graph.undirected(event_edges(s, d))


_STEP = """r{i} AS (SELECT pn.id, 0.15 / (SELECT count(*) FROM pn) + 0.85 * coalesce((SELECT sum(r.v) FROM r{j} r LEFT JOIN pd USING (id) WHERE pd.d IS NULL), 0) / (SELECT count(*) FROM pn) + 0.85 * coalesce(f.v, 0) AS v
  FROM pn LEFT JOIN (SELECT pb.b AS id, sum(r.v / pd.d) AS v FROM r{j} r JOIN pb ON pb.a = r.id JOIN pd ON pd.id = r.id GROUP BY pb.b) f USING (id))"""


@query("q_pagerank_3", f"""
WITH {PLACES}, pb AS (SELECT a, b FROM pe UNION ALL SELECT b, a FROM pe), pd AS (SELECT a AS id, count(*) AS d FROM pb GROUP BY a),
r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM pn) AS v FROM pn), {_STEP.format(i=1, j=0)}, {_STEP.format(i=2, j=1)}, {_STEP.format(i=3, j=2)}
SELECT id, round(v / max(v) OVER (), 6) AS pagerank FROM r3
""")
def q_pagerank_3(s, d):
    return network.analyze(place_nodes(s, d), place_pairs(s, d), rounds=3).select("id", F.round("pagerank", 6).alias("pagerank"))


@query("q_network_metrics")
def q_network_metrics(s, d):
    return network.analyze(place_nodes(s, d), place_pairs(s, d), pivots=None).select("id", F.round("betweenness", 3).alias("betweenness"), F.round("pagerank", 3).alias("pagerank"), "community", "exact")


@query("q_top_broker")
def q_top_broker(s, d):
    return network.top_broker(network.brokers(place_nodes(s, d), place_pairs(s, d))).select("id", F.round("betweenness", 3).alias("betweenness"))


# -- orders --------------------------------------------------------------------------------------------------


@query("q_money_rollup", f"WITH {ORDERS} SELECT a AS id, round(sum(o_totalprice), 2) AS total_value FROM oe GROUP BY a")
def q_money_rollup(s, d):
    return enrich.money_rollup(order_entities(s, d), order_edges(s, d)).select("id", F.round("total_value", 2).alias("total_value"))


def _order_risk(s, d):
    e, edges = order_entities(s, d), order_edges(s, d)
    m = graph.degrees(e, edges).withColumns({"betweenness": F.lit(0.0), "anomaly_score": F.lit(0.0), "adjustment": F.lit(0.0)})
    return risk.score_risk(e, m, edges, "fraud")


_W = ", ".join(f"('{t}', {w})" for t, w in (risk.SIGNALS | risk.DOMAIN_SIGNALS["fraud"]).items())
_RISK = f"""{ORDERS}, w(t, w) AS (VALUES {_W}), sg AS (SELECT id, max(w) AS w, count(*) AS n FROM od JOIN w ON contains(hay, t) GROUP BY id),
bs AS (SELECT od.id, kind, label, ord, coalesce(n, 0) AS n, least(greatest(coalesce(w, 0), CASE kind WHEN 'payment' THEN 0.35 ELSE 0.15 END)::DOUBLE + degree / (SELECT max(degree) FROM od) * 0.3, 1.0) AS base FROM od LEFT JOIN sg USING (id)),
fl AS (SELECT e.id, max(b.base) * 0.18 AS flow FROM (SELECT a AS id, p AS o FROM oe UNION ALL SELECT p, a FROM oe) e JOIN bs b ON b.id = e.o GROUP BY e.id),
rk AS (SELECT bs.*, CASE WHEN flow > 0.02 AND base < 1 AND least(base + flow, 1.0) > base + 0.02 THEN least(base + flow, 1.0) ELSE base END AS score FROM bs LEFT JOIN fl USING (id)),
rb AS (SELECT *, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS band FROM rk)"""


@query("q_risk_score", f"WITH {_RISK} SELECT id AS entity_id, kind, round(base, 6) AS base, n AS n_signals FROM rb")
def q_risk_score(s, d):
    n = F.size(F.filter("top_factors", lambda f: F.startswith(f, F.lit("signal:"))))
    return _order_risk(s, d).select("entity_id", "kind", F.round("base", 6).alias("base"), n.cast("long").alias("n_signals"))


@query("q_risk_propagation", f"""
WITH {_RISK} SELECT id AS entity_id, round(score, 6) AS risk_score, band AS risk_band,
CASE WHEN base < 0.35 THEN 'monitor' ELSE 'open_financial_investigation' END AS recommended_action, band IN ('high', 'critical') AS requires_human_review FROM rb
""")
def q_risk_propagation(s, d):
    return _order_risk(s, d).select("entity_id", F.round("risk_score", 6).alias("risk_score"), "risk_band", "recommended_action", "requires_human_review")


@query("q_case_risk", f"WITH {_RISK}, t AS (SELECT score FROM rb ORDER BY score DESC LIMIT 5), v AS (SELECT avg(score) AS x FROM t) SELECT round(x, 6) AS case_risk_score, CASE WHEN x >= 0.85 THEN 'critical' WHEN x >= 0.6 THEN 'high' WHEN x >= 0.35 THEN 'medium' ELSE 'low' END AS case_risk_band FROM v")
def q_case_risk(s, d):
    return risk.case_risk(_order_risk(s, d)).select(F.round("case_risk_score", 6).alias("case_risk_score"), "case_risk_band")


@query("q_merge_proposals", f"""
WITH {_RISK} SELECT id AS entity_id, round(CASE WHEN kind = 'account' THEN greatest(score, 0.5) ELSE score END, 6) AS risk_score, CASE WHEN kind = 'account' THEN 'heuristic+llm' ELSE 'heuristic' END AS source FROM rb
""")
def q_merge_proposals(s, d):
    r = _order_risk(s, d)
    p = r.where("kind = 'account'").select("entity_id", F.lit(0.5).alias("risk_score"), F.array(F.lit("proposed")).alias("top_factors"), F.lit(None).cast("string").alias("recommended_action"), F.lit(None).cast("string").alias("explanation"), F.lit(False).alias("requires_human_review"))
    return risk.merge_proposals(r, p).select("entity_id", F.round("risk_score", 6).alias("risk_score"), "source")


@query("q_intel_score", f"""
WITH {_RISK}, f AS (SELECT rb.id, score, degree, o_totalprice > 400000 AS hit FROM rb JOIN od USING (id) LEFT JOIN oe ON oe.p = rb.id)
SELECT id, round(least(round(40 * score + 8 * degree / (SELECT max(degree) FROM od) + CASE WHEN hit THEN 10 ELSE 0 END, 6), 100))::INT AS intel_score FROM f
""")
def q_intel_score(s, d):
    e, edges = order_entities(s, d), order_edges(s, d)
    r = _order_risk(s, d).select(F.col("entity_id").alias("id"), F.col("risk_score").alias("risk"))
    big = F.coalesce(F.try_element_at("attributes", F.lit("amount")).cast("double") > 400000, F.lit(False))
    f = e.join(graph.degrees(e, edges), "id").join(r, "id").select("id", "risk", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("pagerank"), F.lit(0.0).alias("anomaly"), "degree", big.alias("ref_hit"))
    return risk.intel_score(f).select("id", "intel_score")


@query("q_auto_tags", f"""
WITH {_RISK} SELECT rb.id, array_to_string(list_filter([CASE WHEN band IN ('high', 'critical') THEN 'risk:' || band END, CASE WHEN degree >= 8 THEN 'hub' END, CASE WHEN degree = 0 THEN 'isolated' END], lambda t: t IS NOT NULL), ',') AS tags FROM rb JOIN od USING (id)
""")
def q_auto_tags(s, d):
    e, edges = order_entities(s, d), order_edges(s, d)
    facts = graph.degrees(e, edges).join(_order_risk(s, d).select(F.col("entity_id").alias("id"), "risk_band"), "id")
    return risk.auto_tags(e, facts).select("id", F.array_join("tags", ",").alias("tags"))


@query("q_situation", f"""
WITH {_RISK}, c AS (SELECT count(*) FILTER (band = 'critical') AS critical, count(*) FILTER (band IN ('high', 'critical')) AS review, count(*) AS entities FROM rb)
SELECT entities, (SELECT count(*) FROM oe) AS relationships, critical, review, CASE WHEN critical > 0 THEN 'critical' WHEN review > 0 THEN 'elevated' ELSE 'normal' END AS severity FROM c
""")
def q_situation(s, d):
    return assess.situation(order_entities(s, d), order_edges(s, d), _order_risk(s, d))


@query("q_case_buckets", f"WITH {ORDERS}, {EVENTS} SELECT CASE kind WHEN 'payment' THEN 'payments' WHEN 'account' THEN 'accounts' ELSE 'devices' END AS bucket, count(*) AS n FROM (SELECT kind FROM on_ UNION ALL SELECT kind FROM nn) GROUP BY ALL")
def q_case_buckets(s, d):
    e = order_entities(s, d).select("kind").unionAll(event_entities(s, d).select("kind"))
    return e.groupBy(assess.bucket(F.col("kind")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _assessed(s, d):
    e, edges = order_entities(s, d), order_edges(s, d)
    r = _order_risk(s, d)
    e = e.withColumns({"betweenness": F.lit(None).cast("double"), "community": F.when(F.col("kind") == "payment", 1).otherwise(0), "anomaly_score": F.when(F.col("kind") == "account", 0.62)})
    return assess.assess(e, edges, r, risk.case_risk(r))


@query("q_assessments", f"""
WITH {_RISK}, c AS (SELECT avg(score) AS x, max(score) AS top FROM (SELECT score FROM rb ORDER BY score DESC LIMIT 5))
SELECT 'posture' AS rule, CASE WHEN x >= 0.85 THEN 0.8 WHEN x >= 0.6 THEN 0.7 WHEN x >= 0.35 THEN 0.5 ELSE 0.4 END::DOUBLE AS confidence FROM c
UNION ALL SELECT 'risk', round(least(top * 0.9, 0.85), 6) FROM c WHERE top >= 0.6 UNION ALL SELECT 'communities', 0.55 UNION ALL SELECT 'anomaly', round(0.45 + 0.62 * 0.4, 6)
""")
def q_assessments(s, d):
    return _assessed(s, d).select("rule", "confidence")


@query("q_next_actions", f"""
WITH {_RISK}, c AS (SELECT count(*) AS n, count(*) FILTER (degree = 0) AS iso FROM od), r AS (SELECT count(*) AS k FROM rb WHERE score >= 0.6)
SELECT 'enrich_isolated' AS action, iso AS "count", round(least(0.25 + iso / n * 0.35, 0.7), 6) AS reduction, round(least(least(0.25 + iso / n * 0.35, 0.7) / 0.55, 3) / 3, 6) AS priority, 5.0::DOUBLE AS est_hours FROM c WHERE iso > 0
UNION ALL SELECT 'verify_top_risk', 1, 0.55, round(0.55 / 0.3 / 3, 6), 3.0 FROM r WHERE k > 0
""")
def q_next_actions(s, d):
    out = assess.next_actions(order_entities(s, d), order_edges(s, d), _order_risk(s, d))
    return out.select("action", "count", F.round("reduction", 6).alias("reduction"), F.round("priority", 6).alias("priority"), "est_hours")


# -- similarity and identity -----------------------------------------------------------------------------------


@query("q_geo_colocation", """
WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 7919 % 1000) / 1000.0 AS lat, (s_suppkey * 104729 % 1000) / 1000.0 AS lon FROM supplier),
x AS (SELECT a.id AS a, b.id AS b, 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km FROM p a JOIN p b ON a.id < b.id),
n AS (SELECT * FROM x WHERE km <= 5.0), c AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM n UNION ALL SELECT b FROM n) GROUP BY id)
SELECT a AS source_id, b AS target_id, round(km, 6) AS km FROM n WHERE a NOT IN (SELECT id FROM c WHERE k > 12)
""")
def q_geo_colocation(s, d):
    k = F.col("s_suppkey")
    pts = table(s, d, "supplier").select(k.alias("id"), (k * 7919 % 1000 / 1000.0).alias("lat"), (k * 104729 % 1000 / 1000.0).alias("lon"))
    none = pts.limit(0).select(F.col("id").alias("source_id"), F.col("id").alias("target_id"))
    return correlate.co_located(pts, none).select("source_id", "target_id", F.round("km", 6).alias("km"))


@query("q_fuzzy_similar", """
WITH t AS (SELECT DISTINCT lower(p_name || ' ' || replace(p_brand, '#', '')) AS x FROM part),
p AS (SELECT a.x, b.x AS y, string_split(a.x, ' ') AS s, string_split(b.x, ' ') AS t FROM t a JOIN t b ON a.x < b.x),
m AS (SELECT x, y, len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t))) AS j, CASE WHEN abs(length(x) - length(y)) > greatest(length(x), length(y)) // 2 THEN 0 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END AS e FROM p)
SELECT x, y, round(greatest(j, e), 6) AS sim FROM m WHERE greatest(j, e) >= 0.8
""")
def q_fuzzy_similar(s, d):
    label = F.concat_ws(" ", "p_name", "p_brand")
    e = graph.upsert_entities(rows(table(s, d, "part"), "organization", label, F.col("p_partkey")))
    out = correlate.similar_labels(e)
    from ..functions.text import plain

    name = lambda c, n: e.select(F.col("id").alias(c), plain(F.col("label")).alias(n))
    out = out.join(name("source_id", "p"), "source_id").join(name("target_id", "q"), "target_id")
    return out.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), F.round("sim", 6).alias("sim"))


@query("q_comms_cooccur", f"""
WITH m AS (SELECT DISTINCT conv_id, role || '-' || (conv_id % 40) AS who FROM conversations), k AS (SELECT *, {eid('person', 'who')} AS id FROM m),
g AS (SELECT conv_id FROM k GROUP BY conv_id HAVING count(*) BETWEEN 2 AND 8)
SELECT x.id AS source_id, y.id AS target_id, count(*) AS comms FROM k x JOIN k y ON x.conv_id = y.conv_id AND x.id < y.id WHERE x.conv_id IN (SELECT conv_id FROM g) GROUP BY ALL
""")
def q_comms_cooccur(s, d):
    from .adapters import edge, node

    c = table(s, d, "conversations")
    who, conv = F.concat_ws("-", "role", (F.col("conv_id") % 40).cast("string")), F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    e = graph.upsert_entities(rows(c, "person", who, F.col("conv_id")).unionByName(rows(c, "communication", conv, F.col("conv_id"))))
    edges = graph.add_edges(edge(c, node("person", who), "sent", node("communication", conv), 0.6, F.lit("conversations"), F.col("conv_id")))
    return correlate.co_communicated(e, edges).groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("comms"))


@query("q_selector_reuse", f"""
WITH a AS (SELECT DISTINCT 'user' || user_id AS h, 'user' || user_id || '@' || event_type || '.example' AS label FROM events), k AS (SELECT h, {eid('account', 'label')} AS id FROM a WHERE octet_length(encode(h)) >= 4),
g AS (SELECT h FROM k GROUP BY h HAVING count(*) BETWEEN 2 AND 6)
SELECT x.id AS source_id, y.id AS target_id, x.h AS handle FROM k x JOIN k y ON x.h = y.h AND x.id < y.id WHERE x.h IN (SELECT h FROM g)
""")
def q_selector_reuse(s, d):
    ev = table(s, d, "events")
    label = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@"), "event_type", F.lit(".example"))
    e = graph.upsert_entities(rows(ev, "account", label, F.col("event_id")))
    return correlate.same_selector(e).select("source_id", "target_id", F.col("ord").alias("handle"))


def _suppliers(s, d):
    p = table(s, d, "supplier")
    return graph.upsert_entities(rows(p, "organization", F.col("s_name"), F.col("s_suppkey"), {"address": F.concat(F.lit("Dock "), F.col("s_nationkey").cast("string"))}))


def _no_edges(s):
    return s.createDataFrame([], "source_id string, rel_type string, target_id string, confidence double, source_reference string, ord long")


@query("q_identity_candidates", f"""
WITH p AS (SELECT {eid('organization', 's_name')} AS id, lower(s_name) AS label, s_nationkey AS n, regexp_replace(s_name, '[^0-9]', '', 'g') AS g FROM supplier),
x AS (SELECT a.id AS a, b.id AS b, 1 - levenshtein(a.label, b.label) / greatest(length(a.label), length(b.label)) AS sim, a.n = b.n AS same FROM p a JOIN p b ON a.id < b.id),
c AS (SELECT a, b, greatest(CASE WHEN sim >= 0.86 THEN sim ELSE 0 END, CASE WHEN same THEN 0.85 ELSE 0 END) AS confidence FROM x)
SELECT a, b, round(confidence, 6) AS confidence FROM c WHERE confidence >= 0.5
""")
def q_identity_candidates(s, d):
    e = _suppliers(s, d)
    out = resolve.scored_pairs(e, _no_edges(s))
    return out.select(F.least("canonical_id", "alias_id").alias("a"), F.greatest("canonical_id", "alias_id").alias("b"), F.round("confidence", 6).alias("confidence"))


@query("q_identity_merge")
def q_identity_merge(s, d):
    e, none = _suppliers(s, d), _no_edges(s)
    done = cut(resolve.resolve_identities(e, none))
    merged, _ = graph.merge_entities(e, none, done.where("decision = 'merged'"))
    return merged.select("id", "kind", "label", F.array_join("tags", ",").alias("tags"))


# -- snapshots, feedback, vectors ------------------------------------------------------------------------------


def _snapshots(s, d):
    ev = table(s, d, "events")
    half = ev.select((F.col("ts") < F.lit("2024-01-02").cast("timestamp")).alias("early"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("label"), "event_id", F.when(F.col("event_type") == "error", 0.3).otherwise(0.1).alias("risk_score"))
    shot = lambda df: df.groupBy("label").agg(F.max("risk_score").alias("risk_score"), F.max("event_id").alias("ord"))
    return shot(half.where("early")), shot(half)


@query("q_monitor_diff", """
WITH e AS (SELECT 'user-' || user_id AS label, ts, CASE WHEN event_type = 'error' THEN 0.3 ELSE 0.1 END AS r FROM events), a AS (SELECT label, max(r) AS r FROM e WHERE ts < TIMESTAMP '2024-01-02' GROUP BY label), b AS (SELECT label, max(r) AS r FROM e GROUP BY label),
j AS (SELECT coalesce(a.label, b.label) AS label, a.r AS "before", b.r AS "after" FROM a FULL JOIN b ON a.label = b.label),
c AS (SELECT label, CASE WHEN "before" IS NULL THEN 'new' WHEN "after" IS NULL THEN 'removed' WHEN "after" - "before" >= 0.15 - 1e-9 THEN 'risk_raised' END AS change, "before"::DOUBLE AS "before", "after"::DOUBLE AS "after" FROM j) SELECT * FROM c WHERE change IS NOT NULL
""")
def q_monitor_diff(s, d):
    return govern.diff(*_snapshots(s, d))


@query("q_watchlist", f"""
WITH {_RISK}, rules(name, kind, least, txt) AS (VALUES ('payments', 'payment', 0.6, NULL), ('risky', NULL, 0.7, NULL), ('nines', 'account', 0.0, 'customer-99')),
h AS (SELECT name, id, label, score, ord FROM rb JOIN rules ON (rules.kind IS NULL OR rules.kind = rb.kind) AND round(score, 9) >= least AND (txt IS NULL OR contains(label, txt))),
k AS (SELECT *, count(*) OVER (PARTITION BY name) AS hits, row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, ord, id) AS rn FROM h)
SELECT name, hits, id AS entity_id, rn AS rank FROM k WHERE rn <= 10
""")
def q_watchlist(s, d):
    r = _order_risk(s, d).select(F.col("entity_id").alias("id"), "kind", "label", F.round("risk_score", 9).alias("risk_score"), "ord")
    rules = s.createDataFrame([("payments", "payment", 0.6, None), ("risky", None, 0.7, None), ("nines", "account", 0.0, "customer-99")], "name string, kind string, min_risk double, label_contains string")
    return govern.watchlist(r, rules).select("name", "hits", "entity_id", F.col("rank").cast("long").alias("rank"))


def _feedback(s, d):
    j = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source"), "doc_id")
    return j.select(F.concat(F.lit("tag:"), "source").alias("key"), F.when(F.col("quality") == 1, 1.0).otherwise(-1.0).alias("signal"), F.lit(1.0).alias("weight"))


_FEEDBACK = "f AS (SELECT 'tag:' || source AS key, sum(CASE WHEN quality = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS net, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source), j AS (SELECT *, net / (abs(net) + 3) * 0.15 * n / (n + 2) AS adjustment FROM f)"


@query("q_reward_adjust", f"WITH {_FEEDBACK} SELECT key, net, n, round(adjustment, 6) AS adjustment FROM j WHERE abs(adjustment) > 1e-4")
def q_reward_adjust(s, d):
    return risk.reward_adjustments(_feedback(s, d)).select("key", "net", "n", F.round("adjustment", 6).alias("adjustment"))


@query("q_entity_adjust", f"WITH {_FEEDBACK} SELECT doc_id, round(greatest(least(adjustment, 0.15), -0.15), 6) AS adjustment FROM documents JOIN j ON j.key = 'tag:' || source WHERE abs(adjustment) > 1e-4")
def q_entity_adjust(s, d):
    e = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("report").alias("kind"), F.array("source").alias("tags"))
    out = risk.entity_adjustments(e, risk.reward_adjustments(_feedback(s, d)))
    return out.select(F.col("id").cast("long").alias("doc_id"), F.round("adjustment", 6).alias("adjustment"))


@query("q_cosine_topk", """
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT q.vec_id AS q_id, b.vec_id AS id, list_cosine_similarity(q.e, b.embedding::DOUBLE[]) AS sim FROM q JOIN embeddings b ON q.vec_id != b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, id) AS rn FROM p WHERE sim >= 0) SELECT q_id, id, round(sim, 6) AS sim, rn AS rank FROM r WHERE rn <= 5
""")
def q_cosine_topk(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    out = transforms.nearest(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))
    return out.select("q_id", "id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))
