"""Queries over texts, records, profiles, feeds, redaction and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.values import classify_value, valid_cpf, valid_ssn
from ..operators import enrich, extract, govern, graph, risk, transforms
from ..operators.components import cut
from ..sources.readers import read_table
from ..streaming import events as stream
from .adapters import eid, rows, table
from .catalog import query


def _fill(template: str, **names: str) -> str:
    for k, v in names.items():
        template = template.replace("<" + k + ">", v)
    return template


_EDGE = r"[^\p{L}\p{N}.:/@_-]+"
_TOKENS = rf"list_filter(list_transform(string_split_regex(<c>, '[\s,;|]+'), lambda t: regexp_replace(t, '^{_EDGE}|{_EDGE}$', '', 'g')), lambda t: t != '')"
_IPV4 = "(regexp_matches(<t>, '^[0-9]+(\\.[0-9]+){3}$') AND len(list_filter(string_split(<t>, '.'), lambda o: coalesce(try_cast(o AS BIGINT), 999) > 255)) = 0)"
_KIND = (
    "CASE WHEN starts_with(<t>, 'http://') OR starts_with(<t>, 'https://') OR starts_with(<t>, 'www.') THEN 'url' WHEN regexp_matches(<t>, '^[^@]+@[^@]*\\.[^@]*$') THEN 'account' "
    f"WHEN {_IPV4} THEN 'ip' WHEN regexp_matches(<t>, '^([0-9a-fA-F]{{32}}|[0-9a-fA-F]{{40}}|[0-9a-fA-F]{{64}})$') THEN 'media' "
    "WHEN regexp_matches(<t>, '^0x[0-9a-fA-F]{40}$') THEN 'wallet' WHEN regexp_matches(<t>, '^([A-Za-z0-9-]+\\.)+[A-Za-z]{2,}$') THEN 'domain' END"
)
_IND = f"tk AS (SELECT doc_id, unnest({_fill(_TOKENS, c='text')}) AS raw FROM documents), ix AS (SELECT doc_id, raw, {_fill(_KIND, t='raw')} AS kind FROM tk), ind AS (SELECT * FROM ix WHERE kind IS NOT NULL)"


def _indicators(s, d):
    docs = table(s, d, "documents").select("doc_id", F.explode(tx.indicators(F.col("text"))).alias("i"))
    return docs.select("doc_id", "i.kind", "i.raw")


@query("q_indicator_scan", f"WITH {_IND} SELECT doc_id, kind, raw, count(*) AS n FROM ind GROUP BY ALL")
def q_indicator_scan(s, d):
    return _indicators(s, d).groupBy("doc_id", "kind", "raw").agg(F.count(F.lit(1)).alias("n"))


@query("q_email_domain_hub", f"WITH {_IND}, m AS (SELECT doc_id, raw, lower(regexp_extract(raw, '@(.*)$', 1)) AS domain FROM ind WHERE kind = 'account') SELECT domain, count(DISTINCT raw) AS accounts, count(DISTINCT doc_id) AS documents FROM m WHERE contains(domain, '.') GROUP BY domain")
def q_email_domain_hub(s, d):
    dom = F.lower(F.regexp_extract("raw", "@(.*)$", 1))
    m = _indicators(s, d).where("kind = 'account'").withColumn("domain", dom).where(F.contains("domain", F.lit(".")))
    return m.groupBy("domain").agg(F.countDistinct("raw").alias("accounts"), F.countDistinct("doc_id").alias("documents"))


@query("q_ip_scope", f"""
WITH {_IND}, o AS (SELECT raw, string_split(raw, '.') AS p FROM ind WHERE kind = 'ip'), n AS (SELECT raw, p[1]::INT AS a, p[2]::INT AS b FROM o)
SELECT raw, CASE WHEN a = 127 THEN 'loopback' WHEN a = 10 OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31) THEN 'private' WHEN a = 169 AND b = 254 THEN 'link-local' ELSE 'public' END AS scope, count(*) AS n FROM n GROUP BY ALL
""")
def q_ip_scope(s, d):
    return _indicators(s, d).where("kind = 'ip'").groupBy("raw", tx.ip_scope(F.col("raw")).alias("scope")).agg(F.count(F.lit(1)).alias("n"))


@query("q_hash_type", f"WITH {_IND} SELECT doc_id, lower(raw) AS file_hash, CASE length(raw) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' ELSE 'sha256' END AS hash_type, count(*) AS n FROM ind WHERE kind = 'media' GROUP BY ALL")
def q_hash_type(s, d):
    return _indicators(s, d).where("kind = 'media'").groupBy("doc_id", F.lower("raw").alias("file_hash"), tx.hash_type(F.col("raw")).alias("hash_type")).agg(F.count(F.lit(1)).alias("n"))


def _fp(c: str, mask: str = "281474976710655") -> str:
    """The 48-bit fingerprint in DuckDB; the bytes of a text by the digits of its hex form."""
    h = f"hex(encode({c}))"
    byte = f"('0x' || substr({h}, 2 * i + 1, 2))::BIGINT"
    basis = 1469598103934665603 & (1 << 48) - 1
    return f"lower(printf('%0{12 if mask.startswith('28') else 6}x', list_reduce(list_transform(range(0, (length({h}) // 2)::BIGINT), lambda i: {byte}), lambda a, b: ((((xor(a, b) & 255) << 40) + xor(a, b) * 435) & 281474976710655), {basis}::BIGINT) & {mask}))"


@query("q_safe_label_fp", f"SELECT conv_id, turn, 'communication:' || {_fp('k')} AS label FROM (SELECT conv_id, turn, conv_id || '/' || turn || '/' || role AS k FROM conversations)")
def q_safe_label_fp(s, d):
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role")
    return table(s, d, "conversations").select("conv_id", "turn", tx.safe_label(F.lit("communication"), key).alias("label"))


# -- records -------------------------------------------------------------------------------------------------


def _records(s, d):
    o, c, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    flat = j.select("o_orderkey", F.col("c_name").alias("Customer_ID"), F.col("n_name").alias("city"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("transaction_id"), F.col("o_orderstatus").alias("order_status"))
    return read_table(flat, "orders", "o_orderkey")


_FLAT = "fl AS (SELECT o_orderkey, c_name, n_name, 'order-' || o_orderkey AS pay, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


@query("q_record_extract", f"""
WITH {_FLAT}, e AS (SELECT 'person' AS kind, c_name AS label FROM fl UNION ALL SELECT 'location', n_name FROM fl UNION ALL SELECT 'payment', pay FROM fl)
SELECT kind, label, count(*) AS records FROM e GROUP BY ALL
""")
def q_record_extract(s, d):
    return extract.extract_entities(_records(s, d)).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("records"))


@query("q_cooccurrence_links", f"""
WITH {_FLAT}, l AS (SELECT {eid('person', 'c_name')} AS source_id, 'resides_in' AS rel_type, {eid('location', 'n_name')} AS target_id, 0.6 AS confidence FROM fl
  UNION ALL SELECT {eid('payment', 'pay')}, 'at_location', {eid('location', 'n_name')}, 0.5 FROM fl) SELECT DISTINCT source_id, rel_type, target_id, confidence::DOUBLE AS confidence FROM l
""")
def q_cooccurrence_links(s, d):
    links = extract.infer_links(extract.extract_entities(_records(s, d)))
    edges = links.select(graph.entity_id(F.col("source_key")).alias("source_id"), "rel_type", graph.entity_id(F.col("target_key")).alias("target_id"), "confidence", F.lit(None).cast("string").alias("source_reference"), "ord")
    return graph.add_edges(edges).select("source_id", "rel_type", "target_id", "confidence")


@query("q_resolve_links", f"WITH {_FLAT} SELECT DISTINCT {eid('person', 'c_name')} AS source_id, {eid('payment', 'pay')} AS target_id FROM fl")
def q_resolve_links(s, d):
    e = extract.extract_entities(_records(s, d)).withColumn("id", graph.entity_id(F.col("dedup_key")))
    r = F.struct("batch_no", "index").alias("record")
    links = _records(s, d).select(r, F.lit("person").alias("source_kind"), extract.get_any(F.col("fields"), "customer_id").alias("source_label"), F.lit("paid").alias("rel_type"), F.lit("payment").alias("target_kind"), extract.get_any(F.col("fields"), "transaction_id").alias("target_label"), F.lit(0.6).alias("confidence"), F.col("index").alias("ord"))
    return graph.resolve_links(links, e).select("source_id", "target_id").distinct()


@query("q_json_flatten", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def q_json_flatten(s, d):
    return table(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")))


@query("q_geojson_extract", "SELECT 'vessel' AS kind, printf('vessel:%.4f,%.4f', (s_suppkey % 90)::DOUBLE, (s_suppkey % 180)::DOUBLE) AS label, (s_suppkey % 90)::VARCHAR AS latitude, (s_suppkey % 180)::VARCHAR AS longitude, count(*) AS n FROM supplier GROUP BY ALL")
def q_geojson_extract(s, d):
    k = F.col("s_suppkey")
    cols = {"type": F.lit("Feature"), "geometry.type": F.lit("Point"), "geometry.coordinates.0": k % 180, "geometry.coordinates.1": k % 90, "properties.type": F.lit("ship")}
    flat = table(s, d, "supplier").select("s_suppkey", *(v.alias(c) for c, v in cols.items()))
    e = extract.extract_entities(read_table(flat, "supplier", "s_suppkey"))
    at = lambda c: F.try_element_at("attributes", F.lit(c)).alias(c)
    return e.groupBy("kind", "label", at("latitude"), at("longitude")).agg(F.count(F.lit(1)).alias("n"))


_N = "length(regexp_replace(v, '[^0-9]', '', 'g'))"
_PHONE = rf"regexp_matches(v, '^[0-9 +().-]*$') AND {_N} BETWEEN 8 AND 15"
_CLASS = rf"""CASE WHEN v = '' THEN 'empty' WHEN len(i) = 1 THEN CASE i[1] WHEN 'account' THEN 'email' WHEN 'media' THEN 'hash' ELSE i[1] END
 WHEN regexp_matches(v, '^[^@]+@[^@]*\.[^@]*$') THEN 'email' WHEN regexp_matches(v, '^[0-9./-]*$') AND {_N} IN (11, 14) AND regexp_matches(v, '[.-]') THEN 'national_id' WHEN {_PHONE} THEN 'phone'
 WHEN (regexp_matches(v, '^\s*[$€£]') OR regexp_matches(v, '^\s*R.*\$')) AND regexp_matches(v, '[0-9]') THEN 'money'
 WHEN {_N} >= 4 AND regexp_matches(v, '[-/:T]') AND length(regexp_replace(v, '[^A-Za-z]', '', 'g')) <= 3 AND octet_length(encode(v)) BETWEEN 6 AND 40 THEN 'date'
 WHEN lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n', 'sim', 'não', 'nao', '0', '1') THEN 'boolean'
 WHEN (regexp_matches(v, '^[0-9a-fA-F-]{{36}}$') AND length(regexp_replace(v, '[^-]', '', 'g')) = 4) OR (regexp_matches(v, '^[A-Za-z0-9_-]{{8,}}$') AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')) THEN 'id'
 WHEN regexp_matches(replace(v, ',', ''), '^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)$') THEN 'number'
 WHEN regexp_matches(v, '^\s*(?:\p{{Lu}}[\p{{L}}.''-]*|[\p{{L}}.''-]{{1,3}})(?:\s+(?:\p{{Lu}}[\p{{L}}.''-]*|[\p{{L}}.''-]{{1,3}})){{0,3}}\s*$') AND octet_length(encode(v)) <= 48 AND length(regexp_replace(v, '[^\p{{L}}]', '', 'g')) >= 2 THEN 'person_name'
 ELSE 'free_text' END"""
_CLASSIFIED = f"(SELECT *, list_filter(list_transform({_fill(_TOKENS, c='v')}, lambda t: {_fill(_KIND, t='t')}), lambda k: k IS NOT NULL) AS i FROM <src>)"


@query("q_classify_values", f"WITH c AS (SELECT p_partkey, unnest([p_name, p_brand, p_type, p_size::VARCHAR, '$' || p_size, '+1 555 ' || (1000000 + p_partkey), lpad(p_partkey::VARCHAR, 9, '0') || '-01', 'https://x.example.com/' || p_size]) AS v FROM part) SELECT {_CLASS} AS class, count(*) AS n FROM {_fill(_CLASSIFIED, src='c')} GROUP BY ALL")
def q_classify_values(s, d):
    k, z = F.col("p_partkey"), F.col("p_size").cast("string")
    v = F.array("p_name", "p_brand", "p_type", z, F.concat(F.lit("$"), z), F.concat(F.lit("+1 555 "), (k + 1_000_000).cast("string")), F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit("-01")), F.concat(F.lit("https://x.example.com/"), z))
    return table(s, d, "part").select(F.explode(v).alias("v")).groupBy(classify_value(F.col("v")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("q_profile_columns", f"""
WITH r AS (SELECT * FROM customer), c AS (SELECT 0 AS pos, 'c_name' AS name, c_name AS v FROM r UNION ALL SELECT 1, 'c_nationkey', c_nationkey::VARCHAR FROM r UNION ALL SELECT 2, 'c_mktsegment', c_mktsegment FROM r),
t AS (SELECT name, pos, v, {_CLASS} AS k FROM {_fill(_CLASSIFIED, src='c')}), n AS (SELECT name, pos, k, count(*) AS n FROM t GROUP BY ALL), w AS (SELECT name, pos, arg_max(k, n) AS winner, max(n) AS top, sum(n) AS non_empty FROM n GROUP BY ALL),
u AS (SELECT name, count(DISTINCT lower(v)) AS d FROM t GROUP BY name), p AS (SELECT name, pos, winner, top / non_empty AS confidence, d / non_empty AS uniqueness, non_empty::BIGINT AS non_empty FROM w JOIN u USING (name)),
z AS (SELECT *, CASE WHEN regexp_matches(name, 'nation') AND false THEN winner WHEN winner = 'free_text' AND uniqueness < 0.15 AND non_empty > 10 THEN 'categorical' WHEN winner = 'free_text' AND contains(name, 'name') THEN 'person_name' ELSE winner END AS semantic FROM p)
SELECT name, semantic, round(confidence, 6) AS confidence, round(uniqueness, 6) AS uniqueness, non_empty, CASE semantic WHEN 'person_name' THEN 'person' WHEN 'phone' THEN 'account' END AS kind,
 name = (SELECT name FROM z ORDER BY CASE WHEN semantic = 'person_name' THEN 0 WHEN contains(name, 'name') THEN 1 ELSE 2 END, pos LIMIT 1) AS is_primary FROM z
""")
def q_profile_columns(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("row"), "c_name", "c_nationkey", "c_mktsegment")
    p = extract.profile_columns(extract.cells_of(c, "row"), sample=None)
    return p.select("name", "semantic", F.round("confidence", 6).alias("confidence"), F.round("uniqueness", 6).alias("uniqueness"), "non_empty", "kind", "is_primary")


# -- names and feeds -------------------------------------------------------------------------------------------


_HOST = r"regexp_extract(lower(trim(url)), '^(?:https?://|www\.)*([^/:?#]*)', 1)"


@query("q_url_host_domain", f"SELECT page_id, {_HOST} AS host, array_to_string(string_split({_HOST}, '.')[-2:], '.') AS registrable FROM pages")
def q_url_host_domain(s, d):
    h = tx.url_host(F.col("url"))
    return table(s, d, "pages").select("page_id", h.alias("host"), tx.registrable_domain(h).alias("registrable"))


@query("q_domain_hubs", f"WITH u AS (SELECT DISTINCT lower(regexp_replace(trim(url), '\\s+', ' ', 'g')) AS url FROM pages) SELECT array_to_string(string_split({_HOST}, '.')[-2:], '.') AS domain, count(*) AS urls FROM u GROUP BY ALL")
def q_domain_hubs(s, d):
    e = graph.upsert_entities(rows(table(s, d, "pages"), "url", F.col("url"), F.col("page_id")))
    new, edges = enrich.domain_hubs(e)
    return edges.join(new, F.col("target_id") == F.col("id")).groupBy(F.col("label").alias("domain")).agg(F.count(F.lit(1)).alias("urls"))


@query("q_ref_exact", """
WITH r AS (SELECT DISTINCT md5(unnest(string_split(text, chr(10)))) AS h FROM benchmark), i AS (SELECT doc_id, md5(unnest(string_split(text, chr(10)))) AS h FROM documents)
SELECT doc_id, h AS hash, count(*) AS n FROM i JOIN r USING (h) GROUP BY ALL
""")
def q_ref_exact(s, d):
    lines = lambda t, k: table(s, d, t).select(k, F.explode(F.split("text", "\n", -1)).alias("l")).select(k, F.md5(F.col("l").cast("binary")).alias("hash"))
    groups = lines("benchmark", "item_id").select(F.array("hash").alias("values"), F.lit("hash").alias("kind"), F.lit("benchmark").alias("source"), F.lit("known").alias("category"), F.lit(None).cast("string").alias("severity"), F.col("item_id").alias("ord"))
    items = lines("documents", "doc_id").select(F.struct("doc_id", "hash").alias("id"), "hash")
    hit = enrich.match_exact(items, enrich.load_refs(groups))
    return hit.groupBy(F.col("id.doc_id").alias("doc_id"), F.col("id.hash").alias("hash")).agg(F.count(F.lit(1)).alias("n"))


def _signs(s, d):
    """A 64-bit hash of each vector: the signs of its components."""
    bits = F.aggregate(F.slice("embedding", 1, 64), F.lit(0).cast("long"), lambda n, x: F.shiftleft(n, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    return table(s, d, "embeddings").select("vec_id", "label", F.lower(F.lpad(F.hex(bits), 16, "0")).alias("hash"))


_SIGN = "list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
_NEAR = f"sg AS (SELECT vec_id, label, {_SIGN} AS b FROM embeddings), nr AS (SELECT i.vec_id, r.vec_id AS ref, list_sum(list_transform(list_zip(i.b, r.b), lambda z: CASE WHEN z[1] = z[2] THEN 0 ELSE 1 END))::BIGINT AS dist FROM sg i JOIN sg r ON i.label != 0 AND r.label = 0)"


def _sign_refs(s, d):
    g = _signs(s, d).where("label = 0").select(F.array("hash").alias("values"), F.lit("perceptual").alias("kind"), F.lit("feed").alias("source"), F.lit("known").alias("category"), F.lit("high").alias("severity"), F.col("vec_id").alias("ord"))
    return enrich.load_refs(g)


@query("q_ref_perceptual", f"WITH {_NEAR} SELECT vec_id, min(dist)::INT AS distance, round(1 - min(dist) / 64.0, 6) AS similarity FROM nr WHERE dist <= 18 GROUP BY vec_id")
def q_ref_perceptual(s, d):
    items = _signs(s, d).where("label != 0").select(F.col("vec_id").alias("id"), "hash")
    out = enrich.match_perceptual(items, _sign_refs(s, d), 18)
    return out.select(F.col("id").alias("vec_id"), "distance", F.round("similarity", 6).alias("similarity"))


@query("q_calibration_phash", f"""
WITH {_NEAR}, n AS (SELECT vec_id, min(dist) AS d FROM nr WHERE dist <= 18 GROUP BY vec_id), v AS (SELECT d, count(*) AS c FROM n GROUP BY d), g AS (SELECT d, coalesce(lead(d) OVER (ORDER BY d) - d, 0) AS g FROM v),
r AS (SELECT CASE WHEN (SELECT count(*) FROM n) = 1 THEN min(d) + 2 WHEN max(g) >= 4 THEN arg_max(d, g * 1000 - d) ELSE 10 END AS recommended FROM g)
SELECT b AS bits, (SELECT count(*) FROM n WHERE d <= b) AS matches, recommended::INT AS recommended FROM (SELECT unnest([4, 6, 8, 10, 12, 16]) AS b), r
""")
def q_calibration_phash(s, d):
    items = _signs(s, d).where("label != 0").select(F.col("vec_id").alias("id"), "hash")
    return risk.distance_curve(enrich.match_perceptual(items, _sign_refs(s, d), 18).select("distance"))


# -- governance --------------------------------------------------------------------------------------------------


_HINTS = ["completely reliable", "Usually reliable", "fairly reliable", "not usually reliable", "unreliable", "cannot be judged", "D"]
_CRED = ["confirmed", "probably true", "possibly true", "doubtful", "improbable", "unconfirmed", "hearsay"]


@query("q_admiralty", """
WITH r AS (SELECT doc_id, ['A','B','C','B','E','F','D'][(doc_id % 7 + 1)::INT] AS s, ['1','2','3','4','5','1','3'][((doc_id // 7) % 7 + 1)::INT] AS i FROM documents) SELECT doc_id, s || i AS grade FROM r
""")
def q_admiralty(s, d):
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k + 1).cast("int"))
    k = F.col("doc_id")
    attrs = F.create_map(F.lit("source_reliability"), pick(_HINTS, k % 7), F.lit("credibility"), pick(_CRED, F.floor(k / 7) % 7))
    e = table(s, d, "documents").select(k.alias("id"), F.lit("report").alias("kind"), attrs.alias("attributes"), F.array("source").alias("sources"))
    return govern.admiralty(e).select(F.col("id").alias("doc_id"), "grade")


_MASK = rf"""CASE WHEN regexp_matches(regexp_replace(t, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'), '^[^@]*@[^@]*\.[^@]*$') THEN '[email:' || {_fp('lower(trim(t))', '16777215')} || ']'
 WHEN regexp_matches(t, '^[0-9+() -]+$') AND length(regexp_replace(t, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 THEN '[phone]'
 WHEN regexp_matches(t, '^[0-9.-]+$') AND length(regexp_replace(t, '[^0-9]', '', 'g')) IN (9, 11) AND regexp_matches(t, '[.-]') THEN '[id]' ELSE t END"""


@query("q_redact", f"""
WITH k AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\s|\\S+')) AS t, generate_subscripts(regexp_extract_all(text, '\\s|\\S+'), 1) AS i FROM documents), m AS (SELECT doc_id, i, t, {_MASK} AS x FROM k)
SELECT doc_id, sha256(string_agg(x, '' ORDER BY i)) AS redacted_sha256, count(*) FILTER (x != t) AS masked FROM m GROUP BY doc_id
""")
def q_redact(s, d):
    docs = table(s, d, "documents").select("doc_id", tx.redact_patterns(F.col("text")).alias("r"))
    masks = F.regexp_count("r", F.lit(r"(?:^|\s)\[(?:email:[0-9a-f]{6}|phone|id)\](?=\s|$)"))
    return docs.select("doc_id", F.sha2(F.col("r").cast("binary"), 256).alias("redacted_sha256"), masks.cast("long").alias("masked"))


@query("q_redact_entities", f"""
WITH e AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Ann Lee ' || chr((65 + s_suppkey % 26)::INT) || 'o' ELSE s_name END AS label, s_suppkey || '@mail.example' AS mail FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'PERSON-' || {_fp('lower(trim(label))', '16777215')} ELSE label END AS label, '[email:' || {_fp('lower(trim(mail))', '16777215')} || ']' AS mail, '1.5' AS lat FROM e
""")
def q_redact_entities(s, d):
    k = F.col("s_suppkey")
    label = F.when(k % 2 == 0, F.concat(F.lit("Ann Lee "), F.chr(65 + k % 26), F.lit("o"))).otherwise(F.col("s_name"))
    e = table(s, d, "supplier").select("s_suppkey", F.lit("person").alias("kind"), label.alias("label"), F.create_map(F.lit("mail"), F.concat(k.cast("string"), F.lit("@mail.example")), F.lit("lat"), F.lit("1.5")).alias("attributes"))
    return govern.redact(e).select("s_suppkey", "label", F.col("attributes")["mail"].alias("mail"), F.col("attributes")["lat"].alias("lat"))


def _audit(s, broken: int | None):
    kinds = ["ingest", "classify", "extract", "enrich", "correlate", "resolve", "export"]
    made = govern.build_chain([{"audit_event_id": f"aud-{i}", "timestamp": f"2024-01-01T00:00:{i:02d}+00:00", "user_id": "operator", "action_performed": k, "stage": k, "entity_scope": "all", "sensitive_data_viewed": i % 3 == 0} for i, k in enumerate(kinds)])
    if broken:
        made[broken - 1]["entity_scope"] = "some"
    cols = "seq long, audit_event_id string, timestamp string, user_id string, action_performed string, stage string, entity_scope string, sensitive_data_viewed boolean, prev_hash string, hash string"
    return s.createDataFrame([(i + 1, e["audit_event_id"], e["timestamp"], e["user_id"], e["action_performed"], e["stage"], e["entity_scope"], e["sensitive_data_viewed"], e["prev_hash"], e["hash"]) for i, e in enumerate(made)], cols)


@query("q_audit_chain", "SELECT * FROM (VALUES ('whole', 7, NULL, NULL), ('altered', 7, 4, 'altered')) t(log, events, broken_at, reason)")
def q_audit_chain(s, d):
    one = lambda name, b: govern.verify_chain(_audit(s, b)).select(F.lit(name).alias("log"), F.col("events").cast("int").alias("events"), F.col("broken_at").cast("int").alias("broken_at"), "reason")
    return one("whole", None).unionByName(one("altered", 4))


@query("q_sensitive_touches", "SELECT 3 AS sensitive_touches")
def q_sensitive_touches(s, d):
    return govern.sensitive_touches(_audit(s, None)).select(F.col("sensitive_touches").cast("int").alias("sensitive_touches"))


@query("q_retention", "SELECT o_orderkey, (o_orderdate::DATE + 365)::DATE AS disposal_date FROM orders")
def q_retention(s, d):
    return table(s, d, "orders").select("o_orderkey", govern.disposal_date(F.col("o_orderdate"), 365).alias("disposal_date"))


# -- transforms, agents ------------------------------------------------------------------------------------------


_D = "substr(v, {i}, 1)::INT"


def _check(n: int) -> str:
    return "((" + " + ".join(f"{_D.format(i=i)} * {n + 2 - i}" for i in range(1, n + 1)) + ") * 10 % 11 % 10)"


@query("q_transform_cpf", f"WITH c AS (SELECT o_orderkey, lpad((o_orderkey * 48611 + o_custkey)::VARCHAR, 11, '0') AS v FROM orders) SELECT o_orderkey, length(v) = 11 AND NOT regexp_matches(v, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') AND {_check(9)} = {_D.format(i=10)} AND {_check(10)} = {_D.format(i=11)} AS valid FROM c")
def q_transform_cpf(s, d):
    v = F.lpad((F.col("o_orderkey") * 48611 + F.col("o_custkey")).cast("string"), 11, "0")
    return table(s, d, "orders").select("o_orderkey", valid_cpf(v).alias("valid"))


@query("q_transform_ssn", "WITH c AS (SELECT o_orderkey, lpad((o_orderkey * 65537 % 1000000000)::VARCHAR, 9, '0') AS v FROM orders) SELECT o_orderkey, NOT (substr(v, 1, 3) IN ('000', '666') OR substr(v, 1, 1) = '9' OR substr(v, 4, 2) = '00' OR substr(v, 6, 4) = '0000') AS valid FROM c")
def q_transform_ssn(s, d):
    return table(s, d, "orders").select("o_orderkey", valid_ssn(F.lpad((F.col("o_orderkey") * 65537 % 1_000_000_000).cast("string"), 9, "0")).alias("valid"))


@query("q_transform_names", f"""
WITH p AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS w FROM part), a AS (SELECT p_name, unnest([w[1] || '.' || w[-1], w[1] || w[-1], w[1][1] || w[-1], w[1] || '_' || w[-1]]) || '@corp.example' AS label FROM p WHERE len(w) >= 2)
SELECT {eid('person', 'p_name')} AS source_id, label FROM a
""")
def q_transform_names(s, d):
    e = graph.upsert_entities(rows(table(s, d, "part"), "person", F.col("p_name"), F.col("p_partkey"), {"domain": F.lit("corp.example")}))
    return transforms.run_transform(e, "corporate_addresses").select("source_id", "label")


@query("q_transform_email_domain", f"""
WITH a AS (SELECT DISTINCT user_id || '@' || event_type || '.example' AS label, event_type || '.example' AS d FROM events) SELECT {eid('account', 'label')} AS source_id, d AS label, 'uses_email_domain' AS rel_type, 0.9::DOUBLE AS confidence FROM a
""")
def q_transform_email_domain(s, d):
    label = F.concat(F.col("user_id").cast("string"), F.lit("@"), "event_type", F.lit(".example"))
    e = graph.upsert_entities(rows(table(s, d, "events"), "account", label, F.col("event_id")))
    return transforms.run_transform(e, "email_domain").select("source_id", "label", "rel_type", "confidence")


_AGENTS = [("triage", "Triage", "first look", ["*"], ["intake"], [], True), ("wallets", "Wallet tracer", "follow payments", ["fraud"], ["money"], ["wallet", "payment"], False), ("hosts", "Host hunter", "devices and addresses", ["cybersecurity"], ["net"], ["ip", "device"], True), ("accounts", "Account linker", "same actor", ["fraud", "cybersecurity"], ["identity"], ["account"], False)]


def _agents(s):
    return s.createDataFrame([(*a, "body") for a in _AGENTS], "id string, name string, description string, domains array<string>, tags array<string>, triggers array<string>, auto boolean, body string")


@query("q_agent_recommend", "SELECT * FROM (VALUES ('wallets', 4.0, 1), ('accounts', 4.0, 1), ('triage', 1.5, 0)) t(id, score, hits)")
def q_agent_recommend(s, d):
    return transforms.recommend(_agents(s), "fraud", ["payment", "account", "device"], 3).select("id", F.col("score").cast("decimal(2,1)").alias("score"), "hits")


@query("q_agent_library", "SELECT * FROM (VALUES ('accounts')) t(id)")
def q_agent_library(s, d):
    return transforms.library(_agents(s), "cybersecurity", "IDENT").select("id")


@query("q_kind_parse", "SELECT role, CASE role WHEN 'user' THEN 'account' ELSE 'unknown' END AS kind, count(*) AS n FROM conversations GROUP BY ALL")
def q_kind_parse(s, d):
    return table(s, d, "conversations").groupBy("role", graph.parse_kind(F.col("role")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("q_plain_text", r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(translate(text, 'áàâãäÁÀÂÃÄéèêëÉÈÊËíìîïÍÌÎÏóòôõöÓÒÔÕÖúùûüÚÙÛÜçÇñÑ', 'aaaaaaaaaaeeeeeeeeiiiiiiiioooooooooouuuuuuuuccnn')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))) AS plain_md5 FROM documents
""")
def q_plain_text(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(tx.plain(F.col("text")).cast("binary")).alias("plain_md5"))


@query("q_windowed_activity", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_windowed_activity(s, d):
    out = stream.windowed_activity(table(s, d, "events"))
    return out.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("q_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, k
""")
def q_sessions(s, d):
    return stream.sessions(table(s, d, "events")).select("user_id", "start", "n")
