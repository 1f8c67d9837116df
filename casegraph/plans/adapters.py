"""The test tables read as entities, edges and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import MAP, STRINGS, add_edges, dedup_key, entity_id, upsert_entities

#: DuckDB macros that stand in for ids and the like.
EID = "'ent-' || substr(sha256({kind} || '::' || lower({label})), 1, 32)"


def eid(kind: str, label: str) -> str:
    return "'ent-' || substr(sha256('" + kind + "::' || lower(" + label + ")), 1, 32)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(df: DataFrame, kind: str, label: Column, order: Column, attributes: dict[str, Column] | None = None, sources: Column | None = None, tags: Column | None = None) -> DataFrame:
    """Rows for upsert_entities from a table."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (attributes or {}).items()))
    made = F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull())) if attributes else F.create_map().cast(MAP)
    empty = F.array().cast(STRINGS)
    return df.select(F.lit(kind).alias("kind"), label.alias("label"), dedup_key(F.lit(kind), label).alias("dedup_key"), made.alias("attributes"), (tags if tags is not None else empty).alias("tags"), (sources if sources is not None else empty).alias("sources"), F.lit(False).alias("sensitive"), order.cast("long").alias("ord"))


def node(kind: str, label: Column) -> Column:
    return entity_id(dedup_key(F.lit(kind), label))


def edge(df: DataFrame, source: Column, rel: str, target: Column, confidence: float, reference: Column, order: Column) -> DataFrame:
    return df.select(source.alias("source_id"), F.lit(rel).alias("rel_type"), target.alias("target_id"), F.lit(confidence).alias("confidence"), reference.cast("string").alias("source_reference"), order.cast("long").alias("ord"))


# -- events: accounts that use devices -----------------------------------------------------------------------


def account(c: Column) -> Column:
    return F.concat(F.lit("user-"), c.cast("string"))


def device() -> Column:
    return F.concat_ws("-", F.lit("dev"), F.get_json_object("props", "$.k"), F.date_format("ts", "yyyy-MM-dd"))


def event_edges(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return add_edges(edge(ev, node("account", account(F.col("user_id"))), "uses_device", node("device", device()), 0.7, F.concat(F.lit("events#"), "event_id"), F.col("event_id")))


def event_entities(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    a = rows(ev, "account", account(F.col("user_id")), F.col("event_id"), {"event_type": F.col("event_type"), "timestamp": stamp}, F.array(F.concat(F.lit("events:"), "event_type")))
    return upsert_entities(a.unionByName(rows(ev, "device", device(), F.col("event_id"))))


EVENTS = f"""
ev AS (SELECT event_id, ts, user_id, event_type, value, 'user-' || user_id AS acct, 'dev-' || json_extract_string(props, '$.k') || '-' || strftime(ts, '%Y-%m-%d') AS dev FROM events),
ee AS (SELECT {eid('account', 'acct')} AS a, {eid('device', 'dev')} AS d, acct, dev, min(event_id) AS first, count(*) AS n FROM ev GROUP BY ALL),
nn AS (SELECT a AS id, acct AS label, 'account' AS kind, min(first) AS ord FROM ee GROUP BY ALL UNION ALL SELECT d, dev, 'device', min(first) FROM ee GROUP BY ALL),
en AS (SELECT a AS node, d AS other FROM ee UNION ALL SELECT d, a FROM ee),
dg AS (SELECT nn.id, nn.label, nn.kind, nn.ord, count(en.node) AS degree FROM nn LEFT JOIN en ON nn.id = en.node GROUP BY ALL)"""


# -- orders: customers that pay ------------------------------------------------------------------------------


def customer_name(c: Column) -> Column:
    return F.concat(F.lit("customer-"), c.cast("string"))


def order_name(c: Column) -> Column:
    return F.concat(F.lit("order-"), c.cast("string"))


def order_entities(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    pay = rows(o, "payment", order_name(F.col("o_orderkey")), F.col("o_orderkey"), {"order_status": F.col("o_orderstatus"), "amount": F.col("o_totalprice"), "priority": F.col("o_orderpriority")}, F.array(F.lit("orders")))
    own = rows(c, "account", customer_name(F.col("c_custkey")), F.col("c_custkey"), {"customer_type": F.col("c_mktsegment")}, F.array(F.lit("customer")))
    return upsert_entities(pay.unionByName(own))


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return add_edges(edge(o, node("account", customer_name(F.col("o_custkey"))), "paid", node("payment", order_name(F.col("o_orderkey"))), 0.6, F.lit("orders"), F.col("o_orderkey")))


ORDERS = f"""
oe AS (SELECT {eid('account', "'customer-' || o_custkey")} AS a, {eid('payment', "'order-' || o_orderkey")} AS p, o_custkey, o_orderkey, o_totalprice FROM orders),
on_ AS (SELECT {eid('payment', "'order-' || o_orderkey")} AS id, 'payment' AS kind, 'order-' || o_orderkey AS label, o_orderkey AS ord,
  lower('order_status ' || o_orderstatus || ' amount ' || o_totalprice || ' priority ' || o_orderpriority || ' order-' || o_orderkey) AS hay FROM orders
  UNION ALL SELECT {eid('account', "'customer-' || c_custkey")}, 'account', 'customer-' || c_custkey, c_custkey, lower('customer_type ' || c_mktsegment || ' customer-' || c_custkey) FROM customer),
od AS (SELECT on_.*, coalesce(n, 0) AS degree FROM on_ LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT a AS id FROM oe UNION ALL SELECT p FROM oe) GROUP BY id) USING (id))"""


# -- regions, nations, suppliers, customers: a forest ----------------------------------------------------------


def place_nodes(spark: SparkSession, d: str) -> DataFrame:
    r, n, s, c = (table(spark, d, t) for t in ("region", "nation", "supplier", "customer"))
    one = lambda df, p, k: df.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.concat(F.lit(p), F.lpad(F.col(k).cast("string"), 12, "0")).alias("ord"))
    return one(r, "r", "r_regionkey").unionAll(one(n, "n", "n_nationkey")).unionAll(one(s, "s", "s_suppkey")).unionAll(one(c, "c", "c_custkey"))


def place_pairs(spark: SparkSession, d: str) -> DataFrame:
    n, s, c = (table(spark, d, t) for t in ("nation", "supplier", "customer"))
    one = lambda df, p, a, q, b: df.select(F.concat(F.lit(p), F.col(a).cast("string")).alias("x"), F.concat(F.lit(q), F.col(b).cast("string")).alias("y"))
    e = one(n, "n", "n_nationkey", "r", "n_regionkey").unionAll(one(s, "s", "s_suppkey", "n", "s_nationkey")).unionAll(one(c, "c", "c_custkey", "n", "c_nationkey"))
    return e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


PLACES = """
pn AS (SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier UNION ALL SELECT 'c' || c_custkey FROM customer),
pe AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT 'n' || n_nationkey AS x, 'r' || n_regionkey AS y FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer))"""
