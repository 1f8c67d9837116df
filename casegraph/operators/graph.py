"""The property graph as two DataFrames: upserting entities, adding edges, degrees, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key

MAP, STRINGS = "map<string,string>", "array<string>"

# Other spellings of the kinds, and the bands' lower bounds.
KINDS = (
    "case", "report", "person", "victim", "suspect", "account", "device", "ip", "url",
    "domain", "media", "evidence", "communication", "group", "payment", "wallet", "location", "organization",
    "malware", "vulnerability", "incident", "service", "repository", "aircraft", "vessel", "facility", "sensor",
    "selector", "unknown",
)
ALIASES = {
    "report": ("tip", "complaint"),
    "person": ("individual", "people"),
    "suspect": ("offender", "actor", "threat_actor"),
    "account": ("profile", "user", "username", "handle"),
    "device": ("host", "endpoint"),
    "ip": ("ip_address", "ipv4", "ipv6"),
    "url": ("link", "uri"),
    "domain": ("hostname", "fqdn"),
    "media": ("file", "image", "video", "audio", "document"),
    "evidence": ("exhibit", "artifact"),
    "communication": ("message", "chat", "email"),
    "group": ("channel", "community", "server"),
    "payment": ("transaction", "transfer"),
    "wallet": ("crypto_wallet", "address"),
    "location": ("place", "geo"),
    "organization": ("org", "company", "merchant"),
    "malware": ("sample", "payload"),
    "vulnerability": ("cve", "vuln"),
    "incident": ("event", "alert"),
    "service": ("cloud_service", "saas"),
    "repository": ("repo", "github"),
    "aircraft": ("flight", "airplane", "plane", "uav", "drone"),
    "vessel": ("ship", "boat", "maritime"),
    "facility": ("asset", "site", "base", "unit", "installation", "cctv", "camera"),
    "sensor": ("feed", "camera_feed"),
    "selector": ("imei", "imsi", "msisdn", "phone"),
}
BANDS = (("critical", 0.85), ("high", 0.60), ("medium", 0.35))


def parse_kind(c: Column) -> Column:
    names = {k: k for k in KINDS} | {a: k for k, aliases in ALIASES.items() for a in aliases}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.lower(F.trim(c))), F.lit("unknown"))


def risk_band(c: Column) -> Column:
    out = None
    for name, least in BANDS:
        out = F.when(c >= least, name) if out is None else out.when(c >= least, name)
    return out.otherwise("low")


def dedup_key(kind: Column, label: Column, document: Column | None = None) -> Column:
    key = F.concat(kind, F.lit("::"), normalize_key(label))
    return key if document is None else F.concat_ws("::", key, F.when(document != "", document))


def entity_id(key: Column) -> Column:
    return F.concat(F.lit("ent-"), F.substr(F.sha2(key.cast("binary"), 256), F.lit(1), F.lit(32)))


def edge_id(source: Column, rel: Column, target: Column) -> Column:
    return F.concat(F.lit("rel-"), F.substr(F.sha2(F.concat_ws("|", source, rel, target).cast("binary"), 256), F.lit(1), F.lit(32)))


def _first_seen(rows: DataFrame, column: str) -> DataFrame:
    """The distinct strings of an array column by key, in the order first seen."""
    one = rows.select("dedup_key", "ord", F.posexplode(column).alias("pos", "x"))
    first = one.groupBy("dedup_key", "x").agg(F.min(F.struct("ord", "pos")).alias("o"))
    return first.groupBy("dedup_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda s: s["x"]).alias(column))


def upsert_entities(rows: DataFrame) -> DataFrame:
    """Entities from rows (kind, label, dedup_key, attributes, tags, sources, sensitive, ord).

    The first row by ord gives id, kind and label; of attributes the first value of each key stays; tags and sources
    are united in the order seen. Attributes, tags and sources are reduced by key and value before they are gathered,
    so what meets in one row is the entity's distinct values. Without rows there are no entities.
    """
    base = rows.groupBy("dedup_key").agg(F.min_by("kind", "ord").alias("kind"), F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"), F.bool_or("sensitive").alias("sensitive"))
    pairs = rows.select("dedup_key", "ord", F.explode("attributes").alias("k", "v")).groupBy("dedup_key", "k").agg(F.min_by("v", "ord").alias("v"), F.min("ord").alias("o"))
    attributes = pairs.groupBy("dedup_key").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("o", "k", "v"))), lambda s: F.struct(s["k"], s["v"]))).alias("attributes"))
    out = base.join(attributes, "dedup_key", "left").join(_first_seen(rows, "tags"), "dedup_key", "left").join(_first_seen(rows, "sources"), "dedup_key", "left")
    return out.select(
        entity_id(F.col("dedup_key")).alias("id"), "ord", "kind", "label", "dedup_key", F.coalesce("attributes", F.create_map().cast(MAP)).alias("attributes"),
        F.coalesce("tags", F.array().cast(STRINGS)).alias("tags"), F.coalesce("sources", F.array().cast(STRINGS)).alias("sources"), F.coalesce("sensitive", F.lit(False)).alias("sensitive"),
    )


def add_edges(edges: DataFrame) -> DataFrame:
    """Edges (source_id, rel_type, target_id, confidence, source_reference, ord) without repeats: the first by ord stays.

    An aggregate rather than a window: a pair's repeats are reduced before the shuffle.
    """
    first = F.min_by(F.struct("confidence", "source_reference"), "ord")
    out = edges.groupBy("source_id", "rel_type", "target_id").agg(first.alias("f"), F.min("ord").alias("ord"))
    return out.select("source_id", "rel_type", "target_id", F.least(F.greatest(F.col("f.confidence"), F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.col("f.source_reference").alias("source_reference"), "ord")


def ends(edges: DataFrame) -> DataFrame:
    """(node, other, rel_type) in both directions."""
    a, b = F.col("source_id"), F.col("target_id")
    return edges.select(a.alias("node"), b.alias("other"), "rel_type").unionAll(edges.select(b.alias("node"), a.alias("other"), "rel_type"))


def degrees(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): both ends of every edge count, parallel ones too; entities without an edge have 0."""
    n = ends(edges).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return entities.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b): each connected pair once, a < b, without loops."""
    return edges.where("source_id != target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()


def resolve_links(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges from links (record, source_kind, source_label, rel_type, target_kind, target_label, confidence, ord) and a
    record's entities (record, kind, label, id, pos): labels are matched within the record and kind; of several the
    last by pos. Links without both ends are dropped."""
    known = entities.groupBy("record", "kind", normalize_key(F.col("label")).alias("key")).agg(F.max_by("id", "pos").alias("id"))
    side = lambda name: known.select("record", F.col("kind").alias(f"{name}_kind"), F.col("key").alias(f"{name}_key"), F.col("id").alias(f"{name}_id"))
    keyed = links.withColumns({"source_key": normalize_key(F.col("source_label")), "target_key": normalize_key(F.col("target_label"))})
    return keyed.join(side("source"), ["record", "source_kind", "source_key"]).join(side("target"), ["record", "target_kind", "target_key"]).select("source_id", "rel_type", "target_id", "confidence", "ord")


def merge_entities(entities: DataFrame, edges: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after merging aliases (alias_id) into canonical_id: one relabelling join for all merges.

    An alias's attributes fill gaps and its sources are added; its tags and sensitivity aren't carried. Edges are
    rewired, loops and repeats dropped; the survivor gets the tag resolved-identity. A canonical id may itself be an alias.
    """
    from .components import connected_components

    # chains of merges end at the one that is nobody's alias
    reps = connected_components(merged.select(F.col("canonical_id").alias("a"), F.col("alias_id").alias("b")))
    roots = merged.select("canonical_id").distinct().join(merged.select(F.col("alias_id").alias("canonical_id")), "canonical_id", "left_anti")
    root_of = reps.join(roots.join(reps, F.col("canonical_id") == F.col("node")).select("rep", F.col("canonical_id").alias("root")), "rep").select("node", "root").where("node != root")
    named = entities.join(root_of, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).withColumn("alias", F.col("id") != F.col("root"))
    key = entities.select(F.col("id").alias("root"), F.col("dedup_key").alias("root_key"))
    rows = named.join(key, "root").select(
        F.col("root_key").alias("dedup_key"), "kind", "label", "attributes", F.when(F.col("alias"), F.array(F.lit("resolved-identity"))).otherwise(F.col("tags")).alias("tags"), "sources",
        (~F.col("alias") & F.col("sensitive")).alias("sensitive"), F.struct(F.col("alias").alias("alias"), F.col("ord").alias("ord")).alias("ord"),
    )
    out = upsert_entities(rows).withColumn("ord", F.col("ord.ord"))
    to = lambda c: root_of.select(F.col("node").alias(f"n_{c}"), F.col("root").alias(f"r_{c}"))
    wired = edges.join(to("s"), F.col("source_id") == F.col("n_s"), "left").join(to("t"), F.col("target_id") == F.col("n_t"), "left")
    wired = wired.select(F.coalesce("r_s", "source_id").alias("source_id"), "rel_type", F.coalesce("r_t", "target_id").alias("target_id"), "confidence", "source_reference", "ord").where("source_id != target_id")
    return out, add_edges(wired)
