"""Records to typed entities and links: declared fields, free-text indicators, co-occurrence rules, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SENSITIVE, hash_type, indicators, is_hash, rlike, safe_label
from ..functions.values import CLASSES, NAME_HINT, class_kind, classify_value, header_semantic
from .graph import MAP, STRINGS, dedup_key, parse_kind

# Candidate columns of each rule in order, attributes that are kept, and links by co-occurrence.
FIELD_MAP = (
    ("case", "case_id", "case_title"), ("report", "report_id", "platform_report_id"), ("victim", "victim_id"), ("suspect", "suspect_id"),
    ("person", "full_name", "name", "person_id", "user_id", "user id", "student_id", "student id", "customer_id", "employee_id"),
    ("account", "account_id", "username", "email", "discord_username", "discord username", "platform_user_id", "discord_user_id", "discord user id"),
    ("device", "device_id", "device_identifier_hash", "hostname"), ("ip", "ip_address"), ("url", "url_id", "full_url", "normalized_url", "profile_url"),
    ("domain", "domain"), ("media", "media_id", "sha256", "perceptual_hash"), ("evidence", "evidence_id"), ("communication", "communication_id", "conversation_id"),
    ("group", "group_id", "group_name"), ("wallet", "wallet_address", "wallet_cluster_id"), ("payment", "financial_event_id", "transaction_id"),
    ("location", "location_id", "latitude_approx", "city"), ("organization", "provider_record_id", "provider_name"), ("vulnerability", "vulnerability", "cve"),
    ("incident", "incident_id", "network_event_id"), ("aircraft", "icao24", "callsign", "aircraft_id", "flight", "tail_number"),
    ("vessel", "mmsi", "vessel_id", "vessel_name", "imo"), ("facility", "facility_id", "facility", "asset_id", "site_id", "site", "base", "camera_id", "cctv_id"),
    ("sensor", "sensor_id", "sensor", "feed_id"), ("selector", "imei", "imsi", "msisdn", "selector", "phone_number"),
)
ATTRIBUTES = (
    "case_type", "case_status", "case_priority", "urgency_level", "source_type", "platform_name", "risk_level", "confidence_level", "status", "country", "jurisdiction_country",
    "account_status", "device_type", "media_type", "transaction_type", "url_type", "group_type", "report_category", "student_type", "student type", "created_at", "created at", "role",
    "customer_type", "order_status", "product_category", "department", "amount", "value", "currency", "transaction_amount", "total", "balance", "source_reliability", "reliability",
    "credibility", "corroboration", "source_grade", "info_grade", "reporter_type", "latitude", "longitude", "lat", "lon", "lng", "latitude_approx", "longitude_approx", "gpslatitude",
    "gpslongitude", "city", "location", "trajectory", "track", "vessel", "subject", "timestamp", "first_seen_at", "observed_at", "received_at", "date", "phone", "address", "cpf", "rg",
    "cnpj", "ssn", "ein", "document_id", "national_id",
)
DOCUMENT_KEYS = ("cpf", "rg", "cnpj", "ssn", "ein", "document_id", "national_id", "documento", "passport_number")
LINKS = (
    ("case", "has_report", "report", 0.95), ("case", "has_evidence", "evidence", 0.95), ("person", "owns_account", "account", 0.8), ("person", "resides_in", "location", 0.6),
    ("person", "identified_by", "selector", 0.9), ("suspect", "uses_account", "account", 0.75), ("account", "uses_device", "device", 0.7), ("account", "logged_in_from_ip", "ip", 0.7),
    ("account", "member_of_group", "group", 0.65), ("account", "sent", "communication", 0.6), ("communication", "contains_url", "url", 0.6), ("url", "belongs_to_domain", "domain", 0.85),
    ("url", "hosts_media", "media", 0.55), ("account", "paid", "payment", 0.6), ("payment", "to_wallet", "wallet", 0.7), ("suspect", "contacted", "victim", 0.6),
    ("device", "observed_at", "location", 0.5), ("media", "part_of_case", "case", 0.8), ("report", "references_account", "account", 0.6), ("report", "references_url", "url", 0.6),
    ("case", "involves_organization", "organization", 0.7), ("case", "has_payment", "payment", 0.7), ("organization", "operates_in", "location", 0.6),
    ("organization", "involved_in_payment", "payment", 0.6), ("payment", "at_location", "location", 0.5), ("facility", "located_in", "location", 0.6),
    ("organization", "operates_facility", "facility", 0.55),
)
_ENTITY = "array<struct<kind:string,label:string,attributes:map<string,string>,source:string,document:string>>"


def lowered(fields: Column) -> Column:
    """The field map with lower-case keys; of keys that differ in case only, the first stays."""
    entries = F.map_entries(fields)
    keys = F.transform(entries, lambda e: F.lower(e["key"]))
    first = F.filter(entries, lambda e, i: F.array_position(keys, F.lower(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def get_any(fields: Column, *keys: str) -> Column:
    """The value of the first of keys that the field map has, whatever the case."""
    low = lowered(fields)
    return F.coalesce(*(F.try_element_at(low, F.lit(k)) for k in keys))


def blob(fields: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def _entity(kind: Column, label: Column, attributes: Column, source: Column, document: Column | None = None) -> Column:
    return F.struct(kind.alias("kind"), label.alias("label"), attributes.alias("attributes"), source.alias("source"), (document if document is not None else F.lit(None).cast("string")).alias("document"))


def _gap(first: Column, more: Column) -> Column:
    keys = F.map_keys(first)
    return F.map_concat(first, F.map_filter(more, lambda k, _: ~F.array_contains(keys, k)))


def _some(**values: Column) -> Column:
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _computed(df: DataFrame, *columns: Column) -> DataFrame:
    """df.select(columns), computed once: a projection alone is copied into every lambda that uses it."""
    return df.select(F.explode(F.array(F.struct(*columns))).alias("__r")).select("__r.*")


def extract_entities(records: DataFrame, mappings: list[tuple[str, str]] = (), document_kinds: tuple[str, ...] = ("person", "organization", "account")) -> DataFrame:
    """One row for each entity of a record (batch_no, origin, index, fields): record, pos, kind, label, attributes,
    sources, document, dedup_key.

    A GeoJSON feature gives one located entity and nothing else. Otherwise: one entity for each rule of FIELD_MAP, from
    the first of its columns that is there; one for each of mappings (column, kind); one for each indicator in any value; and for
    accounts with an address its domain. An entity of the same kind and label appears once in a record. A document number in the
    record tells entities of document_kinds apart that share a label.
    """
    low = lowered(F.col("fields"))
    rows = _computed(records, F.struct("batch_no", "index").alias("record"), F.concat_ws("#", "origin", F.col("index").cast("string")).alias("origin"), F.col("fields"), low.alias("low"))
    got = lambda *keys: F.coalesce(*(F.try_element_at("low", F.lit(k)) for k in keys))
    empty = F.create_map().cast(MAP)
    # a located feature
    lon, lat = got("geometry.coordinates.0", "coordinates.0"), got("geometry.coordinates.1", "coordinates.1")
    named = parse_kind(F.coalesce(got("properties.type", "properties.category", "type"), F.lit("")))
    kind = F.when(named == "unknown", "facility").otherwise(named)
    place = F.format_string("%s:%.4f,%.4f", kind, F.coalesce(lat.try_cast("double"), F.lit(0.0)), F.coalesce(lon.try_cast("double"), F.lit(0.0)))
    about = _some(latitude=lat, longitude=lon, type=got("properties.type"), category=got("properties.category"), operator=got("properties.operator"), description=got("properties.description"))
    feature = F.array(_entity(kind, safe_label(kind, F.coalesce(got("properties.name", "properties.id", "name"), place)), about, F.col("origin")))
    # declared fields: the rules are data, so the expression stays small however many there are
    rules = F.array(*(F.struct(F.lit(k).alias("kind"), F.array(*map(F.lit, keys)).alias("keys"), F.lit("").alias("column")) for k, *keys in FIELD_MAP), *(F.struct(F.lit(k).alias("kind"), F.array(F.lit(c.lower())).alias("keys"), F.lit(c).alias("column")) for c, k in mappings))
    first = lambda keys: F.get(F.filter(F.transform(keys, lambda k: F.try_element_at("low", k)), lambda v: v.isNotNull()), 0)
    hits = F.filter(F.transform(rules, lambda r: F.struct(r["kind"].alias("kind"), first(r["keys"]).alias("v"), r["column"].alias("column"))), lambda h: h["v"].isNotNull())
    number = got(*DOCUMENT_KEYS)
    document = F.lower(F.regexp_replace(F.coalesce(number, F.lit("")), "[^A-Za-z0-9]", ""))
    kept = _gap(F.map_filter("low", lambda k, v: k.isin(*ATTRIBUTES)), _some(document_id=F.when(document != "", F.trim(number))))
    # coordinates and described properties fill gaps
    x, y = got("geometry.coordinates.0", "coordinates.0", "lon", "longitude"), got("geometry.coordinates.1", "coordinates.1", "lat", "latitude")
    both = x.isNotNull() & y.isNotNull() & ~F.map_contains_key("low", "latitude")
    lifted = {"longitude": F.when(both, x), "latitude": F.when(both, y)}
    kept = _gap(kept, _some(**lifted, **{k: got(f"properties.{k}") for k in ("name", "type", "category", "operator", "description")}))
    phash = F.nullif(F.lower(F.trim(got("perceptual_hash", "phash", "p_hash"))), F.lit(""))

    def declared(h: Column) -> Column:
        own = h["column"] == ""
        v = F.trim(h["v"])
        digest = F.when(own & is_hash(v), v)
        extra = _some(derived_from_column=F.when(~own, h["column"]), file_hash=F.lower(digest), hash_type=hash_type(digest), perceptual_hash=F.when(own & (h["kind"] == "media"), F.col("phash")))
        return _entity(h["kind"], safe_label(h["kind"], h["v"]), F.when(own, _gap(F.col("kept"), extra)).otherwise(extra), F.concat_ws(":", "origin", F.nullif(h["column"], F.lit(""))), F.when(own & h["kind"].isin(*document_kinds), F.col("document")))

    # free text
    found = F.flatten(F.transform(F.map_values("fields"), indicators))
    seen = F.transform(found, lambda x: _entity(x["kind"], safe_label(x["kind"], x["raw"]), _some(file_hash=F.when(is_hash(x["raw"]), F.lower(x["raw"])), hash_type=hash_type(x["raw"])), F.col("origin")))
    geo = lon.isNotNull() & lat.isNotNull()
    # two lists instead of one chosen by a condition, so that neither is computed for the other's rows
    plain = _computed(rows.where(~geo), F.col("record"), F.col("origin"), F.col("fields"), hits.alias("hits"), document.alias("document"), kept.alias("kept"), phash.alias("phash"))
    plain = plain.select("record", "origin", F.concat(F.transform("hits", declared).cast(_ENTITY), seen.cast(_ENTITY)).alias("e"))
    located = rows.where(geo).select("record", F.posexplode(feature.cast(_ENTITY)).alias("pos", "x")).select("record", "pos", "x.*")
    out = plain.select("record", "origin", F.posexplode("e").alias("pos", "x")).select("record", "origin", "pos", "x.*")
    domain = F.lower(F.trim(F.regexp_extract("label", "@(.*)$", 1)))
    both = F.array(F.struct("pos", "kind", "label", "attributes", "source", "document"), F.when((F.col("kind") == "account") & F.contains(domain, F.lit(".")), F.struct((F.col("pos") + 100_000).alias("pos"), F.lit("domain").alias("kind"), domain.alias("label"), empty.alias("attributes"), F.col("origin").alias("source"), F.lit(None).cast("string").alias("document"))))
    out = out.select("record", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("record", "x.*").unionByName(located)
    # the first of a kind and label in its record stays
    first = Window.partitionBy("record", "kind", "label").orderBy("pos")
    out = out.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    return out.select("record", "pos", "kind", "label", "attributes", F.array("source").alias("sources"), "document", dedup_key(F.col("kind"), F.col("label"), F.coalesce("document", F.lit(""))).alias("dedup_key"))


def as_rows(extracted: DataFrame) -> DataFrame:
    """Extracted entities as rows for upsert_entities."""
    return extracted.select("kind", "label", "dedup_key", "attributes", F.array().cast(STRINGS).alias("tags"), "sources", F.col("kind").isin(*SENSITIVE).alias("sensitive"), F.struct("record", "pos").alias("ord"))


def infer_links(extracted: DataFrame) -> DataFrame:
    """Links of a record by co-occurrence: each rule joins the record's first entities of two kinds, unless their labels
    are equal; and accounts with an address use its domain. Columns as resolve_links wants them, with both dedup keys."""
    firsts = extracted.groupBy("record", "kind").agg(F.min(F.struct("pos", "label", "dedup_key")).alias("f"))
    spark = extracted.sparkSession
    rules = F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(LINKS)], "rule int, source_kind string, rel_type string, target_kind string, confidence double"))
    a = firsts.select("record", F.col("kind").alias("source_kind"), F.col("f").alias("s")).join(rules, "source_kind")
    b = firsts.select("record", F.col("kind").alias("target_kind"), F.col("f").alias("t"))
    out = a.join(b, ["record", "target_kind"]).where("s.label != t.label")
    out = out.select("record", F.col("s.dedup_key").alias("source_key"), "rel_type", F.col("t.dedup_key").alias("target_key"), "confidence", F.struct("record", "rule").alias("ord"))
    domain = F.lower(F.trim(F.regexp_extract("label", "@(.*)$", 1)))
    mail = extracted.where("kind = 'account'").withColumn("d", domain).where(F.contains("d", F.lit(".")))
    mail = mail.select("record", F.col("dedup_key").alias("source_key"), F.lit("uses_email_domain").alias("rel_type"), dedup_key(F.lit("domain"), F.col("d")).alias("target_key"), F.lit(0.9).alias("confidence"), F.struct("record", (-F.col("pos") - 1).alias("rule")).alias("ord"))
    return out.unionByName(mail)


def profile_columns(cells: DataFrame, sample: int | None = 400) -> DataFrame:
    """One row for each column of cells (row, pos, name, value), over the first `sample` rows in the order of row, or all:
    semantic, confidence, uniqueness, non_empty, kind, is_primary. Ties between classes go to the one that is tested first."""
    first = cells if sample is None else cells.join(F.broadcast(cells.select("row").distinct().orderBy("row").limit(sample)), "row", "left_semi")
    typed = first.select("name", "pos", "value", classify_value(F.col("value")).alias("type")).where("type != 'empty'")
    order = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("type"))
    counts = typed.groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    best = counts.groupBy("name").agg(F.max(F.struct("n", (-order).alias("o"), "type")).alias("m"), F.sum("n").alias("non_empty"), F.min("pos").alias("pos"))
    distinct = typed.groupBy("name").agg(F.countDistinct(F.lower("value")).alias("d"))
    p = best.join(distinct, "name").select("name", "pos", F.col("m.type").alias("winner"), (F.col("m.n") / F.col("non_empty")).alias("confidence"), (F.col("d") / F.col("non_empty")).alias("uniqueness"), "non_empty")
    hint = header_semantic(F.col("name"))
    ambiguous = F.col("winner").isin("person_name", "free_text", "categorical", "id")
    named = rlike(F.lower("name"), NAME_HINT)
    free = F.col("winner") == "free_text"
    semantic = F.when(hint.isNotNull() & ambiguous, hint).when(hint.isNull() & free & (F.col("uniqueness") < 0.15) & (F.col("non_empty") > 10), "categorical").when(hint.isNull() & free & named, "person_name").otherwise(F.col("winner"))
    p = p.withColumn("semantic", semantic).withColumn("kind", class_kind(F.col("semantic")))
    rank = F.when(F.col("semantic") == "person_name", 0).when(named, 1).otherwise(2)
    score = F.when(rank == 2, -(F.col("uniqueness") + F.when(F.col("kind").isNotNull(), 0.3).otherwise(0.0))).otherwise(0.0)
    first = p.agg(F.min(F.struct(rank.alias("r"), score.alias("s"), "pos", "name")).alias("f")).select(F.col("f.name").alias("primary"))
    return p.join(F.broadcast(first)).select("name", "pos", "semantic", "confidence", "uniqueness", "non_empty", "kind", (F.col("name") == F.col("primary")).alias("is_primary"))


def cells_of(df: DataFrame, row: str) -> DataFrame:
    """A table's cells as text (row, pos, name, value); row numbers it."""
    cols = [c for c in df.columns if c != row]
    one = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)))
    return df.select(F.col(row).alias("row"), F.explode(one).alias("c")).select("row", "c.*").where("value IS NOT NULL AND value != ''")


def entity_mappings(profile: DataFrame) -> list[tuple[str, str]]:
    """(column, kind) for the columns that hold entities; a profile has as many rows as its table has columns."""
    return [(r["name"], r["kind"]) for r in profile.where("kind IS NOT NULL").orderBy("pos").select("name", "kind").collect()]

