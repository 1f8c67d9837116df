"""Snapshots and watchlists, redaction, the audit chain, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chain_hash, looks_like_name, mask_value, short_token

# Attributes that redaction keeps.
KEEP = ("latitude", "longitude", "lat", "lon", "risk_score", "risk_band", "betweenness", "pagerank", "community", "activity_hour", "ip_scope", "registrable_domain", "hash_type", "ref_match", "ref_severity", "total_value", "admiralty_grade")
PERSONAL = ("person", "victim", "suspect")
GENESIS = "genesis"


# -- snapshots ---------------------------------------------------------------------------------------------


def by_label(entities: DataFrame) -> DataFrame:
    """(label, risk_score) of a snapshot: labels alone are compared, a repeated one has its last risk."""
    return entities.groupBy("label").agg(F.max_by(F.coalesce("risk_score", F.lit(0.0)), "ord").alias("risk_score"))


def diff(previous: DataFrame, current: DataFrame, rise: float = 0.15) -> DataFrame:
    """(label, change, before, after): new, removed, or risk raised by at least `rise`, of two snapshots (label, risk_score, ord)."""
    a, b = by_label(previous).select("label", F.col("risk_score").alias("before")), by_label(current).select("label", F.col("risk_score").alias("after"))
    j = a.join(b, "label", "full_outer")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "removed").when(F.col("after") - F.col("before") >= rise - 1e-9, "risk_raised")
    return j.withColumn("change", change).where("change IS NOT NULL").select("label", "change", "before", "after")


def summary(changes: DataFrame, edges_before: int, edges_after: int) -> DataFrame:
    """One row of counts and a sentence."""
    c = changes.agg(*(F.count_if(F.col("change") == k).alias(k) for k in ("new", "removed", "risk_raised"))).withColumn("edge_delta", F.lit(edges_after - edges_before).cast("long"))
    parts = F.filter(F.array(*(F.when(F.col(k) != 0, F.concat(F.col(k).cast("string"), F.lit(f" {t}"))) for k, t in (("new", "new"), ("removed", "removed"), ("risk_raised", "at higher risk"), ("edge_delta", "edges more")))), lambda x: x.isNotNull())
    return c.withColumn("text", F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("no change"))


def watchlist(entities: DataFrame, rules: DataFrame, top: int = 10) -> DataFrame:
    """(name, hits, entity_id, label, risk_score, rank): each rule's hits and its riskiest `top` entities.

    rules: name, kind, min_risk, label_contains; nulls don't restrict. Rules are written by hand and few, so they're broadcast.
    Partial top lists are cut within salts before a rule's hits meet.
    """
    r = F.broadcast(rules.select("name", F.col("kind").alias("r_kind"), F.coalesce("min_risk", F.lit(0.0)).alias("r_min"), F.lower("label_contains").alias("r_text")))
    hit = (F.col("r_kind").isNull() | (F.lower("r_kind") == F.col("kind"))) & (F.coalesce("risk_score", F.lit(0.0)) >= F.col("r_min")) & (F.col("r_text").isNull() | F.contains(F.lower("label"), F.col("r_text")))
    rows = entities.join(r, hit).select("name", F.col("id").alias("entity_id"), "label", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"), "ord", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    counts = rows.groupBy("name").agg(F.count(F.lit(1)).alias("hits"))
    order = [F.desc("risk_score"), "ord", "entity_id"]
    part = rows.withColumn("rank", F.row_number().over(Window.partitionBy("name", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(counts, "name").select("name", "hits", "entity_id", "label", "risk_score", "rank")


# -- redaction ---------------------------------------------------------------------------------------------


def redact(entities: DataFrame) -> DataFrame:
    """entities with personal labels and attribute values masked, structural attributes kept."""
    label = F.when(F.col("kind").isin(*PERSONAL) & looks_like_name(F.col("label")), F.concat(F.lit("PERSON-"), short_token(F.col("label")))).otherwise(mask_value(F.col("label")))
    attributes = F.transform_values("attributes", lambda k, v: F.when(k.isin(*KEEP), v).otherwise(mask_value(v)))
    return entities.withColumns({"label": label, "attributes": attributes})


# -- audit -------------------------------------------------------------------------------------------------


def audit_content() -> Column:
    """What of an event the chain covers."""
    return F.concat_ws("|", "audit_event_id", "timestamp", "user_id", "action_performed", "stage", "entity_scope", F.col("sensitive_data_viewed").cast("string"))


def build_chain(events: list[dict]) -> list[dict]:
    """Events with prev_hash and hash, each chained onto the one before: an append of a run's few events, in order."""
    out, before = [], GENESIS
    for e in events:
        content = "|".join([e["audit_event_id"], e["timestamp"], e["user_id"], e["action_performed"], e["stage"], e["entity_scope"], "true" if e["sensitive_data_viewed"] else "false"])
        h = 1469598103934665603
        for b in (before + content).encode():
            h = ((h ^ b) * 1099511628211) & (1 << 64) - 1
        out.append(e | {"prev_hash": before, "hash": f"{h:016x}"})
        before = out[-1]["hash"]
    return out


def append_chain(path: str, events: list[dict]) -> None:
    """Append chained events to a JSON lines file, going on from its last event."""
    import json
    import os

    old = [json.loads(x) for x in open(path, encoding="utf-8") if x.strip()] if os.path.exists(path) else []
    made = build_chain([*old, *events])[len(old) :]
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(json.dumps(e) + "\n" for e in made)


def verify_chain(events: DataFrame) -> DataFrame:
    """One row, events, broken_at (null if none), reason: the first event, by seq from 1, that doesn't link to the one
    before or whose hash isn't that of its content.

    Each event is checked against its own prev_hash and its predecessor's hash, a self-join on seq rather than a walk.
    """
    e = events.select("seq", "prev_hash", "hash", chain_hash(F.col("prev_hash"), audit_content()).alias("expect"))
    before = events.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("last"))
    j = e.join(before, "seq", "left").withColumn("last", F.when(F.col("seq") == 1, GENESIS).otherwise(F.col("last")))
    reason = F.when(~F.col("prev_hash").eqNullSafe(F.col("last")), "not linked").when(~F.col("hash").eqNullSafe(F.col("expect")), "altered")
    j = j.withColumn("reason", reason)
    bad = F.min(F.when(F.col("reason").isNotNull(), F.struct("seq", "reason")))
    return j.agg(F.count(F.lit(1)).alias("events"), bad.alias("b")).select("events", F.col("b.seq").alias("broken_at"), F.col("b.reason").alias("reason"))


def sensitive_touches(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if("sensitive_data_viewed").alias("sensitive_touches"))


def disposal_date(created: Column, days: int) -> Column:
    return F.date_add(F.to_date(created), days)


# -- reliability grades ------------------------------------------------------------------------------------

# Grades by wording, in the order tested; the wording of grades.
SOURCE_GRADES = (("A", ("completely reliable", "totalmente confiá")), ("B", ("usually reliable", "confiá")), ("C", ("fairly reliable",)), ("D", ("not usually reliable", "pouco confiá")), ("E", ("unreliable", "não confiá")), ("F", ("cannot be judged", "desconhec")))
INFO_GRADES = (("1", ("confirmed", "confirmad")), ("2", ("probably true", "provavelmente")), ("3", ("possibly true", "possivelmente")), ("4", ("doubtful", "duvidos")), ("5", ("improbable", "imprová")), ("6", ("cannot be judged", "não avaliad")))
LABELS = {"A": "completely reliable", "B": "usually reliable", "C": "fairly reliable", "D": "not usually reliable", "E": "unreliable", "F": "reliability unknown", "1": "confirmed", "2": "probably true", "3": "possibly true", "4": "doubtful", "5": "improbable", "6": "cannot be judged"}


def grade(c: Column, grades: tuple) -> Column:
    low, out = F.lower(c), None
    for g, words in grades:
        hit = low == g.lower()
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, g) if out is None else out.when(hit, g)
    return out


def admiralty(entities: DataFrame) -> DataFrame:
    """(id, grade, reliability) of reports and communications: source A to F by the first attribute named like reliability,
    information 1 to 6 by one named like credibility, else by the number of sources."""
    first = lambda pattern: F.get(F.transform(F.filter(F.map_entries("attributes"), lambda e: F.regexp_like(F.lower(e["key"]), F.lit(pattern))), lambda e: e["value"]), 0)
    n = F.size("sources")
    source = F.coalesce(grade(first("reliab|confiab|source_grade"), SOURCE_GRADES), F.lit("F"))
    info = F.coalesce(grade(first("credib|confirm|info_grade"), INFO_GRADES), F.when(n <= 1, "3").when(n == 2, "2").otherwise("1"))
    words = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    out = entities.where("kind IN ('report', 'communication')").select("id", source.alias("s"), info.alias("i"))
    return out.select("id", F.concat("s", "i").alias("grade"), F.concat(F.element_at(words, F.col("s")), F.lit("; "), F.element_at(words, F.col("i"))).alias("reliability"))
