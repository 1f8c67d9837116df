"""Findings, next actions, report buckets and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import degrees

HUB_KINDS = ("ip", "device", "wallet", "domain", "group")
BUCKETS = {"person": "persons", "victim": "victims", "suspect": "suspects", "account": "accounts", "device": "devices", "ip": "ips", "url": "urls", "domain": "urls", "group": "groups", "payment": "payments", "wallet": "payments", "media": "media_artifacts", "evidence": "media_artifacts"}
#: Wording by language: rule -> template; {} are filled in order.
WORDS = {
    "en": {"posture": "Overall case risk is %s (%.2f).", "hub": "%d entities meet at the %s \"%s\".", "risk": "%d entities carry most of the risk: %s.", "collision": "%d entities share kind and label with another.", "exact": "%d files are exactly known to %s.", "perceptual": "%d files are close to material known to %s.", "broker": "\"%s\" links parts of the network (betweenness %.2f).", "communities": "The network falls into %d communities.", "anomaly": "%d entities stand out, most of all \"%s\".", "predicted": "%d links are likely but absent, first \"%s\" and \"%s\"."},
    "pt": {"posture": "O risco geral do caso é %s (%.2f).", "hub": "%d entidades se encontram no %s \"%s\".", "risk": "A maior parte do risco vem de %d: %s.", "collision": "%d entidades repetem tipo e rótulo de outra.", "exact": "%d arquivos constam exatamente em %s.", "perceptual": "%d arquivos são próximos de material de %s.", "broker": "\"%s\" liga partes da rede (intermediação %.2f).", "communities": "A rede se divide em %d comunidades.", "anomaly": "%d entidades destoam, sobretudo \"%s\".", "predicted": "%d vínculos são prováveis mas ausentes, primeiro \"%s\" e \"%s\"."},
    "es": {"posture": "El riesgo general del caso es %s (%.2f).", "hub": "%d entidades coinciden en el %s \"%s\".", "risk": "%d entidades reúnen casi todo el riesgo: %s.", "collision": "%d entidades repiten tipo y etiqueta de otra.", "exact": "%d archivos constan exactamente en %s.", "perceptual": "%d archivos se acercan a material de %s.", "broker": "\"%s\" une partes de la red (intermediación %.2f).", "communities": "La red se divide en %d comunidades.", "anomaly": "%d entidades se desvían, sobre todo \"%s\".", "predicted": "%d enlaces son probables pero ausentes, primero \"%s\" y \"%s\"."},
}


def collisions(entities: DataFrame) -> DataFrame:
    """One row, n: the entities whose kind and label another one has too."""
    return entities.groupBy("kind", F.lower("label")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


def _row(df: DataFrame, rule: str, confidence: Column, statement: Column, basis: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.round(confidence, 6).alias("confidence"), statement.alias("statement"), F.lit(basis).alias("basis"))


def assess(entities: DataFrame, edges: DataFrame, risk: DataFrame, case: DataFrame, lang: str = "en") -> DataFrame:
    """(rule, confidence, statement, basis): up to one finding a rule, by falling confidence.

    entities: as elsewhere, with columns betweenness, community, anomaly_score (null where absent). Each rule is one
    aggregate; what meets on the driver's side of a rule is its finding.
    """
    say = WORDS[lang]
    n = lambda c: F.col(c).cast("long")
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    band = F.col("case_risk_band")
    out = [_row(case, "posture", F.when(band == "critical", 0.8).when(band == "high", 0.7).when(band == "medium", 0.5).otherwise(0.4), F.format_string(say["posture"], band, "case_risk_score"), "observed")]
    deg = degrees(entities, edges)
    hubs = entities.where(F.col("kind").isin(*HUB_KINDS)).join(deg, "id").where("degree >= 3").orderBy(F.desc("degree"), "ord").limit(1)
    out.append(_row(hubs, "hub", F.least(0.35 + F.col("degree") * 0.05, F.lit(0.9)), F.format_string(say["hub"], n("degree"), "kind", "label"), "inferred"))
    top = risk.where("risk_score >= 0.6").orderBy(F.desc("risk_score"), "ord").limit(3).agg(F.count(F.lit(1)).alias("n"), F.max("risk_score").alias("top"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("risk_score")).alias("s"), "ord", "label"))), lambda x: x["label"]), ", ").alias("names")).where("n > 0")
    out.append(_row(top, "risk", F.least(F.col("top") * 0.9, F.lit(0.85)), F.format_string(say["risk"], n("n"), "names"), "observed"))
    out.append(_row(collisions(entities).where("n > 1"), "collision", F.lit(0.6), F.format_string(say["collision"], n("n")), "observed"))
    hits = entities.where(at("ref_source").isNotNull()).select((F.coalesce(at("ref_match"), F.lit("")) == "perceptual").alias("p"), at("ref_source").alias("s"), at("ref_similarity").try_cast("double").alias("sim"))
    sums = hits.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("s")), ", ").alias("names"), F.least(F.coalesce(F.min("sim"), F.lit(1.0)), F.lit(1.0)).alias("sim"))
    out.append(_row(sums.where("NOT p"), "exact", F.lit(0.95), F.format_string(say["exact"], n("n"), "names"), "observed"))
    out.append(_row(sums.where("p"), "perceptual", F.least(F.greatest(F.col("sim") * 0.9, F.lit(0.5)), F.lit(0.9)), F.format_string(say["perceptual"], n("n"), "names"), "observed"))
    broker = entities.where("betweenness IS NOT NULL").orderBy(F.desc("betweenness"), "ord").limit(1).where("betweenness >= 0.15")
    out.append(_row(broker, "broker", F.least(0.4 + F.col("betweenness") * 0.5, F.lit(0.85)), F.format_string(say["broker"], "label", "betweenness"), "inferred"))
    out.append(_row(entities.agg(F.countDistinct("community").alias("n")).where("n >= 2"), "communities", F.lit(0.55), F.format_string(say["communities"], n("n")), "inferred"))
    odd = entities.where("anomaly_score IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("anomaly_score")).alias("s"), "ord", "label")).alias("m")).where("n > 0")
    out.append(_row(odd, "anomaly", F.least(0.45 - F.col("m.s") * 0.4, F.lit(0.85)), F.format_string(say["anomaly"], n("n"), "m.label"), "inferred"))
    pred = edges.where("rel_type = 'predicted_link'").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("confidence")).alias("c"), "source_id", "target_id")).alias("m")).where("n > 0")
    named = lambda c: entities.select(F.col("id").alias(f"{c}_id"), F.col("label").alias(f"{c}_label"))
    pred = pred.join(named("a"), F.col("m.source_id") == F.col("a_id"), "left").join(named("b"), F.col("m.target_id") == F.col("b_id"), "left")
    out.append(_row(pred, "predicted", F.least(F.greatest(-F.col("m.c") * 0.8, F.lit(0.3)), F.lit(0.7)), F.format_string(say["predicted"], n("n"), F.coalesce("a_label", F.lit("?")), F.coalesce("b_label", F.lit("?"))), "inferred"))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.orderBy(F.desc("confidence"), "rule")


def next_actions(entities: DataFrame, edges: DataFrame, risk: DataFrame, most: int = 6) -> DataFrame:
    """(action, count, reduction, effort, priority, est_hours, target): what would reduce uncertainty most for its effort."""
    deg = degrees(entities, edges)
    facts = entities.join(deg, "id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("sources") == 0).alias("sourceless"), F.count_if(F.col("degree") == 0).alias("isolated"), F.count_if(F.array_contains("tags", "hypothesis")).alias("hypotheses"),
        F.max(F.when(F.col("kind").isin("ip", "device", "wallet", "domain"), F.col("degree"))).alias("hub"),
    ).crossJoin(risk.agg(F.count_if(F.col("risk_score") >= 0.6).alias("risky")))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0))
    rules = [
        ("trace_sources", F.col("sourceless"), F.least(0.35 + share("sourceless") * 0.4, F.lit(0.8)), 0.4, "entities"),
        ("verify_hub", F.when(F.col("hub") >= 3, F.col("hub")).otherwise(0), F.lit(0.6), 0.3, "graph"),
        ("enrich_isolated", F.col("isolated"), F.least(0.25 + share("isolated") * 0.35, F.lit(0.7)), 0.55, "sources"),
        ("confirm_hypotheses", F.col("hypotheses"), F.lit(0.5), 0.35, "entities"),
        ("verify_top_risk", F.least(F.col("risky"), F.lit(1)), F.lit(0.55), 0.3, "graph"),
    ]
    rows = F.array(*(F.struct(F.lit(a).alias("action"), c.cast("long").alias("count"), r.alias("reduction"), F.lit(e).alias("effort"), F.lit(t).alias("target"), F.lit(i).alias("i")) for i, (a, c, r, e, t) in enumerate(rules)))
    out = facts.select(F.explode(rows).alias("r")).select("r.*").where("count > 0")
    out = out.withColumn("priority", F.least(F.col("reduction") / F.col("effort"), F.lit(3.0)) / 3).withColumn("est_hours", F.round(0.5 + F.col("effort") * 7.5))
    return out.orderBy(F.desc("priority"), "i").limit(most).select("action", "count", "reduction", "effort", "priority", "est_hours", "target")


def bucket(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in BUCKETS.items() for x in kv)), kind), F.lit("other"))


def situation(entities: DataFrame, edges: DataFrame, risk: DataFrame) -> DataFrame:
    """One row: entities, relationships, critical, review, severity."""
    a = entities.agg(F.count(F.lit(1)).alias("entities"))
    b = edges.agg(F.count(F.lit(1)).alias("relationships"))
    c = risk.agg(F.count_if(F.col("risk_band") == "critical").alias("critical"), F.count_if(F.col("requires_human_review")).alias("review"))
    severity = F.when(F.col("critical") > 0, "critical").when(F.col("review") > 0, "elevated").otherwise("normal")
    return a.crossJoin(b).crossJoin(c).withColumn("severity", severity)
