"""From records to findings: all stages in order, each written once before the next ones read it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import geo_of
from . import assess, correlate, enrich, extract, govern, network, resolve, risk
from .components import cut, numbered
from .graph import STRINGS, add_edges, degrees, entity_id, merge_entities, undirected, upsert_entities

STAMPS = ("timestamp", "created_at", "received_at", "observed_at")


@dataclass
class Case:
    """What a run leaves; every table is written and may be read again."""

    entities: DataFrame
    edges: DataFrame
    metrics: DataFrame
    identities: DataFrame
    anomalies: DataFrame
    predictions: DataFrame
    risk: DataFrame
    case: DataFrame
    findings: DataFrame
    actions: DataFrame


def _edge(df: DataFrame, phase: int, order: Column | None = None) -> DataFrame:
    """Edges whose ord sorts by phase first; within one by order, else by their ends."""
    text = order if order is not None else F.concat_ws("|", "source_id", "rel_type", "target_id")
    reference = F.col("source_reference") if "source_reference" in df.columns else F.lit("extracted")
    return df.select("source_id", "rel_type", "target_id", "confidence", reference.alias("source_reference"), F.struct(F.lit(phase).alias("phase"), text.alias("at")).alias("ord"))


def build_graph(records: DataFrame, mappings: list[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of records; entities are numbered in the order first seen."""
    found = cut(extract.extract_entities(records, mappings))
    entities = upsert_entities(extract.as_rows(found))
    entities = cut(numbered(entities.withColumnRenamed("ord", "seen"), ["seen", "id"], "ord").drop("seen").select("id", "ord", "kind", "label", "dedup_key", "attributes", "tags", "sources", "sensitive"))
    links = extract.infer_links(found)
    at = F.concat_ws("|", F.lpad(F.col("ord.record.batch_no").cast("string"), 10, "0"), F.lpad(F.col("ord.record.index").cast("string"), 20, "0"), F.col("ord.rule").cast("string"))
    links = links.select(entity_id(F.col("source_key")).alias("source_id"), "rel_type", entity_id(F.col("target_key")).alias("target_id"), "confidence", at.alias("at"))
    return entities, cut(add_edges(_edge(links, 0, F.col("at"))))


def enrich_graph(entities: DataFrame, edges: DataFrame, refs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Derived attributes, domain hubs with their edges, reference matches, and money totals on wallets and accounts."""
    entities = cut(enrich.derived_attributes(entities))
    new, links = enrich.domain_hubs(entities)
    most = entities.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("n")).first()["n"]
    new = numbered(new.select("id", "kind", "label", "dedup_key", "sources", "tags"), ["id"], "k")
    new = new.select("id", (F.col("k") + most + 1).alias("ord"), "kind", "label", "dedup_key", F.create_map().cast("map<string,string>").alias("attributes"), F.col("tags").cast(STRINGS).alias("tags"), F.col("sources").cast(STRINGS).alias("sources"), F.lit(False).alias("sensitive"))
    entities = entities.unionByName(new)
    edges = cut(add_edges(edges.unionByName(_edge(links, 1))))
    if refs is not None:
        entities = enrich.mark_refs(cut(entities), enrich.match_refs(entities, refs))
    total = enrich.money_rollup(entities, edges).select(F.col("id").alias("t_id"), F.format_string("%.2f", "total_value").alias("total"))
    j = entities.join(total, F.col("id") == F.col("t_id"), "left")
    gap = F.col("total").isNotNull() & ~F.map_contains_key("attributes", "total_value")
    attributes = F.when(gap, F.map_concat("attributes", F.create_map(F.lit("total_value"), F.col("total")))).otherwise(F.col("attributes"))
    return cut(j.withColumn("attributes", attributes).drop("t_id", "total")), edges


def correlate_graph(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with those of shared infrastructure, places, labels, times, communications and selectors."""
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    place = geo_of(F.col("attributes"))
    points = entities.select("id", place.alias("p")).where("p IS NOT NULL").select("id", "p.lat", "p.lon")
    stamps = entities.select("id", F.coalesce(*(at(k) for k in STAMPS)).alias("ts")).where("ts IS NOT NULL")
    edges = cut(add_edges(edges.unionByName(_edge(correlate.shared_hubs(entities, edges), 2))))
    edges = cut(add_edges(edges.unionByName(_edge(correlate.co_located(points, edges), 3))))
    edges = cut(add_edges(edges.unionByName(_edge(correlate.similar_labels(entities), 4)).unionByName(_edge(correlate.co_active(stamps, edges), 5))))
    return cut(add_edges(edges.unionByName(_edge(correlate.co_communicated(entities, edges), 6)).unionByName(_edge(correlate.same_selector(entities), 7))))


def run_case(records: DataFrame, refs: DataFrame | None = None, mappings: list[tuple[str, str]] = (), domain: str = "generic", lang: str = "en") -> Case:
    """Extract, enrich, correlate, grade, resolve, measure, predict, find anomalies, score, assess: in this order.

    records as the readers give them; refs as load_refs does. Without records every table but the case's posture is empty.
    """
    entities, edges = build_graph(records, mappings)
    entities, edges = enrich_graph(entities, edges, refs)
    edges = correlate_graph(entities, edges)
    grades = govern.admiralty(entities).select(F.col("id").alias("g_id"), "grade", "reliability")
    j = entities.join(grades, F.col("id") == F.col("g_id"), "left")
    graded = F.map_concat(F.map_filter("attributes", lambda k, _: ~k.isin("admiralty", "admiralty_label")), F.create_map(F.lit("admiralty"), F.col("grade"), F.lit("admiralty_label"), F.col("reliability")))
    entities = cut(j.withColumn("attributes", F.when(F.col("g_id").isNull(), F.col("attributes")).otherwise(graded)).drop("g_id", "grade", "reliability"))
    identities = cut(resolve.resolve_identities(entities, edges))
    merged = identities.where("decision = 'merged'")
    if not merged.isEmpty():
        entities, edges = merge_entities(entities, edges, merged)
        entities, edges = cut(entities), cut(edges)
    metrics = cut(network.analyze(entities.select("id", "ord"), undirected(edges)))
    entities = cut(network.write_metrics(entities, metrics))
    predictions = cut(network.predict_links(edges))
    predicted = network.predicted_edges(predictions)
    edges = cut(add_edges(edges.unionByName(_edge(predicted, 8))))
    hour = F.try_element_at("attributes", F.lit("activity_hour")).try_cast("int")
    features = cut(entities.select("id", "kind", F.size("sources").alias("sources"), hour.alias("activity_hour")).join(degrees(entities, edges), "id").join(metrics.select("id", "betweenness", "pagerank"), "id"))
    anomalies = cut(risk.detect_anomalies(features))
    facts = features.select("id", "degree", "betweenness").join(anomalies.select("id", F.col("score").alias("anomaly_score")), "id", "left").withColumn("adjustment", F.lit(0.0))
    scored = cut(risk.score_risk(entities, cut(facts), edges, domain))
    case = cut(risk.case_risk(scored))
    told = entities.join(metrics.select("id", "betweenness", "community"), "id").join(anomalies.select("id", F.col("score").alias("anomaly_score")), "id", "left")
    findings = cut(assess.assess(told, edges, scored, case, lang))
    actions = cut(assess.next_actions(entities, edges, scored))
    return Case(entities, edges, metrics, identities, anomalies, predictions, scored, case, findings, actions)
