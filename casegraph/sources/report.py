"""A case written to a folder: the graph, the findings by bucket and a brief; and the graph read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assess import bucket
from ..operators.run import Case

SECTIONS = ("identities", "anomalies", "predictions", "risk", "case", "findings", "actions")
#: Headings of the brief by language.
HEADINGS = {
    "en": {"title": "Case brief", "findings": "Findings", "actions": "Next actions", "top": "Entities by risk", "merges": "Identities", "note": "Everything flagged here is for people to review."},
    "pt": {"title": "Resumo do caso", "findings": "Constatações", "actions": "Próximas ações", "top": "Entidades por risco", "merges": "Identidades", "note": "Tudo o que está marcado aqui deve ser revisto por pessoas."},
    "es": {"title": "Resumen del caso", "findings": "Hallazgos", "actions": "Próximas acciones", "top": "Entidades por riesgo", "merges": "Identidades", "note": "Todo lo señalado aquí lo deben revisar personas."},
}


def consolidated(case: Case) -> dict[str, DataFrame]:
    """The case's sections; entities carry the bucket of the consolidated document that they belong to."""
    return {"entities": case.entities.withColumn("bucket", bucket(F.col("kind"))), "relationships": case.edges} | {s: getattr(case, s) for s in SECTIONS}


def brief(case: Case, lang: str = "en", top: int = 15, merges: int = 20) -> list[str]:
    """Lines of a brief in Markdown. What the driver gathers is bounded: findings and actions by their rules, entities by
    top, merges by their limit."""
    say = HEADINGS[lang]
    posture = case.case.first()
    counts = case.entities.count(), case.edges.count()
    out = [f"# {say['title']}", "", f"- {counts[0]} / {counts[1]}", f"- {posture['case_risk_band']} ({posture['case_risk_score']:.2f})", "", f"## {say['findings']}", ""]
    out += [f"- {r['statement']} ({r['confidence']:.0%}, {r['basis']})" for r in case.findings.collect()]
    out += ["", f"## {say['actions']}", ""] + [f"- {r['action']}: {r['count']} ({r['priority']:.0%}, {r['est_hours']:.0f} h)" for r in case.actions.collect()]
    out += ["", f"## {say['top']}", "", "| risk | band | kind | entity | action | review |", "|-|-|-|-|-|-|"]
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    for r in case.risk.orderBy(F.desc("risk_score"), "ord").limit(top).collect():
        out.append("| " + " | ".join([f"{r['risk_score']:.2f}", r["risk_band"], r["kind"], cell(r["label"]), r["recommended_action"], "yes" if r["requires_human_review"] else "no"]) + " |")
    found = case.identities.orderBy(F.desc("confidence"), "canonical_id", "alias_id").limit(merges).collect()
    if found:
        out += ["", f"## {say['merges']}", ""] + [f"- {r['decision']}: {r['canonical_id']} < {r['alias_id']} ({r['confidence']:.0%}): {'; '.join(r['signals'])}" for r in found]
    return [*out, "", f"> {say['note']}", ""]


def write_case(case: Case, path: str, lang: str = "en") -> list[str]:
    """Write the graph and the sections as JSON lines, entities by bucket, and the brief as text; returns the folders."""
    spark = case.entities.sparkSession
    written = []
    for name, df in consolidated(case).items():
        to = f"{path.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy("bucket") if name == "entities" else writer).json(to)
        written.append(to)
    lines = spark.createDataFrame([("\n".join(brief(case, lang)),)], "value string")
    lines.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/brief")
    return [*written, f"{path.rstrip('/')}/brief"]


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) that write_case wrote; a folder that isn't there raises."""
    entities = "id string, ord long, kind string, label string, dedup_key string, attributes map<string,string>, tags array<string>, sources array<string>, sensitive boolean"
    edges = "source_id string, rel_type string, target_id string, confidence double, source_reference string, ord struct<phase:int,at:string>"
    root = path.rstrip("/")
    return spark.read.schema(entities).json(f"{root}/entities"), spark.read.schema(edges).json(f"{root}/relationships")
