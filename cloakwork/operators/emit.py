"""Artefacts: the safe document in Markdown, its legend and warnings, routed by decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import ABBREVIATIONS, LABELS, NAMES, RELIABLE, lookup
from .manifest import AGENT_INSTRUCTION, LIMITS
from .policy import Policy

FOLDERS = {"allow": "output", "review": "review", "block": "quarantine"}
DID = {"pseudonymize": "replaced by a token", "generalize": "made less precise", "keep": "left as it is", "block": "blocks the document", "review": "needs review"}


def legend(spans: DataFrame, policy: Policy) -> DataFrame:
    """(doc_id, legend): a table of types with counts and treatment, most frequent first. Never a value."""
    counts = spans.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"))
    actions = {n: policy.rule(n)["action"] for n in NAMES}
    action = F.coalesce(lookup(actions, F.col("entity_type")), F.lit(policy.default_action))
    sign = F.when(action == "pseudonymize", F.concat(F.lit("`⟦"), lookup(ABBREVIATIONS, F.col("entity_type")), F.lit("_····⟧`"))).when(action == "generalize", "*reduced*").when(action == "keep", "*still in the text*").otherwise("—")
    line = F.concat(F.lit("| "), F.coalesce(lookup(LABELS, F.col("entity_type")), F.col("entity_type")), F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), lookup(DID, action), F.lit(" | "), sign, F.lit(" |"))
    rows = counts.select("doc_id", F.struct((-F.col("n")).alias("a"), F.col("entity_type").alias("b"), line.alias("line")).alias("r"))
    joined = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]), "\n").alias("rows"))
    return joined.select("doc_id", F.concat(F.lit("| Category | Count | Treatment | Placeholder |\n|---|---|---|---|\n"), F.col("rows")).alias("legend"))


def warnings_of(ner_enabled: Column, ner_error: Column, quality: Column, pages_below: Column, ambiguous: Column, decision: Column) -> Column:
    """An array of warnings for one document."""
    return F.array_compact(F.array(
        F.when(~ner_enabled, F.lit("Names were not looked for and are probably still in the text.")),
        F.when(ner_enabled & ner_error.isNotNull(), F.concat(F.lit("Looking for names failed: "), ner_error)),
        F.when(quality < RELIABLE, F.concat(F.lit("Low text quality: "), F.format_number(quality, 2))),
        F.when(F.size(pages_below) > 0, F.concat(F.lit("Pages of low quality: "), F.array_join(F.transform(F.slice(pages_below, 1, 10), lambda p: p.cast("string")), ", "))),
        F.when(ambiguous > 0, F.concat(ambiguous.cast("string"), F.lit(" repaired values are uncertain."))),
        F.when(decision == "review", F.lit("To be reviewed before use.")),
    ))


def render(results: DataFrame, policy: Policy, version: str) -> DataFrame:
    """(doc_id, decision, markdown) of rows with source_name, source_sha256, decision, reasons, quality, tokens_issued, legend, warnings, safe_text.

    A blocked document shows its reasons and nothing of its content.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    bullets = lambda c: F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), "\n")
    head = F.concat(
        F.lit(f'---\ncloakwork:\n  version: "{version}"\n  mode: {policy.mode}\n  policy_profile: {policy.profile}\n  policy_sha256: {policy.sha256[:16]}\n  egress: none\n  content_origin: machine-generated\n  doc_id: '),
        text("doc_id"), F.lit("\n  source: "), F.to_json(F.array("source_name")), F.lit("\n  source_sha256: "), text("source_sha256"), F.lit("\n  decision: "), text("decision"),
        F.lit("\n  tokens_issued: "), text("tokens_issued"), F.lit("\n  quality: "), F.round("quality", 3).cast("string"), F.lit("\n---\n"),
    )
    title = F.concat(F.lit("\n# "), F.regexp_replace("source_name", r"\.[^.]*\z", ""), F.lit("\n"))
    found = F.concat(F.lit("\n## Personal data\n\n"), F.coalesce("legend", F.lit("None was found, which does not mean that there is none.")), F.lit("\n"))
    warned = F.when(F.size("warnings") > 0, F.concat(F.lit("\n## Warnings\n\n"), bullets("warnings"), F.lit("\n"))).otherwise(F.lit(""))
    foot = F.lit("\n---\n\n## Limits\n\n" + "\n".join(f"- {x}" for x in LIMITS) + "\n")
    safe = F.concat(head, title, F.lit(f"\n> {AGENT_INSTRUCTION}\n"), found, warned, F.lit("\n---\n\n## Content\n\n"), F.trim("safe_text"), F.lit("\n"), foot)
    blocked = F.concat(head, title, F.lit("\n## Blocked\n\n"), bullets("reasons"), F.lit("\n"), foot)
    return results.select("doc_id", "decision", F.when(F.col("decision") == "block", blocked).otherwise(safe).alias("markdown"))


def write_routed(rendered: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows go to a folder for each decision: route=output, review or quarantine."""
    rendered.withColumn("route", lookup(FOLDERS, F.col("decision"))).write.mode(mode).partitionBy("route").parquet(path)
