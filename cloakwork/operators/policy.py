"""Policies: what to do with each entity type, and the decision for each document."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import ACTIONS, DECISIONS, NAMES, SPECIAL_PREFIX, is_special, lookup

KEEPS = ("ORGANIZATION", "LOCATION", "DATE")
GENERALIZES = {"ADDRESS": "municipality", "DATE_OF_BIRTH": "year"}


def _default_rules() -> dict[str, dict]:
    rules = {name: {"action": "pseudonymize"} for name in NAMES}
    rules |= {name: {"action": "keep"} for name in KEEPS}
    rules |= {name: {"action": "generalize", "to": to} for name, to in GENERALIZES.items()}
    rules |= {name: {"action": "block", "reason": f"{name}: special category"} for name in NAMES if name.startswith(SPECIAL_PREFIX)}
    return rules


@dataclass(frozen=True)
class Policy:
    """Rules by entity type (action, to, reason) and thresholds for whole documents."""

    rules: dict[str, dict] = field(default_factory=_default_rules)
    profile: str = "gdpr-strict"
    mode: str = "pseudonymize"  # or anonymize: nothing can be restored
    default_action: str = "pseudonymize"
    review_below_confidence: float = 0.75
    block_on_detection_error: bool = True
    ttl_days: int = 90

    def __post_init__(self):
        if unknown := sorted(set(self.rules) - set(NAMES)):
            raise ValueError(f"unknown entity types in the policy: {unknown}")
        actions = [r.get("action") for r in self.rules.values()] + [self.default_action]
        if bad := [a for a in actions if a not in ACTIONS]:
            raise ValueError(f"unknown actions in the policy: {bad}")

    @classmethod
    def from_dict(cls, data: dict) -> Policy:
        """From the parsed YAML form (entities, thresholds, pseudonymization)."""
        rules = {}
        for entry in data.get("entities") or []:
            rules[str(entry["type"])] = {k: entry[k] for k in ("action", "to", "reason") if entry.get(k) is not None}
            rules[str(entry["type"])].setdefault("action", "pseudonymize")
        limits, vault = data.get("thresholds") or {}, (data.get("pseudonymization") or {}).get("vault") or {}
        return cls(
            rules, data.get("profile", "custom"), data.get("mode", "pseudonymize"), data.get("default_action", "pseudonymize"),
            float(limits.get("review_below_confidence", 0.75)), bool(limits.get("block_on_detection_error", True)), int(vault.get("ttl_days", 90)),
        )

    @property
    def sha256(self) -> str:
        """Hash of the policy's canonical form; it changes with any of its contents."""
        data = [self.rules, self.profile, self.mode, self.default_action, self.review_below_confidence, self.block_on_detection_error, self.ttl_days]
        return hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    def rule(self, name: str) -> dict:
        if name in self.rules:
            return self.rules[name]
        return {"action": "block" if name.startswith(SPECIAL_PREFIX) else self.default_action}

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules as a table of 23 rows (entity_type, action, generalize_to, reason)."""
        rows = [(n, (r := self.rule(n))["action"], r.get("to"), r.get("reason")) for n in NAMES]
        return spark.createDataFrame(rows, "entity_type string, action string, generalize_to string, reason string")


def with_rules(spans: DataFrame, policy: Policy) -> DataFrame:
    """``spans`` with action, generalize_to and reason, by a join with the policy's table (23 rows, so broadcast)."""
    rules = policy.table(spans.sparkSession)
    joined = spans.join(F.broadcast(rules), "entity_type", "left")
    fallback = F.when(is_special(F.col("entity_type")), F.lit("block")).otherwise(F.lit(policy.default_action))
    return joined.withColumn("action", F.coalesce("action", fallback))


def text_action(action: Column) -> Column:
    """What happens to the text: blocked and reviewed entities are pseudonymised as well."""
    return F.when(action.isin("block", "review"), F.lit("pseudonymize")).otherwise(action)


def generalizations(policy: Policy) -> dict[str, str]:
    return {n: policy.rule(n)["to"] for n in NAMES if policy.rule(n)["action"] == "generalize" and policy.rule(n).get("to")}


def action_columns(entity_type: Column, policy: Policy) -> tuple[Column, Column]:
    """(action on the text, target of generalisation; without one: year) as constant maps, without a join."""
    fallback = F.when(is_special(entity_type), F.lit("block")).otherwise(F.lit(policy.default_action))
    action = F.coalesce(lookup({n: policy.rule(n)["action"] for n in NAMES}, entity_type), fallback)
    targets = generalizations(policy)
    return text_action(action), (F.coalesce(lookup(targets, entity_type), F.lit("year")) if targets else F.lit("year"))


def decide(documents: DataFrame, spans: DataFrame, policy: Policy, quality: Column | None = None, detection_error: Column | None = None) -> DataFrame:
    """(doc_id, decision, reasons, blocked_entities, review_entities) of every document.

    The severest of: a blocked entity, an entity for review, one found with
    little confidence, text of low quality (``quality``, a column of
    ``documents``), and ``detection_error``, which blocks (or asks for review,
    by the policy) whatever else there is.
    """
    ruled = with_rules(spans, policy)
    limit = F.lit(policy.review_below_confidence)
    blocks, asks = F.col("action") == "block", F.col("action") == "review"
    unsure = ~blocks & ~asks & (F.col("confidence") < limit)
    severity = F.when(blocks, 2).when(asks | unsure, 1).otherwise(0)
    reason = F.when(blocks, F.coalesce("reason", F.concat(F.col("entity_type"), F.lit(": blocked"))))
    low = F.when(unsure, F.struct(F.col("start"), F.concat(F.lit("low confidence on "), F.col("entity_type")).alias("why")))
    # The first span that turns a document from allowed to reviewed or blocked tells whether low confidence is the reason.
    first = F.min_by(F.struct(unsure.alias("unsure"), low["why"].alias("why")), F.when(severity > 0, F.struct("start", "end", "ord")))
    own = ruled.groupBy("doc_id").agg(
        F.max(severity).alias("s"), F.sort_array(F.collect_set(reason)).alias("why"), first.alias("first"),
        F.sort_array(F.collect_set(F.when(blocks, F.col("entity_type")))).alias("b"), F.sort_array(F.collect_set(F.when(asks | unsure, F.col("entity_type")))).alias("r"),
    )
    error = F.coalesce(detection_error, F.lit(False)) if detection_error is not None else F.lit(False)
    poor = F.coalesce(quality < limit, F.lit(False)) if quality is not None else F.lit(False)
    base = documents.select("doc_id", error.alias("__error"), poor.alias("__poor"))
    joined = base.join(own, "doc_id", "left")
    fatal = F.col("__error") & F.lit(policy.block_on_detection_error)
    level = F.greatest(F.coalesce("s", F.lit(0)), F.when(F.col("__poor"), 1).otherwise(0), F.when(F.col("__error"), 1).otherwise(0))
    none = F.array().cast("array<string>")
    reasons = F.concat(
        F.when(F.col("__error"), F.array(F.lit("detection failed"))).otherwise(none), F.coalesce("why", none),
        F.when(F.coalesce(F.col("first.unsure"), F.lit(False)) & ~F.col("__error"), F.array(F.col("first.why"))).otherwise(none),
        F.when(F.col("__poor"), F.array(F.lit("low text quality"))).otherwise(none),
    )
    return joined.select(
        "doc_id", F.element_at(F.array(*map(F.lit, DECISIONS)), F.when(fatal, 3).otherwise(level + 1)).alias("decision"),
        F.when(fatal, F.array(F.lit("detection failed"))).otherwise(reasons).alias("reasons"),
        F.when(fatal, none).otherwise(F.coalesce("b", none)).alias("blocked_entities"), F.when(fatal, none).otherwise(F.coalesce("r", none)).alias("review_entities"),
    )
