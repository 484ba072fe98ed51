"""The whole way of a document: screen, decide, redact, attest, emit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..functions.quality import quality_score
from ..functions.tokens import document_salt
from ..lineage import cut, spread
from ..operators import audit, emit, manifest
from ..operators.policy import Policy, decide
from ..operators.redact import redaction_stats, replacements, rewrite, token_map
from ..operators.screen import NerPlugin, screen, screen_summary


@dataclass
class Results:
    """Named tables of one run; all are lazy."""

    documents: DataFrame  # a row a document: decision, reasons, safe_text, figures
    spans: DataFrame
    tokens: DataFrame | None  # restricted; None if nothing is to be restored
    events: DataFrame

    def manifests(self, policy: Policy, key: bytes) -> DataFrame:
        return manifest.sign(manifest.manifests(self.documents, policy, __version__), key)

    def rendered(self, policy: Policy) -> DataFrame:
        return emit.render(self.documents, policy, __version__)


def process(documents: DataFrame, policy: Policy | None = None, salt: bytes | None = None, master: bytes | None = None, ner: NerPlugin | None = None, quality: Column | None = None, timestamp: str = "1970-01-01T00:00:00+00:00") -> Results:
    """Process ``documents`` (doc_id, text; source_name, source_sha256, pages, pages_below and detection_error if there).

    Tokens are keyed per document, from ``master``, unless one ``salt`` for all is
    given. ``quality`` is a column of ``documents``; by default the text is assessed.
    A document with detection_error set is treated by the policy's rule for errors.
    """
    policy = policy or Policy()
    if master is not None and len(master) < 32:
        raise ValueError("a master key has 32 bytes at least")
    if (salt is None) == (master is None):
        raise ValueError("give either a salt for the whole corpus or a master key for salts of documents")
    has = set(documents.columns)
    named = documents.select(
        "doc_id", "text", F.col("source_name") if "source_name" in has else F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("source_name"),
        F.col("source_sha256") if "source_sha256" in has else F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256"),
        F.col("pages_below") if "pages_below" in has else F.array().cast("array<long>").alias("pages_below"),
        F.col("pages") if "pages" in has else F.lit(1).alias("pages"), F.col("detection_error").isNotNull().alias("error") if "detection_error" in has else F.lit(False).alias("error"),
    )
    # The assessment scans each text several times: it is made once, for decisions and for warnings.
    assessed = cut(spread(documents).select("doc_id", (quality if quality is not None else quality_score(F.col("text"))).alias("quality")))
    # Everything below goes back to the spans, which are few against the texts: they are found once.
    spans = cut(screen(named, ner))
    key = salt if salt is not None else document_salt(master, F.col("doc_id"))
    replaced = cut(replacements(spans, policy, key))
    decisions = decide(named.drop("text").join(assessed, "doc_id"), spans, policy, F.col("quality"), F.col("error"))
    ambiguous = spans.groupBy("doc_id").agg(F.count_if("ambiguous").alias("__ambiguous"))
    out = rewrite(named, replaced).join(assessed, "doc_id").join(decisions, "doc_id").join(screen_summary(named, spans), "doc_id")
    out = out.join(redaction_stats(replaced), "doc_id", "left").join(emit.legend(spans, policy), "doc_id", "left").join(ambiguous, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    warned = emit.warnings_of(F.lit(ner is not None), F.lit(None).cast("string"), F.col("quality"), F.col("pages_below"), F.coalesce("__ambiguous", F.lit(0)), F.col("decision"))
    rows = out.select(
        "doc_id", "source_name", "pages", "source_sha256", "quality", "decision", "reasons", "blocked_entities", "review_entities",
        "n_spans", "min_confidence", "has_special_category", zero("tokens_issued"), zero("unique_tokens"), zero("generalized"), "legend", warned.alias("warnings"), "safe_text",
    )
    tokens = token_map(replaced) if policy.mode == "pseudonymize" else None
    return Results(rows, spans, tokens, audit.events_of(named, spans, decisions.select("doc_id", "decision"), timestamp))


def ingest_summary(results: Results) -> DataFrame:
    return results.documents.select("doc_id", "source_name", "decision", "n_spans", "tokens_issued", "unique_tokens", F.round("quality", 3).alias("quality"), F.size("warnings").cast("long").alias("n_warnings"))
