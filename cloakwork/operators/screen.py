"""Screening: all layers, resolved, with their figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..types import NER, UNVALIDATED, is_special
from .detect import candidates, validated
from .recover import all_spans
from .resolve import resolve_overlaps

#: A detector of names: documents in, rows of spans (without ord) out.
NerPlugin = Callable[[DataFrame], DataFrame]


def gazetteer(entries: dict[str, str], confidence: float = 0.8) -> NerPlugin:
    """A deterministic detector: the given phrases, as whole words, with their entity types."""
    import re

    from ..functions.strings import matches

    def detect(documents: DataFrame) -> DataFrame:
        out = None
        for entity_type in sorted(set(entries.values())):
            phrases = sorted((p for p, t in entries.items() if t == entity_type), key=len, reverse=True)
            pattern = r"(?U)(?<!\w)(?:" + "|".join(re.escape(p) for p in phrases) + r")(?!\w)"
            rows = documents.select("doc_id", F.explode(matches(F.col("text"), pattern)).alias("m")).select("doc_id", "m.start", "m.end", F.col("m.raw").alias("text"), F.lit(entity_type).alias("entity_type"), F.lit(confidence).alias("confidence"))
            out = rows if out is None else out.unionByName(rows)
        return out

    return detect


def _from_plugin(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "start", "end", "text", "entity_type", F.lit(NER).alias("layer"), "confidence", F.lit(False).alias("ocr_corrected"),
        F.lit(None).cast("string").alias("corrected_text"), F.lit(None).cast("string").alias("correction_note"), F.lit(0).alias("edits"), F.lit(False).alias("ambiguous"), F.lit(200).alias("ord"),
    )


def detected_spans(documents: DataFrame, ner: NerPlugin | None = None) -> DataFrame:
    """The spans of all layers, overlaps included."""
    out = all_spans(validated(candidates(documents)))
    return out if ner is None else out.unionByName(_from_plugin(ner(documents)))


def screen(documents: DataFrame, ner: NerPlugin | None = None) -> DataFrame:
    """The spans of ``documents`` (doc_id, text) without overlaps."""
    return resolve_overlaps(detected_spans(documents, ner))


def counts_by(spans: DataFrame, column: str) -> DataFrame:
    return spans.groupBy("doc_id", column).agg(F.count("*").alias("n"))


def screen_summary(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_spans, min_confidence, has_special_category) of every document; without spans 0, 1.0 and false."""
    own = spans.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("confidence").alias("c"), F.bool_or(is_special(F.col("entity_type"))).alias("s"))
    return documents.select("doc_id").join(own, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("c", F.lit(1.0)).alias("min_confidence"), F.coalesce("s", F.lit(False)).alias("has_special_category"))


def screen_stats(documents: DataFrame, ner: NerPlugin | None = None) -> DataFrame:
    """One row of figures over all documents: characters, hits of each layer, recoveries, and spans that overlaps cost."""
    # Texts are read once for spans and for candidates that are none.
    rows = all_spans(validated(candidates(documents)), with_failed=True)
    rows = cut(rows if ner is None else rows.unionByName(_from_plugin(ner(documents))))
    every, failed = rows.where(F.col("layer") != UNVALIDATED), rows.where(F.col("layer") == UNVALIDATED).agg(F.count("*").alias("unvalidated"))
    layers = every.agg(*[F.count_if(F.col("layer").isin(*names)).alias(key) for key, names in (("regex_hits", ("regex", "checksum")), ("recovered", ("ocr_recovery",)), ("ner_hits", ("ner",)))], F.count_if("ambiguous").alias("recovered_ambiguous"), F.count("*").alias("detected"))
    kept = resolve_overlaps(every).agg(F.count("*").alias("total"))
    chars = documents.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("chars"))
    one = chars.crossJoin(layers).crossJoin(kept).crossJoin(failed)  # one row each
    return one.select("chars", "regex_hits", "unvalidated", "recovered", "recovered_ambiguous", "ner_hits", "total", (F.col("detected") - F.col("total")).alias("dropped"), F.lit(ner is not None).alias("ner_enabled"))


def summarize_layers(spans: DataFrame) -> DataFrame:
    """(doc_id, summary): layer=count, sorted, joined by bars."""
    each = counts_by(spans, "layer").select("doc_id", F.concat_ws("=", "layer", F.col("n").cast("string")).alias("x"))
    return each.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("x")), " | ").alias("summary"))
