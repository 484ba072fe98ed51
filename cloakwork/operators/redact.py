"""Redaction: spans become tokens or less precise values; the token map goes its own way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import canonical_digest, canonical_form, generalize, token_of
from .policy import Policy, action_columns

MAX_TOKEN = 16


def canonical_value() -> Column:
    """The repaired text where there is one, else the text as written."""
    return F.coalesce(F.when(F.col("corrected_text") != "", F.col("corrected_text")), F.col("text"))


def replacements(spans: DataFrame, policy: Policy, salt: bytes | Column, token_length: int = 4, ascii_only: bool = False) -> DataFrame:
    """``spans`` that change, with action, canonical, token (null unless pseudonymised) and replacement.

    Two values of a document whose tokens would be equal are told apart: the one
    that comes last in the text keeps the short token, others get two hex digits
    more at a time, until free (16 at most).
    """
    action, target = action_columns(F.col("entity_type"), policy)
    rows = spans.withColumn("action", action).where(F.col("action") != "keep").withColumn("__target", target)
    rows = rows.withColumn("canonical", canonical_form(canonical_value(), F.col("entity_type"))).withColumn("__coded", F.col("action") == "pseudonymize")
    coded = F.col("__coded")
    # A value's place is that of its last occurrence. This window asks for documents only, so that all below share its one exchange.
    same = Window.partitionBy("doc_id").orderBy("entity_type", "canonical").rangeBetween(Window.currentRow, Window.currentRow)
    rows = rows.withColumn("__place", F.max(F.when(coded, F.col("start"))).over(same)).withColumn("__digest", canonical_digest(F.col("canonical"), F.col("entity_type"), salt))
    own = F.struct("__place", "__digest")
    alike = F.collect_set(F.when(coded, own)).over(Window.partitionBy("doc_id", "entity_type", F.substring("__digest", 1, token_length)))
    rows = rows.withColumn("__alike", alike)
    first = lambda n: ~F.exists("__alike", lambda r: (r > own) & (F.substring(r["__digest"], 1, n) == F.substring("__digest", 1, n)))
    lengths = range(token_length, MAX_TOKEN, 2)
    length = F.lit(max([token_length, *(n + 2 for n in lengths)]))
    for n in reversed(lengths):
        length = F.when(first(n), n).otherwise(length)
    length = F.when(F.size("__alike") < 2, token_length).otherwise(length)
    token = F.when(coded, token_of(F.col("__digest"), F.col("entity_type"), length, ascii_only))
    out = rows.withColumn("token", token).withColumn("replacement", F.coalesce("token", generalize(F.col("text"), F.col("__target"))))
    return out.drop("__coded", "__digest", "__place", "__alike", "__target")


def token_map(replaced: DataFrame) -> DataFrame:
    """(doc_id, token, original): the spelling of a token's first occurrence in the text. Restricted data."""
    return replaced.where(F.col("token").isNotNull()).groupBy("doc_id", "token").agg(F.min_by("text", "start").alias("original"))


def redaction_stats(replaced: DataFrame) -> DataFrame:
    """(doc_id, tokens_issued, unique_tokens, generalized); generalised spans count as issued."""
    return replaced.groupBy("doc_id").agg(F.count("*").alias("tokens_issued"), F.count_distinct("token").alias("unique_tokens"), F.count_if(F.col("token").isNull()).alias("generalized"))


def rewrite(documents: DataFrame, replaced: DataFrame) -> DataFrame:
    """``documents`` with ``safe_text``: each span of ``replaced`` (disjoint within a document) by its replacement."""
    parts = replaced.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("__spans"))
    joined = documents.join(parts, "doc_id", "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        kept = F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"])
        return F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(kept, s["replacement"])).alias("out"))

    built = F.aggregate("__spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return joined.withColumn("safe_text", F.when(F.col("__spans").isNotNull(), built).otherwise(F.col("text"))).drop("__spans")
