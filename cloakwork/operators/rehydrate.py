"""The return trip: tokens in a response become the original values again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import matches

#: Delimiters may be swapped for ASCII ones and spaces may creep in.
TOKEN = r"(?U)(?:⟦|\[\[)\s*([A-Z0-9]+)\s*_\s*([0-9a-f]{4,8})\s*(?:⟧|\]\])"


def token_key(token: Column) -> Column:
    """ABBR_digest, whatever the delimiters and spaces; null for what is no token."""
    short, digest = (F.regexp_extract(token, TOKEN, k) for k in (1, 2))
    return F.when(short != "", F.concat_ws("_", short, digest))


def response_tokens(responses: DataFrame) -> DataFrame:
    """(doc_id, start, end, raw, key) of every token in ``responses`` (doc_id, response)."""
    each = responses.select("doc_id", F.explode(matches(F.col("response"), TOKEN)).alias("m"))
    return each.select("doc_id", "m.start", "m.end", "m.raw", token_key(F.col("m.raw")).alias("key"))


def _index(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", token_key(F.col("token")).alias("key"), "original").where(F.col("key").isNotNull()).groupBy("doc_id", "key").agg(F.max("original").alias("original"))


def missing_tokens(responses: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, key) of issued tokens that a document's response lacks."""
    issued = _index(tokens).join(responses.select("doc_id").distinct(), "doc_id", "left_semi")
    return issued.join(response_tokens(responses).select("doc_id", "key"), ["doc_id", "key"], "left_anti").select("doc_id", "key")


def unknown_tokens(responses: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, raw) of tokens in responses that were never issued."""
    return response_tokens(responses).join(_index(tokens), ["doc_id", "key"], "left_anti").select("doc_id", "raw").distinct()


def token_coverage(responses: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, issued, returned, coverage): distinct tokens that came back; without any issued, coverage is 1."""
    issued = tokens.groupBy("doc_id").agg(F.count_distinct("token").alias("issued"))
    back = response_tokens(responses).join(_index(tokens), ["doc_id", "key"], "left_semi").groupBy("doc_id").agg(F.count_distinct("key").alias("returned"))
    joined = responses.select("doc_id").join(issued, "doc_id", "left").join(back, "doc_id", "left")
    n, k = F.coalesce("issued", F.lit(0)), F.coalesce("returned", F.lit(0))
    return joined.select("doc_id", n.alias("issued"), k.alias("returned"), F.when(n == 0, 1.0).otherwise(k / n).alias("coverage"))


def rehydrate(responses: DataFrame, tokens: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, text, substituted, issued, coverage, unknown, warnings) of each response; a doc_id has one response.

    Unknown tokens stay as they are; with ``strict`` they fail the query.
    """
    found = response_tokens(responses).join(_index(tokens), ["doc_id", "key"], "left")
    known = F.col("original").isNotNull()
    parts = found.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(known, F.struct("start", "end", "original")))).alias("__parts"),
        F.sort_array(F.collect_set(F.when(~known, F.col("raw")))).alias("unknown"),
    )
    joined = responses.join(parts, "doc_id", "left").join(token_coverage(responses, tokens), "doc_id", "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(F.col("response"), a["at"] + 1, s["start"] - a["at"]), s["original"])).alias("out"))
    built = F.aggregate("__parts", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("response"), a["at"] + 1, F.length("response"))))
    unknown = F.coalesce("unknown", F.array().cast("array<string>"))
    if strict:
        built = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown tokens: "), F.array_join(unknown, ", ")))).otherwise(built)
    warnings = F.array_compact(F.array(F.when(F.size(unknown) > 0, F.lit("unknown tokens were left as they are")), F.when((F.col("issued") > 0) & (F.col("coverage") < 0.5), F.lit("less than half of the tokens came back"))))
    return joined.select("doc_id", F.coalesce(built, F.col("response")).alias("text"), F.col("returned").alias("substituted"), "issued", "coverage", unknown.alias("unknown"), warnings.alias("warnings"))
