"""Secret scans with multipart credential linking, in Spark expressions only.

Every whole text is matched against the base kinds (``assign``, ``access``,
``hex``) and against weak parts: login names, long mixed tokens and endpoints,
each too common to report alone. Weak parts are reported only where parts that
complement them lie in the same scope (at most ``SCOPE`` code points between
them). The scopes are found by an interval join on buckets of the document:
parts are at least eight characters long, so a bucket pairs a bounded number of
them, and only documents with weak parts take part.

Kinds, in the order used for equal starts: assign, access, hex (base), then
``key`` (a long mixed token near an access id, or near a login and an
endpoint), ``login`` (a user or client name near a base secret, or near a key
and an endpoint) and ``endpoint`` (a URL or host setting near an access id or a
base secret, or near a login and a key). Weak parts that overlap a base span
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_checkpoint, whole_text

SCOPE = 200
BUCKET = 1024
CHUNK = 64

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the same matches as AKIA[A-Z0-9]+ of 16 characters or more
HEX = r"[0-9a-f]{32,}"  # likewise
LOGIN = r"""(?<![A-Za-z0-9_])(?i:user(?:name)?|login|client_?id|account(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9@._-]{3,}"""
KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"""(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]{3,}|(?<![A-Za-z0-9_])(?i:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:/_-]{3,}"""

BASE = ("assign", "access", "hex")
WEAK = ("key", "login", "endpoint")
KINDS = (*BASE, *WEAK)
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; a lambda that mentions an outer expression computes it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(values: Column) -> Column:
    """The sum of the values before each of an array of ints, in two levels so that long arrays stay cheap."""

    def running(start: Column, part: Column) -> Column:
        """``part``'s sums before each element, with one more at the end."""
        return F.aggregate(part, F.array(start), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return _let(running(F.lit(0), totals), lambda starts: F.flatten(F.zip_with(parts, F.slice(starts, 1, F.size(parts)), lambda part, start: F.slice(running(start, part), 1, F.size(part)))))

    firsts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(CHUNK))
    return _let(F.transform(firsts, lambda c: F.slice(values, c + 1, CHUNK)), joined)


def spans(text: Column, kind: str, pattern: str, group: tuple[int, int] | None = None) -> Column:
    """The matches of a pattern as (start, kind, end) in code points; with (g, n), those whose group g has n characters."""
    p = F.lit(pattern)
    lengths = lambda g: F.transform(F.regexp_extract_all(text, p, F.lit(g)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.struct(lengths(0).alias("sizes"), gaps.alias("gaps"), (lengths(group[0]) if group else F.lit(None).cast("array<int>")).alias("widths"))

    def placed(v: Column) -> Column:
        steps = F.zip_with(v["sizes"], F.slice(v["gaps"], 1, F.size(v["sizes"])), lambda size, gap: size + gap)
        ends = _let(steps, lambda x: F.zip_with(x, sums_before(x), lambda own, before: own + before))
        made = F.zip_with(v["sizes"], ends, lambda size, end: F.struct((end - size).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end")))
        if not group:
            return made.cast(SPAN)
        least = group[1]
        kept = F.filter(F.arrays_zip(made.alias("span"), v["widths"].alias("width")), lambda r: r["width"] >= least)
        return F.transform(kept, lambda r: r["span"]).cast(SPAN)

    return F.when(text.rlike(pattern), _let(found, placed)).otherwise(F.array().cast(SPAN))


def _row_key() -> list[Column]:
    """A 128-bit hash of doc_id and the whole text; rows with the same key have the same spans."""
    parts = [F.col("doc_id").isNull(), F.col("doc_id"), whole_text()]
    return [F.xxhash64(*parts).alias("__a"), F.xxhash64(*reversed(parts), F.lit(1)).alias("__b")]


def _free(each: DataFrame) -> DataFrame:
    """``each`` (a span a row) without weak spans that overlap a base span."""
    own = Window.partitionBy("__a", "__b")
    is_base = F.col("kind") < len(BASE)
    ends = F.max(F.when(is_base, F.col("end"))).over(own.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    starts = F.min(F.when(is_base, F.col("start"))).over(own.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    marked = each.withColumn("__over", ends).withColumn("__next", starts)
    overlaps = F.coalesce(F.col("__over") > F.col("start"), F.lit(False)) | F.coalesce(F.col("__next") < F.col("end"), F.lit(False))
    return marked.where(is_base | ~overlaps).drop("__over", "__next")


def _linked(each: DataFrame) -> DataFrame:
    """The weak spans of ``each`` that complementary spans support, by an interval join within buckets of a row's text."""
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.greatest(a, F.lit(0)) / BUCKET), F.floor(b / BUCKET)))
    weak = each.where(F.col("kind") >= len(BASE)).withColumn("__bucket", buckets(F.col("start") - SCOPE, F.col("end") + SCOPE))
    other = each.select(*[F.col(c).alias(f"{c}2") for c in ("__a", "__b", "start", "kind", "end")])
    other = other.withColumn("__bucket2", buckets(F.col("start2"), F.col("end2")))
    same = (F.col("__a") == F.col("__a2")) & (F.col("__b") == F.col("__b2")) & (F.col("__bucket") == F.col("__bucket2"))
    near = (F.col("start2") <= F.col("end") + SCOPE) & (F.col("start") <= F.col("end2") + SCOPE) & (F.col("kind2") != F.col("kind"))
    pairs = weak.join(other, same & near)
    has = lambda *kinds: F.bool_or(F.col("kind2").isin(*[KINDS.index(k) for k in kinds]))
    flags = pairs.groupBy("__a", "__b", "start", "kind", "end").agg(has("access").alias("id"), has("assign", "hex").alias("secret"), has("key").alias("key"), has("login").alias("login"), has("endpoint").alias("endpoint"))
    rule = (
        F.when(F.col("kind") == KINDS.index("key"), F.col("id") | (F.col("login") & F.col("endpoint")))
        .when(F.col("kind") == KINDS.index("login"), F.col("secret") | (F.col("key") & F.col("endpoint")))
        .otherwise(F.col("id") | F.col("secret") | (F.col("login") & F.col("key")))
    )
    return flags.where(rule).select("__a", "__b", "start", "kind", "end")


def _detected(documents: DataFrame) -> DataFrame:
    """(__a, __b, start, kind, end) of every base and weak span, without repeated rows.

    The spans of a row come out of one explode, so that no later step repeats
    the matching. They are few against the texts; a checkpoint holds them.
    """
    text = whole_text()
    found = [spans(text, "assign", ASSIGN, (2, 8)), spans(text, "access", ACCESS), spans(text, "hex", HEX)]
    found += [spans(text, kind, pattern) for kind, pattern in zip(WEAK, (KEY, LOGIN, ENDPOINT), strict=True)]
    each = documents.select(*_row_key(), F.explode(F.flatten(F.array(*found))).alias("s"))
    return shared_checkpoint(each.select("__a", "__b", "s.start", "s.kind", "s.end").distinct())


def scan_secrets(documents: DataFrame) -> DataFrame:
    """``documents`` with ``spans``, an array of (start, kind, end) by start, then kind.

    Kinds are numbers of ``KINDS``; starts and ends are code points of the whole
    text, ends exclusive. Base spans are always there. A null or empty text has
    none. Rows are told apart by doc_id and text: repeated rows get the same
    spans, null doc_ids are like any other. A column of ``documents`` named
    spans is replaced. An empty table gives an empty result.
    """
    names = [c for c in documents.columns if c != "spans"]
    each = _free(_detected(documents))
    kept = each.where(F.col("kind") < len(BASE)).unionByName(_linked(each))
    own = kept.groupBy("__a", "__b").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).cast(SPAN).alias("spans"))
    own = own.select(F.col("__a").alias("__a2"), F.col("__b").alias("__b2"), "spans")
    keyed = documents.select(*names, *_row_key())
    joined = keyed.join(own, (F.col("__a") == F.col("__a2")) & (F.col("__b") == F.col("__b2")), "left")
    return joined.select(*names, F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def as_text(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of these kinds, joined by commas."""
    own = F.filter(found, lambda s: s["kind"].isin(*[KINDS.index(k) for k in kinds]))
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with every span of ``scan_secrets`` replaced by ``[kind]``, overlapping spans as one by the first.

    All other columns, one named spans too, stay as they are.
    """
    found = scan_secrets(documents.withColumnRenamed("spans", "__own_spans").withColumn("text", whole_text()))
    name = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        put = F.concat(a["out"], F.array(F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.element_at(name, s["kind"] + 1)))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], put).otherwise(a["out"]).alias("out"))

    state = F.aggregate("spans", zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    clean = F.when(F.size("spans") > 0, state).otherwise(F.col("text"))
    return found.withColumn("text", clean).drop("spans").withColumnRenamed("__own_spans", "spans").select(documents.columns)
