"""Overlapping spans: which overlap, and which of them stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import is_checksum

ISLAND = ("doc_id", "__island")


def overlap_pairs(spans: DataFrame, bucket: int = 1024) -> DataFrame:
    """(doc_id, start_a, end_a, start_b, end_b) of spans of a document that overlap, each pair once.

    An interval join within buckets of the text, so a long document's spans
    don't meet each other all at once; a pair is kept in the bucket where it
    starts to overlap.
    """
    cut = spans.select("doc_id", "start", "end", "ord").withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / bucket))))
    a = cut.select("doc_id", "__bucket", *[F.col(c).alias(f"{c}_a") for c in ("start", "end", "ord")])
    b = cut.select("doc_id", "__bucket", *[F.col(c).alias(f"{c}_b") for c in ("start", "end", "ord")])
    first = F.struct("start_a", "end_a", "ord_a") < F.struct("start_b", "end_b", "ord_b")
    meet = first & (F.col("start_a") < F.col("end_b")) & (F.col("start_b") < F.col("end_a"))
    pairs = a.join(b, ["doc_id", "__bucket"]).where(meet & (F.col("__bucket") == F.floor(F.greatest("start_a", "start_b") / bucket)))
    return pairs.select("doc_id", "start_a", "end_a", "start_b", "end_b")


def _priority() -> Column:
    """Sorts the strongest first; equal ones in the order found."""
    return F.struct(
        (~is_checksum(F.col("entity_type"))).alias("a"), (-(F.col("end") - F.col("start"))).alias("b"), (-F.col("confidence")).alias("c"),
        F.col("ord").alias("d"), F.col("start").alias("e"),
    )


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """The spans that stay: of those that overlap the strongest, then the next strongest that is free.

    Spans that no chain of overlaps joins can't matter to each other, so each
    document is first cut into islands and the greedy choice runs within one.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "end", "ord")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), 1).otherwise(0)
    cut = spans.withColumn("__opens", opens).withColumn("__island", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")
    names = spans.columns
    row = F.struct(_priority().alias("p"), F.struct(*names).alias("s"))
    grouped = cut.groupBy(*ISLAND).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    none = F.slice(F.transform("rows", lambda r: r["s"]), 1, 0)
    free = lambda kept, s: ~F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
    kept = F.when(F.size("rows") == 1, F.transform("rows", lambda r: r["s"])).otherwise(
        F.aggregate("rows", none, lambda a, r: F.when(free(a, r["s"]), F.array_append(a, r["s"])).otherwise(a))
    )
    return grouped.select(F.inline(kept)).select(*names)
