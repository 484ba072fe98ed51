"""Audit logs as hash chains: each entry's hash covers the one before.

A chain is sequential by nature, so logs are kept apart by ``log_id`` (a batch,
a day, a shard): logs are chained side by side, and a small chain over their
last hashes ties them together. Verifying needs no order of work at all: an
entry names the hash before it, so every entry is checked on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def canonical_json(seq: Column, timestamp: Column, event: Column, payload: Column) -> Column:
    """Sorted keys without spaces; ``payload`` is canonical JSON already."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    return F.concat(F.lit('{"event":'), quoted(event), F.lit(',"payload":'), payload, F.lit(',"seq":'), seq.cast("string"), F.lit(',"timestamp":'), quoted(timestamp), F.lit("}"))


def entry_hash(prev_hash: Column, canonical: Column) -> Column:
    return F.sha2(F.concat(prev_hash, canonical), 256)


def chain(events: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """(log_id, seq, timestamp, event, payload, prev_hash, hash) of ``events`` (log_id, ord, timestamp, event, payload).

    Entries of a log are chained by ``ord``. ``after`` (log_id, seq, hash), the last entry of each log so far, is continued.
    """
    rows = events.groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("ord", "timestamp", "event", "payload"))).alias("rows"))
    if after is not None:
        rows = rows.join(after.select("log_id", F.col("seq").alias("__seq"), F.col("hash").alias("__hash")), "log_id", "left")
    else:
        rows = rows.withColumn("__seq", F.lit(0).cast("long")).withColumn("__hash", F.lit(GENESIS))
    kind = "array<struct<seq:bigint,timestamp:string,event:string,payload:string,prev_hash:string,hash:string>>"
    start = F.struct(F.coalesce("__seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("__hash", F.lit(GENESIS)).alias("hash"), F.array().cast(kind).alias("out"))

    def step(a: Column, r: Column) -> Column:
        seq = a["seq"] + 1
        own = entry_hash(a["hash"], canonical_json(seq, r["timestamp"], r["event"], r["payload"]))
        entry = F.struct(seq.alias("seq"), r["timestamp"].alias("timestamp"), r["event"].alias("event"), r["payload"].alias("payload"), a["hash"].alias("prev_hash"), own.alias("hash"))
        return F.struct(seq.alias("seq"), own.alias("hash"), F.array_append(a["out"], entry).alias("out"))

    return rows.select("log_id", F.inline(F.aggregate("rows", start, step, lambda a: a["out"])))


def heads(log: DataFrame) -> DataFrame:
    """(log_id, seq, hash): the last entry of each log."""
    return log.groupBy("log_id").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def anchor(log: DataFrame) -> DataFrame:
    """One chain over the logs' last hashes, in the order of log_id; a row a log."""
    events = heads(log).select(F.lit("anchor").alias("log_id"), F.col("log_id").cast("string").alias("ord"), F.lit("").alias("timestamp"), F.lit("anchor").alias("event"), F.to_json(F.struct("hash", F.col("log_id").cast("string").alias("log_id"), "seq")).alias("payload"))
    return chain(events)


def verify(log: DataFrame) -> DataFrame:
    """(log_id, valid, entries, broken_at, reason): the first entry, by seq, that breaks each log."""
    own = Window.partitionBy("log_id").orderBy("seq")
    seq, prev = F.lag("seq").over(own), F.lag("hash").over(own)
    good = entry_hash(F.col("prev_hash"), canonical_json(F.col("seq"), F.col("timestamp"), F.col("event"), F.col("payload")))
    wrong = (
        F.when(F.col("seq") != F.coalesce(seq, F.lit(0)) + 1, "sequence")
        .when(F.col("prev_hash") != F.coalesce(prev, F.lit(GENESIS)), "link")
        .when(good != F.col("hash"), "content")
    )
    checked = log.select("log_id", "seq", wrong.alias("why"))
    out = checked.groupBy("log_id").agg(F.count("*").alias("entries"), F.min_by(F.struct("seq", "why"), F.when(F.col("why").isNotNull(), F.col("seq"))).alias("first"))
    broken = F.col("first.why").isNotNull()
    return out.select("log_id", (~F.coalesce(broken, F.lit(False))).alias("valid"), "entries", F.when(broken, F.col("first.seq")).alias("broken_at"), F.when(broken, F.col("first.why")).alias("reason"))


def for_document(log: DataFrame, doc_id: str) -> DataFrame:
    return log.where(F.get_json_object("payload", "$.doc_id") == doc_id)


def tail(log: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` entries of each log; a log's entries are numbered without gaps, so no sort is needed."""
    last = log.groupBy("log_id").agg(F.max("seq").alias("__last"))
    return log.join(last, "log_id").where(F.col("seq") > F.col("__last") - n).drop("__last")


def events_of(documents: DataFrame, spans: DataFrame, decisions: DataFrame, timestamp: str, log_id: Column | None = None) -> DataFrame:
    """Three events a document: ingest, screen, decision. Payloads hold counts and hashes, never values."""
    own = log_id if log_id is not None else F.lit("log")
    counts = spans.groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = documents.join(counts, "doc_id", "left").join(decisions, "doc_id", "left")
    each = [
        ("ingest", F.to_json(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")))),
        ("screen", F.to_json(F.struct("doc_id", F.coalesce("n", F.lit(0)).alias("n_spans")))),
        ("decision", F.to_json(F.struct("decision", "doc_id"))),
    ]
    rows = F.array(*[F.struct(F.struct(F.col("doc_id").alias("d"), F.lit(k).alias("k")).alias("ord"), F.lit(event).alias("event"), payload.alias("payload")) for k, (event, payload) in enumerate(each)])
    return joined.select(own.alias("log_id"), F.lit(timestamp).alias("timestamp"), F.inline(rows)).select("log_id", "ord", "timestamp", "event", "payload")
