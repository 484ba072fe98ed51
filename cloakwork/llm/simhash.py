"""SimHash near-duplicates by multi-index hashing.

Two 64-bit fingerprints at distance 2 or less agree in one of their 32-bit
halves but for one bit at most. Each distinct fingerprint is stored under its
two halves and looked up under the 33 values of each half's Hamming ball of
radius 1; whole distances are then verified in the join itself, so that only
links leave it. Copies of a fingerprint are one class from the start, however
many there are. A fingerprint has at most 2,080 others within distance 2, so
links grow with the number of distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import regroup, shared_checkpoint, whole_text
from .components import connected_components

SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str, shingle_words: int) -> int:
    """The unsigned 64-bit SimHash of a text: a bit is set if over half the shingles' hashes have it."""
    words = text.encode().lower().split()  # bytes: only ASCII letters and ASCII white space count
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle_words:
        digests = [xxhash.xxh64_digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle_words + 1].tolist()
        digest = xxhash.xxh64_digest
        digests = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle_words - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(digests), BLOCK):
        block = np.frombuffer(b"".join(digests[i : i + BLOCK]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(digests)).tobytes(), "big")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprints(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(batches):
            found = np.array([fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], schema=SCHEMA)

    return run


def fingerprints(documents: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's 64 bits as a signed long."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(_fingerprints(shingle_words), "doc_id long, fp long")


def _halves(fp: Column) -> list[Column]:
    """The low half as a value of 0 to 2^32 - 1, the high half above that range."""
    low = F.lit((1 << 32) - 1)
    return [fp.bitwiseAND(low), F.shiftrightunsigned(fp, 32) + F.lit(1 << 32)]


def _flipped(half: Column, flips: Column) -> Column:
    return F.transform(flips, lambda x: half.bitwiseXOR(x))


def links(classes: DataFrame) -> DataFrame:
    """(u, v) for each two rows of ``classes`` (fp distinct, rep) whose fingerprints differ in one or two bits."""
    fp = F.col("fp")
    stored = classes.select(F.explode(F.array(*_halves(fp))).alias("key"), F.col("fp").alias("other"), F.col("rep").alias("v"))
    flips = F.array(*[F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)]])
    ball = F.flatten(F.array(*[_flipped(half, flips) for half in _halves(fp)]))
    probes = classes.select("fp", F.col("rep").alias("u"), F.explode(ball).alias("key"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2
    return probes.join(stored.hint("shuffle_hash"), (probes["key"] == stored["key"]) & near & (F.col("u") < F.col("v"))).select("u", "v")


def near_duplicates(documents: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of (doc_id, text).

    Words are runs without ASCII white space, A-Z in lower case; shingles of
    ``shingle_words`` words count as often as they occur. A text of fewer words
    is one shingle; one without words (null, empty, blank) has fingerprint zero
    and links like any other. Fingerprints link at 2 or fewer differing bits;
    component_id is the smallest doc_id that links reach. Rows that share a
    doc_id keep a fingerprint each and link their classes. A row without a doc_id
    takes no part: its component_id is null. An empty table gives an empty
    result; other columns are ignored.
    """
    found = shared_checkpoint(fingerprints(documents, shingle_words))
    known = found.where(F.col("doc_id").isNotNull())
    classes = shared_checkpoint(known.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # A repeated doc_id with several texts joins their classes.
    several = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    shared = known.join(several, "doc_id").join(classes, "fp").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    parts = connected_components(links(classes).unionByName(shared))
    named = classes.join(parts, classes["rep"] == parts["node"], "left").select(F.col("fp").alias("own"), F.coalesce("component", "rep").alias("component_id"))
    out = found.join(named, found["fp"] == named["own"], "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(documents: DataFrame, shingle_words: int = 3) -> DataFrame:
    """The rows of ``documents`` whose doc_id names its component: one of each group of near-duplicates.

    Of several rows with that doc_id one stays. Rows without a doc_id stay.
    """
    found = near_duplicates(documents, shingle_words)
    return rows_of(documents, shared_checkpoint(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__kept")).agg(F.count("*").alias("__rows"))))


def rows_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of each doc_id in ``ids`` (__kept, __rows: how many rows have it), and all rows without a doc_id."""
    kept = documents.join(ids, F.col("doc_id") == F.col("__kept"))
    names = documents.columns
    once = kept.where("__rows = 1").select(names).unionByName(documents.where(F.col("doc_id").isNull()))
    if ids.where("__rows > 1").isEmpty():
        return once
    return once.unionByName(kept.where("__rows > 1").dropDuplicates(["doc_id"]).select(names))
