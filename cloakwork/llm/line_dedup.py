"""Line dedup with two Bloom filters.

Each build task passes its lines through a local pair of filters: "once" holds
the hash of each line seen, "twice" the hashes seen in a second document. The
pairs are merged by segment (a bit that two tasks' "once" filters share joins
"twice"), so "twice" has no false negatives. It is broadcast, and only lines
that it holds are shuffled: 16 bytes of hash and the document's id each. The
exact step keeps hashes that really occur in two documents, and the smallest
document id of each.

The filters' size follows the input's up to ``MAX_BITS`` (32 MB), the proven
bound of the broadcast. Beyond about 16 million distinct lines for each
doubling below that bound, false positives rise: more lines are shuffled, and
the result stays exact.

Lines are compared by the 128-bit XXH3 hash of their keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plan_bytes, regroup, shared_checkpoint, whole_text

SPACES = " \t\n\x0b\x0c\r"
PROBES = 4
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
SEGMENT_BITS = 1 << 20
#: Lines whose rows are not dealt by line, at most.
HOT_KEYS = 4096


def filter_bits(size_in_bytes: int) -> int:
    """Bits of a filter for an input of so many bytes: about 16 for each 64 bytes of input."""
    bits = MIN_BITS
    while bits < size_in_bytes // 4 and bits < MAX_BITS:
        bits *= 2
    return bits


def split_lines(texts: pa.Array) -> pa.ListArray:
    return pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")


def line_keys(lines: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.ascii_trim(lines, characters=SPACES))


def hashes(keys: pa.Array) -> np.ndarray:
    """(n, 2) unsigned 64-bit halves of the keys' hashes."""
    digests = b"".join(map(xxhash.xxh3_128_digest, keys.cast(pa.large_binary()).to_pylist()))
    return np.frombuffer(digests, dtype="<u8").reshape(-1, 2)


def eligible(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of the lines that take part."""
    lists = split_lines(texts)
    keys = line_keys(lists.flatten())
    mask = pc.greater_equal(pc.utf8_length(keys), min_chars)
    rows = np.asarray(pc.list_parent_indices(lists))[np.asarray(mask.to_numpy(zero_copy_only=False), dtype=bool)]
    return rows, hashes(keys.filter(mask))


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and masks of each hash's bits."""
    at = (h[:, :1] + np.arange(PROBES, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)
    return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def held(words: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at, mask = places(h, bits)
    return ((words[at] & mask) == mask).all(axis=1)


class FilterPair:
    """The once-seen and twice-seen filters of one task."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 64, dtype=np.uint64)
        self.twice = np.zeros(bits // 64, dtype=np.uint64)

    def add(self, documents: np.ndarray, h: np.ndarray) -> None:
        """Add lines; a line that recurs within one document counts once."""
        if not len(h):
            return
        order = np.lexsort((documents, h[:, 1], h[:, 0]))
        h, documents = h[order], documents[order]
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[1:] == h[:-1]).all(axis=1)
        again = np.zeros(len(h), dtype=bool)
        again[1:] = same[1:] & (documents[1:] != documents[:-1])
        heads = np.flatnonzero(~same)
        repeated = np.logical_or.reduceat(again, heads)
        h = h[heads]
        at, mask = places(h, self.bits)
        repeated |= ((self.once[at] & mask) == mask).all(axis=1)
        np.bitwise_or.at(self.twice, at[repeated].ravel(), mask[repeated].ravel())
        np.bitwise_or.at(self.once, at.ravel(), mask.ravel())

    def merge(self, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice |= twice | (self.once & once)
        self.once |= once


SEGMENTS = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
SUSPECTS = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])


def _build(bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, step = FilterPair(bits), SEGMENT_BITS // 64
        for batch in regroup(batches):
            rows, h = eligible(batch.column(1), min_chars)
            pair.add(np.asarray(batch.column(0))[rows], h)
        for k in range(bits // SEGMENT_BITS):
            once = pair.once[k * step : (k + 1) * step]
            if once.any():
                packed = [[k], [zlib.compress(once.tobytes(), 1)], [zlib.compress(pair.twice[k * step : (k + 1) * step].tobytes(), 1)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(packed, SEGMENTS.types, strict=True)], schema=SEGMENTS)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs: dict[int, FilterPair] = {}
    for batch in batches:
        for k, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pair = pairs.setdefault(k, FilterPair(SEGMENT_BITS))
            pair.merge(*(np.frombuffer(zlib.decompress(x), dtype=np.uint64) for x in (once, twice)))
    for k, pair in pairs.items():
        packed = [[k], [b""], [zlib.compress(pair.twice.tobytes(), 1)]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(packed, SEGMENTS.types, strict=True)], schema=SEGMENTS)


def twice_seen(documents: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The merged twice-seen filter of (doc_id, text); at most ``MAX_BITS`` reach the driver."""
    spark = documents.sparkSession
    ddl = "segment int, once binary, twice binary"
    # One filter pair for each core, not for each split, so that what is merged does not grow with the input.
    tasks = max(2, 2 * spark.sparkContext.defaultParallelism)
    merged = documents.coalesce(tasks).mapInArrow(_build(bits, min_chars), ddl).repartition("segment").mapInArrow(_merge, ddl)
    words, step = np.zeros(bits // 64, dtype=np.uint64), SEGMENT_BITS // 64
    for row in merged.collect():
        words[row.segment * step : (row.segment + 1) * step] = np.frombuffer(zlib.decompress(row.twice), dtype=np.uint64)
    return words


def _probe(shared, bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(shared.value, dtype=np.uint64)
        for batch in regroup(batches):
            rows, h = eligible(batch.column(1), min_chars)
            hit = held(words, h, bits)
            found = np.unique(np.column_stack([np.asarray(batch.column(0))[rows[hit]].view(np.uint64), h[hit]]), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(3)], schema=SUSPECTS)

    return run


def _rewrite(text_at: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(batches):
            texts = batch.column(text_at).to_pylist()
            lines, dropped = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, drops in enumerate(batch.column(batch.num_columns - 1)):
                if not drops.is_valid:
                    lines[i] = (texts[i] or "").count("\n") + 1
                    continue
                gone = {(x["h1"], x["h2"]) for x in drops.as_py()}
                own = (texts[i] or "").split("\n")
                h = hashes(line_keys(pa.array(own, pa.large_string()))).view(np.int64)
                kept = [line for line, pair in zip(own, map(tuple, h.tolist()), strict=True) if pair not in gone]
                lines[i], dropped[i], texts[i] = len(own), len(own) - len(kept), "\n".join(kept)
            columns = list(batch.columns[:-1])
            columns[text_at] = pa.array(texts, schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines), pa.array(dropped)], schema=schema)

    return run


def dedup_lines(documents: DataFrame, min_chars: int = 10) -> DataFrame:
    """Drop lines that an earlier document holds.

    Every text is split at newlines (a null or empty text is one empty line).
    A line's key is the line without ASCII white space at its ends, with A-Z in
    lower case. A key of at least ``min_chars`` code points that two documents
    or more hold loses its lines in all but the smallest ``doc_id``. Returns
    the columns of ``documents`` with the rest of each text in ``text`` and
    ``n_lines`` (before) and ``n_dropped`` (a column so named is replaced).

    Rows that share a ``doc_id`` count as one document. A row without ``doc_id``
    takes no part: it keeps its lines and takes none from others. A text that
    keeps all its lines stays as it is, null included. An empty table gives an
    empty result.
    """
    names = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    keyed = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    bits = filter_bits(plan_bytes(keyed))
    shared = documents.sparkSession.sparkContext.broadcast(twice_seen(keyed, bits, min_chars).tobytes())
    suspects = shared_checkpoint(keyed.mapInArrow(_probe(shared, bits, min_chars), "doc_id long, h1 long, h2 long"))
    counted = suspects.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    firsts = shared_checkpoint(counted.where("first < last").drop("last"))
    # Fewer than HOT_KEYS lines can have more than one in HOT_KEYS of the suspects' rows: these are broadcast, so that no task holds one of them whole.
    hot = F.col("n") > suspects.count() // HOT_KEYS
    rest = suspects.join(F.broadcast(firsts.where(hot)), ["h1", "h2"], "left_anti").join(firsts.where(~hot), ["h1", "h2"])
    drops = (
        suspects.join(F.broadcast(firsts.where(hot)), ["h1", "h2"])
        .unionByName(rest)
        .where("doc_id > first")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("__drops"))
        .select(F.col("doc_id").alias("__doc"), "__drops")
    )
    joined = documents.select(names).join(drops.hint("shuffle_hash"), F.col("doc_id") == F.col("__doc"), "left").select(*names, "__drops")
    fields = [f.simpleString().split(":", 1) for f in documents.select(names).schema]
    ddl = ", ".join(f"`{n}` {t}" for n, t in fields) + ", n_lines long, n_dropped long"
    from pyspark.sql.pandas.types import to_arrow_schema

    out = documents.select(*names, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return joined.mapInArrow(_rewrite(names.index("text"), to_arrow_schema(out.schema)), ddl)
