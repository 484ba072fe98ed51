"""Packing token streams into sequences by first-fit decreasing.

Documents longer than a sequence are cut into full sequences and a rest. Pieces
are dealt by a hash into randomised groups of about ``GROUP`` pieces; each group
is packed on its own, with a tournament tree whose leaves are the free space of
the group's bins: the leftmost bin that a piece fits is found in O(log bins).
Only (id, start, length) are shuffled, tokens too where they are asked for
(``with_ids``), and no task sees more than its group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import regroup, whole_text
from .tokens import WordBpe

GROUP = 4096
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
PACKED_DDL = PIECES_DDL + ", sequence_id long, offset long"

_encoders: dict[int, WordBpe] = {}


def encoder(spec: bytes) -> WordBpe:
    """The worker's encoder for this vocabulary file."""
    key = zlib.crc32(spec)
    if key not in _encoders:
        _encoders[key] = WordBpe(spec)
    return _encoders[key]


class Tournament:
    """First fit over bins of equal capacity: inner nodes hold the most free space below them."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The leftmost bin with ``size`` free, and the space that is then left there."""
        free, at, leaves = self.free, 1, self.leaves
        while at < leaves:
            at *= 2
            if free[at] < size:
                at += 1
        left = free[at] - size
        free[at] = left
        bin_at = at - leaves
        while at > 1:
            best = free[at] if free[at] >= free[at ^ 1] else free[at ^ 1]
            at >>= 1
            if free[at] == best:
                break
            free[at] = best
        return bin_at, left


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, in the order given (ties: earlier first)."""
    tree = Tournament(max(1, len(sizes)), capacity)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i], left = tree.place(sizes[i])
        offsets[i] = capacity - left - sizes[i]
    return bins, offsets


def _pieces(spec, end_id: int, capacity: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        for batch in regroup(batches):
            docs = batch.column(0).to_pylist()
            got, out = bpe.encode(batch.column(1)), []
            for i, doc in enumerate(docs):
                ids = bytes(got.row(i)) + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    out.append((doc, start, len(own) // 4, zlib.crc32(own), total, np.frombuffer(own, "<i4") if with_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), PIECES.types, strict=True)], schema=PIECES)

    return run


def _pack(capacity: int):
    def run(key, group):
        order = [("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        group = group.sort_by(order).drop_columns(["__group"])
        bins, offsets = first_fit_decreasing(group.column("length").to_pylist(), capacity)
        ids = (key[0].as_py() << 32) + np.array(bins, np.int64)
        return group.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Pack (doc_id, text) into sequences of at most ``capacity`` tokens.

    A document is its text's ids (a null text is empty) and then ``end_id``.
    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids
    (null unless ``with_ids``), sequence_id and offset. Each id is in one piece;
    the offsets of a sequence leave no gap. Equal lengths are packed in order of
    doc_id. A row with a null doc_id or a repeated one is packed like any other.
    Other columns are ignored; an empty table gives an empty result. Input rows
    and bytes are counted once to choose the number of groups.
    """
    spark = documents.sparkSession
    with open(tokenizer_path, "rb") as file:  # on the driver; a few MB, broadcast to the workers
        spec = spark.sparkContext.broadcast(file.read())
    # A token holds a byte at least, four or so on average: about a piece for each row and for each so many bytes.
    size = documents.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-(size.rows + size.bytes // (4 * capacity)) // GROUP))
    pieces = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(_pieces(spec, end_id, capacity, with_ids), PIECES_DDL)
    # The row's place parts equal rows, which would all fall into one group.
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(_pack(capacity), PACKED_DDL)
