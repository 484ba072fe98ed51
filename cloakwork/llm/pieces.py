"""SentencePiece BPE encoding and decoding by a table over prefixes.

BPE has at most one result for each prefix of a text, so it is enough to store
that result's last piece. The table is filled from left to right: an automaton
reports the pieces that end at each place, and the one that may follow the last
piece of the prefix before it is the prefix's last piece. Two pieces may follow
each other if merging their joined characters gives just those two, which is
tested by undoing their merges at the seam, best scores last. The ids are then
recovered from the end backwards. The work is linear in the text's length.

Texts are cut where no piece of the vocabulary can cross (before runs of the
space mark, around newlines), and each distinct unit of a batch is encoded once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import regroup, whole_text
from .tokens import CACHE_UNITS, Gathered, distinct_units, gather

MARK = "▁"
CUT = "\x01"
NEVER = 1 << 60


@dataclass(frozen=True)
class Vocabulary:
    """What is used of a model file; small enough to be broadcast."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]  # 1 normal, 2 unknown, 3 control, 6 byte
    begin: int
    end: int


def read_model(path: str) -> Vocabulary:
    """Read a model file; models that need more than is built here are refused."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    spec = proto.normalizer_spec
    if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
        raise ValueError("only BPE models with byte fallback can be read")
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
        raise ValueError("only models with identity normalisation and a leading space mark can be read")
    kinds = tuple(p.type for p in proto.pieces)
    if not set(kinds) <= {1, 2, 3, 6}:
        raise ValueError("user-defined and unused pieces can't be read")
    normal = [p.piece for p in proto.pieces if p.type == 1]
    single = {p for p in normal if len(p) == 1}
    if any(c not in single for p in normal for c in p) or any(MARK in p.lstrip(MARK) or "\n" in p for p in normal if len(p) > 1):
        raise ValueError("every character of a piece must be a piece, and space marks must lead")
    return Vocabulary(tuple(p.piece for p in proto.pieces), tuple(p.score for p in proto.pieces), kinds, proto.trainer_spec.bos_id, proto.trainer_spec.eos_id)


class PieceBpe:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        v = self.vocabulary = vocabulary
        normal = [i for i, kind in enumerate(v.kinds) if kind == 1]
        self.id_of = {v.pieces[i]: i for i in normal}
        self.byte_id = {int(v.pieces[i][3:5], 16): i for i, kind in enumerate(v.kinds) if kind == 6}
        # A merge's rank: better scores first; pieces of equal score share one, and the leftmost is merged first.
        order = {s: k for k, s in enumerate(sorted({v.scores[i] for i in normal}, reverse=True))}
        self.rank = {i: order[v.scores[i]] for i in normal if len(v.pieces[i]) > 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            piece = v.pieces[i]
            if len(piece) == 1:
                self.automaton.add_word(piece, (i, 1))
            elif (parts := self.last_merge(piece)) is not None:
                self.parts[i] = parts
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.seams: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.surface = [self.bytes_of(i) for i in range(len(v.pieces))]

    def bytes_of(self, i: int) -> bytes:
        kind, piece = self.vocabulary.kinds[i], self.vocabulary.pieces[i]
        if kind == 6:
            return bytes([int(piece[3:5], 16)])
        return {1: piece.replace(MARK, " "), 2: " ⁇ ", 3: ""}[kind].encode()

    def last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two parts that were merged last into a piece, or None if its characters merge into something else."""
        parts = list(piece)
        while len(parts) > 2:
            found = [(self.rank[i], k) for k in range(len(parts) - 1) if (i := self.id_of.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return None
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (self.id_of[parts[0]], self.id_of[parts[1]]) if len(parts) == 2 else None

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the characters of both pieces gives just these two."""
        key = left << 32 | right
        known = self.seams.get(key)
        if known is None:
            if len(self.seams) > 4 * CACHE_UNITS:
                self.seams.clear()
            known = self.seams[key] = self._may_follow(left, right)
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        pieces, rank, parts = self.vocabulary.pieces, self.rank, self.parts
        # The seam's neighbours stay until a merge of this rank; "until" counts half steps: at equal
        # rank a merge on the left comes before one across the seam, and that before one on the right.
        until = NEVER
        while True:
            joined = self.id_of.get(pieces[left] + pieces[right])
            if joined is not None and 2 * rank[joined] < until:
                return False
            of_left, of_right = rank.get(left, -1), rank.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                until = 2 * of_left
                left = parts[left][1]
            else:
                until = 2 * of_right + 1
                right = parts[right][0]

    def unit(self, unit: str) -> bytes:
        """Ids of a unit, as little-endian unsigned 32-bit integers."""
        n = len(unit)
        last, length = [-1] * (n + 1), [1] * (n + 1)
        follow = self.may_follow
        for at, (piece, size) in self.automaton.iter(unit):
            end = at + 1
            if last[end] < 0:
                start = end - size
                before = last[start]
                if before < 0:
                    # At the start, or after a character that is no piece (in between, the automaton reports every character).
                    if start == 0 or unit[start - 1] not in self.id_of:
                        last[end], length[end] = piece, size
                elif follow(before, piece):
                    last[end], length[end] = piece, size
        ids: list[int] = []
        at = n
        while at > 0:
            if last[at] >= 0:
                ids.append(last[at])
                at -= length[at]
            else:
                ids += [self.byte_id[b] for b in reversed(unit[at - 1].encode())]
                at -= 1
        return np.array(ids[::-1], "<u4").tobytes()

    def units(self, texts: pa.Array) -> pa.ListArray:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, f"  |{MARK}|{CUT}|^ ")
        marked = pc.replace_substring(pc.replace_substring(texts, " ", CUT + MARK), "\n", CUT + "\n" + CUT)
        joined = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), marked, pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(joined, CUT)
        rows = np.flatnonzero(np.asarray(odd.to_numpy(zero_copy_only=False), dtype=bool)).tolist()
        empty = pc.equal(pc.binary_length(texts), 0)
        rows += np.flatnonzero(np.asarray(empty.to_numpy(zero_copy_only=False), dtype=bool)).tolist()
        if not rows:
            return lists
        out = lists.to_pylist()
        for i in rows:
            text = texts[i].as_py()
            out[i] = re.findall(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n", MARK + text.replace(" ", MARK)) if text else []
        return pa.array(out, pa.large_list(pa.large_string()))

    def encode(self, texts: pa.Array) -> Gathered:
        """The ids of each text without begin and end, as little-endian unsigned 32-bit integers."""
        units, indices, offsets = distinct_units(self.units(texts))
        if len(self.cache) > CACHE_UNITS:
            self.cache = {}
        cache, values = self.cache, []
        for unit in units:
            ids = cache.get(unit)
            if ids is None:
                ids = self.unit(unit)
                if len(unit) <= 64:
                    cache[unit] = ids
            values.append(ids)
        return gather(indices, offsets, values)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a row of ids; bytes that are no UTF-8 become U+FFFD each."""
        kinds, surface = self.vocabulary.kinds, self.surface
        ids = ids.tolist()
        k = 0
        while k < len(ids) and kinds[ids[k]] == 3:
            k += 1
        data = b"".join([surface[i] for i in ids[k:]])
        if k < len(ids) and kinds[ids[k]] == 1 and data.startswith(b" "):
            data = data[1:]  # the mark that encoding put in front
        try:
            return data.decode()
        except UnicodeDecodeError:
            return _lenient(data)


def _lenient(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no whole character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                break
            except UnicodeDecodeError:
                size = 0
        else:
            out.append("�")
        at += size or 1
    return "".join(out)


_workers: dict[int, PieceBpe] = {}


def worker_encoder(vocabulary: Vocabulary) -> PieceBpe:
    key = zlib.crc32("\0".join(vocabulary.pieces).encode())
    if key not in _workers:
        _workers[key] = PieceBpe(vocabulary)
    return _workers[key]


ROUND_TRIP = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def _round_trip(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_encoder(shared.value)
        begin, end = (np.array([i], "<u4").tobytes() for i in (bpe.vocabulary.begin, bpe.vocabulary.end))
        for batch in regroup(batches):
            got = bpe.encode(batch.column(1))
            ids = [begin + bytes(got.row(i)) + end for i in range(batch.num_rows)]
            decoded = [bpe.decode(np.frombuffer(x, "<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], schema=ROUND_TRIP)

    return run


def encode_and_decode(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of (doc_id, text).

    ``ids`` holds the ids with begin and end as little-endian unsigned 32-bit
    integers, ``decoded`` the text that they decode to. A null or empty text has
    the begin and end ids alone. Rows are independent: repeated or null doc_ids
    are kept as they are, other columns are ignored, an empty table gives an
    empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_model(model_path))
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return source.mapInArrow(_round_trip(shared), "doc_id long, ids binary, decoded string")
