"""Token counts of fields and sections, from one encoding of each whole document.

Encoding a section on its own gives other tokens than encoding the document
that holds it. Here a document is encoded once, each token gets its span of
code points, and an interval join (binary search over the sorted section
bounds) gives each token to a section. A token that crosses a boundary goes by
an explicit rule:

* ``start``: the section of its first character;
* ``majority``: the section of most of its characters, the earlier of two equal ones;
* ``fraction``: to each section the share of its characters there.

A token that holds part of a character's bytes counts at that character.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import regroup, whole_text
from .tokens import CACHE_UNITS, distinct_units, gather

RULES = ("start", "majority", "fraction")
CUT = "\x01"


class ByteBpe:
    """A byte-level BPE from a rank file, giving ids with spans of code points."""

    def __init__(self, spec: bytes, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, spec.splitlines())}
        self.pattern = regex.compile(pattern)
        self.merge = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.cache: dict[str, bytes] = {}

    def unit(self, unit: str) -> bytes:
        """Rows of (id, first code point, code point after the last), relative to the unit."""
        ids: list[int] = []
        for piece in self.pattern.findall(unit):
            ids += self.merge(piece.encode())
        found = np.empty((len(ids), 3), np.int64)
        found[:, 0] = ids
        ends = np.cumsum(self.size[found[:, 0]])
        if unit.isascii():
            found[:, 1], found[:, 2] = np.concatenate(([0], ends[:-1])), ends
        else:
            data = np.frombuffer(unit.encode(), np.uint8)
            char_of = np.cumsum((data & 0xC0) != 0x80) - 1
            found[:, 1], found[:, 2] = char_of[np.concatenate(([0], ends[:-1]))], char_of[ends - 1] + 1
        return found.tobytes()

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """For each text the rows (id, start, end) of its tokens."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # Only single spaces and newlines between other characters are safe places to cut.
        odd = pc.match_substring_regex(texts, rf"\s\s|[^\S \n]|{CUT}|[\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]|\s$")
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", CUT + " "), "\n", CUT + "\n" + CUT), CUT)
        rows = np.flatnonzero(np.asarray(odd.to_numpy(zero_copy_only=False), dtype=bool)).tolist()
        if rows:
            listed = lists.to_pylist()
            for i in rows:
                listed[i] = [texts[i].as_py()]
            lists = pa.array(listed, pa.large_list(pa.large_string()))
        units, indices, offsets = distinct_units(lists)
        if len(self.cache) > CACHE_UNITS // 2:
            self.cache = {}
        values, chars = [], np.fromiter(map(len, units), np.int64, len(units))
        for unit in units:
            rows_of = self.cache.get(unit)
            if rows_of is None:
                rows_of = self.unit(unit)
                if len(unit) <= 64:
                    self.cache[unit] = rows_of
            values.append(rows_of)
        got = gather(indices, offsets, values)
        tokens = np.fromiter((len(x) // 24 for x in values), np.int64, len(values))[indices]
        before = chars[indices]
        for i in range(len(texts)):
            a, b = offsets[i], offsets[i + 1]
            found = np.frombuffer(got.row(i), np.int64).reshape(-1, 3).copy()
            base = np.repeat(np.concatenate(([0], np.cumsum(before[a:b])[:-1])) if b > a else np.zeros(0, np.int64), tokens[a:b])
            found[:, 1:] += base[:, None]
            yield found


def attribute(tokens: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; section k holds the code points from bounds[k] up to bounds[k + 1]."""
    sections = len(bounds) - 1
    first = np.clip(np.searchsorted(bounds, tokens[:, 1], "right") - 1, 0, sections - 1)
    last = np.clip(np.searchsorted(bounds, tokens[:, 2] - 1, "right") - 1, 0, sections - 1)
    counts = np.bincount(first[first == last], minlength=sections).astype(float)
    if rule == "start":
        return counts + np.bincount(first[first != last], minlength=sections)
    for k in np.flatnonzero(first != last).tolist():  # tokens that cross a boundary
        _, start, end = tokens[k].tolist()
        own = np.arange(first[k], last[k] + 1)
        share = np.minimum(bounds[own + 1], end) - np.maximum(bounds[own], start)
        if rule == "fraction":
            counts[own] += share / (end - start)
        else:
            counts[own[np.argmax(share)]] += 1
    return counts


def line_bounds(text: str) -> np.ndarray:
    """Bounds of a text's lines, each with its newline."""
    ends = np.cumsum(np.fromiter(map(len, text.split("\n")), np.int64) + 1)
    ends[-1] -= 1
    return np.concatenate(([0], ends))


_workers: dict[int, ByteBpe] = {}
COUNTS = pa.schema([("doc_id", pa.int64()), ("section", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64()), ("doc_tokens", pa.int64())])
COUNTS_DDL = "doc_id long, section long, start long, end long, n_tokens double, doc_tokens long"


def _count(shared, pattern: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(shared.value)
        if key not in _workers:
            _workers[key] = ByteBpe(shared.value, pattern)
        for batch in regroup(batches):
            columns: list[list[np.ndarray]] = [[] for _ in range(4)]
            lengths, totals = [], []
            for tokens, text, cut in zip(_workers[key].encode(batch.column(1)), batch.column(1), batch.column(2), strict=True):
                bounds = np.asarray(cut.values, dtype=np.int64) if cut.is_valid else line_bounds(text.as_py())
                if len(bounds) < 2:
                    bounds = np.array([0, len(text.as_py())])
                for column, x in zip(columns, (np.arange(len(bounds) - 1), bounds[:-1], bounds[1:], attribute(tokens, bounds, rule)), strict=True):
                    column.append(x)
                lengths.append(len(bounds) - 1)
                totals.append(len(tokens))
            docs = batch.column(0).take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))
            flat = [pa.array(np.concatenate(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([docs, *flat, pa.array(np.repeat(np.array(totals, np.int64), lengths))], schema=COUNTS)

    return run


def token_counts(documents: DataFrame, ranks_path: str, pattern: str, rule: str = "majority", bounds: str | None = None) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, doc_tokens) for each section of each document.

    ``bounds`` is a SQL expression over ``documents`` giving a text's section
    bounds as an ascending array of code points from 0 to its length; by default
    a section is a line with its newline. Sections may be empty. A null or empty
    text is one empty section of no tokens. A null array of bounds, or one of fewer
    than two, counts as one whole section; null bounds are left out. Rows are independent: repeated and null doc_ids are kept,
    other columns are ignored, an empty table gives an empty result. With the
    rules ``start`` and ``majority`` counts are whole numbers; a document's
    counts always add up to ``doc_tokens``.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(ranks_path, "rb") as file:  # on the driver; under a MB, broadcast to the workers
        shared = documents.sparkSession.sparkContext.broadcast(file.read())
    whole = F.array(F.lit(0), F.length(whole_text()))
    cuts = F.lit(None).cast("array<long>") if bounds is None else F.array_compact(F.coalesce(F.expr(bounds), whole).cast("array<long>"))
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), cuts.alias("bounds"))
    return source.mapInArrow(_count(shared, pattern, rule), COUNTS_DDL)
