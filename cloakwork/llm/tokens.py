"""Tokenizer front ends over Arrow columns.

Texts are cut into units that tokens never cross (words with their space), each
distinct unit of a batch is encoded once, and ids are gathered per row with an
Arrow ``take``. Units stay in a bounded cache in each Python worker.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's cache; it is emptied beyond that.
CACHE_UNITS = 600_000


@dataclass
class Gathered:
    """Concatenated values of each row: row i has ``data[bounds[i] : bounds[i + 1]]``."""

    data: memoryview
    bounds: np.ndarray

    def row(self, i: int) -> memoryview:
        return self.data[self.bounds[i] : self.bounds[i + 1]]


def gather(indices: np.ndarray, row_offsets: np.ndarray, values: list[bytes]) -> Gathered:
    """Concatenate ``values[k]`` over each row's indices."""
    taken = pa.array(values, pa.large_binary()).take(pa.array(indices))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    data = taken.buffers()[2]
    return Gathered(memoryview(data) if data is not None else memoryview(b""), offsets[row_offsets])


def distinct_units(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct values of a list column, each value's index among them, and the rows' offsets."""
    coded = lists.flatten().dictionary_encode()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    return coded.dictionary.to_pylist(), np.asarray(coded.indices), offsets - offsets[0]


_BASE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_of() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies."""
    rest = [b for b in range(256) if b not in set(_BASE)]
    return {chr(b): b for b in _BASE} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """A lower-casing BPE with word ends, from a ``tokenizers`` JSON file.

    Plain chunks (characters below U+0180) are merged by tiktoken's core over
    the same merges: a word end is a byte 0xFF, which UTF-8 never holds. All
    other chunks go through the ``tokenizers`` library itself, as do those that
    may hold a special token.
    """

    END = b"\xff"
    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)

    def __init__(self, spec: bytes):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        text = spec.decode("utf-8")
        self.library = Tokenizer.from_str(text)
        model = json.loads(text)["model"]
        byte_of, added = _byte_of(), {x["content"] for x in json.loads(text)["added_tokens"]}
        ids = {}
        for token, i in model["vocab"].items():
            if token not in added:
                end = token.endswith("</w>") and len(token) > 4
                ids[bytes(byte_of[c] for c in (token[:-4] if end else token)) + (self.END if end else b"")] = i
        ranks = {bytes([b]): b for b in range(256)}
        for token, _ in sorted(ids.items(), key=lambda x: (len(x[0]) > 2 or not x[0].endswith(self.END), x[1])):
            ranks.setdefault(token, len(ranks))
        self.id_of = [-1] * len(ranks)
        for token, rank in ranks.items():
            self.id_of[rank] = ids.get(token, -1)
        self.merge = tiktoken.Encoding("word", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.wide = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.cache: dict[str, bytes] = {"": b""}

    def chunk(self, chunk: str) -> bytes:
        """Ids of a text without spaces, as little-endian unsigned 32-bit integers."""
        if "<|" in chunk:
            ids = self.library.encode(chunk, add_special_tokens=False).ids
        elif chunk.isascii():
            lower = chunk.lower()
            ids = self.pieces((lower,) if lower.isalpha() else self.ASCII.findall(lower))
        elif max(chunk) < "ƀ":
            ids = self.pieces(self.wide.findall("".join([c.lower() for c in chunk])))
        else:
            ids = self.library.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def pieces(self, pieces) -> list[int]:
        id_of, merge, out = self.id_of, self.merge, []
        for piece in pieces:
            out += [id_of[k] for k in merge(piece.encode() + self.END)]
        return out

    def encode(self, texts: pa.Array) -> Gathered:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        flat = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        units, indices, offsets = distinct_units(pc.split_pattern(flat, " "))
        if len(self.cache) > CACHE_UNITS:
            self.cache = {"": b""}
        cache, values = self.cache, []
        for unit in units:
            ids = cache.get(unit)
            if ids is None:
                ids = self.chunk(unit)
                if len(unit) <= 64:
                    cache[unit] = ids
            values.append(ids)
        return gather(indices, offsets, values)
