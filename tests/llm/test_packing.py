import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloakwork.llm.packing import first_fit_decreasing, pack_documents
from cloakwork.llm.queries import op2_packing

from .conftest import ROWS, SF

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(texts):
    library = Tokenizer.from_file(PATH)
    return [[*x.ids, 2] for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(pieces, rows, capacity=4096):
    expected = sorted((doc, zlib.crc32(np.array(ids, "<u4").tobytes())) for (doc, _), ids in zip(rows, whole_ids([t for _, t in rows]), strict=True))
    streams, sequences = defaultdict(dict), defaultdict(list)
    for p in pieces:
        streams[p.doc_id][p.start] = p
        sequences[p.sequence_id].append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return expected, streams, sequences


def test_whole_table(spark, documents):
    pieces = op2_packing(spark, SF).collect()
    _, streams, sequences = check(pieces, documents)
    for (doc, _), ids in zip(documents, whole_ids([t for _, t in documents]), strict=True):
        at = 0
        for start in sorted(streams[doc]):
            p = streams[doc][start]
            assert start == at and p.doc_tokens == len(ids)
            assert zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    tokens = sum(p.length for p in pieces)
    assert tokens / (4096 * len(sequences)) > 0.95


def test_odd_rows_keep_every_id(odd, clashing):
    rows = [r[:2] for r in ROWS]
    for source in (odd, clashing):
        pieces = pack_documents(source, PATH).collect()
        check(pieces, [(d if d is not None else -1, t) for d, t in rows])
        assert sum(p.length for p in pieces) == sum(map(len, whole_ids([t for _, t in rows])))
        assert all(p.ids is not None and len(p.ids) == p.length for p in pieces)


def test_empty_table(empty):
    assert pack_documents(empty, PATH).count() == 0


@given(st.lists(st.integers(1, 100), max_size=60))
def test_first_fit_decreasing_against_scan(sizes):
    free, expected = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), None)
        if k is None:
            k = len(free)
            free.append(100)
        free[k] -= sizes[i]
        expected[i] = k
    bins, _ = first_fit_decreasing(sizes, 100)
    assert bins == [expected[i] for i in range(len(sizes))]


def test_equal_rows_are_spread_over_groups(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    packed = pack_documents(rows, PATH, with_ids=False)
    sizes = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert len(sizes) == 5 and max(sizes) < 6_000
