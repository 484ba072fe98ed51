import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakwork.llm.pieces import PieceBpe, encode_and_decode, read_model
from cloakwork.llm.queries import op9_sentencepiece

from .conftest import ROWS, SF

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = PieceBpe(read_model(PATH))


def with_library(text):
    ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
    return ids, LIBRARY.decode(ids)


def test_whole_table(spark, documents):
    got = sorted(op9_sentencepiece(spark, SF).collect())
    expected = []
    for doc, text in documents:
        ids, decoded = with_library(text)
        expected.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(expected)


def test_odd_rows(odd, clashing):
    expected = sorted(((d, *with_library(t)) for d, t, _ in ROWS), key=str)
    for source in (odd, clashing):
        rows = encode_and_decode(source, PATH).collect()
        assert sorted(((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in rows), key=str) == expected


def test_empty_table(empty):
    assert encode_and_decode(empty, PATH).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abenrst \n▁.é0", max_size=80)))
def test_any_text_as_the_library(text):
    import pyarrow as pa

    ids = np.frombuffer(OWN.encode(pa.array([text])).row(0), "<u4").tolist()
    assert ids == LIBRARY.encode(text)
    assert OWN.decode(np.array([1, *ids, 2], "<u4")) == LIBRARY.decode([1, *ids, 2])
