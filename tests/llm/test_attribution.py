import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cloakwork.llm.attribution import token_counts
from cloakwork.llm.queries import op4_token_attribution

from .conftest import ROWS, SF

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def spans_of(encoding, text):
    """Code points of each token, from its bytes alone."""
    char_of, data = [], text.encode()
    at = -1
    for byte in data:
        at += (byte & 0xC0) != 0x80
        char_of.append(at)
    out, done = [], 0
    for i in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(i))
        out.append((char_of[done], char_of[done + size - 1] + 1))
        done += size
    return out


def brute_force(encoding, text, rule):
    text, bounds, at = text or "", [], 0
    for line in text.split("\n"):
        bounds.append((at, min(len(text), at + len(line) + 1)))
        at += len(line) + 1
    counts = [0.0] * len(bounds)
    for start, end in spans_of(encoding, text):
        shares = [max(0, min(end, b) - max(start, a)) for a, b in bounds]
        if rule == "fraction":
            for k, s in enumerate(shares):
                counts[k] += s / (end - start)
        elif rule == "majority":
            counts[shares.index(max(shares))] += 1
        else:
            counts[next(k for k, (a, b) in enumerate(bounds) if a <= start < b)] += 1
    return [(k, *bounds[k], round(counts[k], 6)) for k in range(len(bounds))]


def test_whole_table(spark, documents):
    encoding, got = library(), {}
    for r in op4_token_attribution(spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, float(r.n_tokens)))
    for doc, text in documents:
        assert sorted(got[doc]) == brute_force(encoding, text, "majority")


@pytest.mark.parametrize("rule", ["start", "majority", "fraction"])
def test_odd_rows(clashing, rule):
    encoding = library()
    expected = sorted(((d, *x) for d, t, _ in ROWS for x in brute_force(encoding, t, rule)), key=str)
    found = token_counts(clashing, PATH, public_tokenizers.PATTERN, rule).collect()
    assert sorted(((r.doc_id, r.section, r.start, r.end, round(r.n_tokens, 6)) for r in found), key=str) == expected


def test_own_bounds_and_empty_table(odd, empty):
    found = token_counts(odd, PATH, public_tokenizers.PATTERN, "fraction", "array(0, length(text) div 3, length(text))")
    off = found.groupBy("doc_id").agg((F.sum("n_tokens") - F.first("doc_tokens")).alias("d"), F.count("*").alias("n"))
    assert off.where("doc_id not in (4, 5) and abs(d) > 1e-6").count() == 0
    assert token_counts(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_unknown_rule(odd):
    with pytest.raises(ValueError):
        token_counts(odd, PATH, public_tokenizers.PATTERN, "nearest")


def test_bounds_without_elements_or_with_nulls(odd):
    for bounds in ("array()", "array(0)", "array(0, null, length(coalesce(text, '')))"):
        rows = token_counts(odd, PATH, public_tokenizers.PATTERN, bounds=bounds).collect()
        assert len(rows) == odd.count() and all(r.n_tokens == r.doc_tokens for r in rows)
