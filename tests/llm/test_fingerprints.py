import hashlib
import re
from collections import Counter

from cloakwork.llm.fingerprints import PIECE, fingerprint_documents
from cloakwork.llm.queries import op5_fingerprints

from .conftest import ROWS, SF


def elements(text):
    """A text's pieces with how often they occur."""
    return Counter(re.findall(PIECE, text, re.ASCII))


def likeness(a, b):
    a, b = elements(a), elements(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def brute_force(documents):
    """By doc_id (distinct): n_chars, edited_sha256, near_edited, near_next."""
    ordered = sorted((d, t or "") for d, t in documents)
    out = {}
    for i, (d, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(text, edited), 9), round(likeness(text, after), 9))
    return out


def values(rows):
    return {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows if r.doc_id is not None}


def test_whole_table(spark, documents):
    rows = op5_fingerprints(spark, SF).collect()
    assert values(rows) == brute_force(documents)
    by_text = {}
    for r, text in ((r, dict(documents)[r.doc_id]) for r in rows):
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


def test_odd_rows(clashing):
    rows = fingerprint_documents(clashing).collect()
    assert len(rows) == len(ROWS)
    distinct = {(d, t) for d, t, _ in ROWS if d is not None}
    assert values(rows) == brute_force(distinct)
    assert all(r.fingerprint is None and r.n_chars is not None for r in rows if r.doc_id is None)


def test_lone_document_and_empty_table(spark, empty):
    one = fingerprint_documents(spark.createDataFrame([(7, "only one here")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"only one honl").hexdigest()
    assert fingerprint_documents(empty).count() == 0


def test_texts_of_few_and_of_many_pieces_are_compared_by_pieces(spark):
    """Six lines become five in the edited form, and the next document has three: three lines are held by all."""
    long, short = "\n".join(["first line", "second line", "third line", "fourth line of it", "5", "6"]), "first line\nsecond line\nthird line"
    rows = {r.doc_id: r for r in fingerprint_documents(spark.createDataFrame([(1, long), (2, short)], "doc_id long, text string")).collect()}
    n = len(long) // 4
    edited = set((long[: len(long) - n] + short[:n]).split("\n"))
    lines = set(long.split("\n"))
    assert len(lines) == 6 and len(edited) < 6
    assert rows[1].near_edited == len(lines & edited) / len(lines | edited) >= 3 / 8
    assert rows[1].near_next == rows[2].near_next == 3 / 6
