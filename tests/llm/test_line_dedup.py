import hashlib

import duckdb

from cloakwork.llm.line_dedup import FilterPair, dedup_lines, filter_bits, hashes, held
from cloakwork.llm.queries import ORACLE_SQL, op1_line_dedup

from .conftest import ROWS, SF
from .helpers import compare_with_sql

SPACES = " \t\n\x0b\x0c\r"


def brute_force(rows, min_chars=10):
    """What stays of each row, in order: a dict from key to its documents, then one pass."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(SPACES).translate(lower)
    where = {}
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                where.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = lambda x: doc is not None and len(key(x)) >= min_chars and min(where[key(x)]) < doc  # noqa: B023, E731
        kept = [x for x in lines if not gone(x)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_against_sql(spark):
    compare_with_sql(op1_line_dedup(spark, SF), ORACLE_SQL["op1_line_dedup"], SF)


def test_odd_rows_against_brute_force(odd, clashing):
    expected = sorted(brute_force([r[:2] for r in ROWS]), key=str)
    for source in (odd, clashing):
        found = dedup_lines(source)
        assert set(source.columns) <= set(found.columns)
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in found.select("doc_id", "n_lines", "n_dropped", "text").collect()]
        assert sorted(got, key=str) == expected


def test_untouched_null_stays_null(odd):
    assert dedup_lines(odd).where("doc_id = 3").first().text is None


def test_empty_table(empty):
    assert dedup_lines(empty).count() == 0


def test_a_line_within_one_document_only_stays(spark):
    rows = [(1, "only in this document\nonly in this document"), (2, "something else entirely")]
    found = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_dropped for r in found.collect()} == {1: 0, 2: 0}


def test_twice_filter_has_no_false_negative():
    import numpy as np
    import pyarrow as pa

    bits = filter_bits(1 << 20)
    h = hashes(pa.array([f"line number {i}" for i in range(2000)]))
    left, right = FilterPair(bits), FilterPair(bits)
    left.add(np.arange(2000), h)
    right.add(np.arange(5000, 6000), h[500:1500])
    right.merge(left.once, left.twice)
    assert held(right.twice, h[500:1500], bits).all()
    assert held(right.twice, h[:500], bits).mean() < 0.05


def test_hash_of_kept_text():
    assert hashlib.sha256(b"").hexdigest() == duckdb.sql("SELECT sha256('') AS h").df().h[0]
