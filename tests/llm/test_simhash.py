import re

import xxhash

from cloakwork.llm.components import connected_components
from cloakwork.llm.queries import op8_simhash
from cloakwork.llm.simhash import keep_first, links, near_duplicates

from .conftest import ROWS, SF


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_force(rows):
    """Fingerprints and components over all pairs."""
    fps = [simhash(t) for _, t in rows]
    names = [d for d, _ in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (bin(fps[i] ^ fps[j]).count("1") <= 2 or rows[i][0] == rows[j][0]) and names[j] < names[i]:
                    names[i], changed = names[j], True
    return sorted(zip((d for d, _ in rows), fps, names, strict=True))


def test_whole_table(spark, documents):
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in op8_simhash(spark, SF).collect())
    assert got == brute_force(documents)


def test_odd_rows(odd, clashing):
    expected = brute_force([r[:2] for r in ROWS if r[0] is not None])
    for source in (odd, clashing):
        found = near_duplicates(source).collect()
        got = sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found if r.doc_id is not None)
        assert got == expected
        assert [r.component_id for r in found if r.doc_id is None] == [None, None]


def test_keep_first_keeps_one_of_each_group(odd):
    kept = [r.doc_id for r in keep_first(odd).collect()]
    components = {c for _, _, c in brute_force([r[:2] for r in ROWS if r[0] is not None])}
    assert sorted(d for d in kept if d is not None) == sorted(components)
    assert kept.count(None) == 2


def test_empty_table(empty):
    assert near_duplicates(empty).count() == 0
    assert keep_first(empty).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 7), (1, 2), (2, 1)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1: 1, 2: 1}


def test_links_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for flips in ((), (0,), (63,), (5, 6), (31, 32), (1, 40), (1, 2, 3), (40, 41, 50), (31, 32, 63)):
            fp = base
            for b in flips:
                fp ^= 1 << b
            fps.add(fp)
    fps = sorted(fps | {0, 1, 3, 7, (1 << 64) - 1, (1 << 64) - 2})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(fp), i) for i, fp in enumerate(fps)]
    got = {(r.u, r.v) for r in links(spark.createDataFrame(rows, "fp long, rep long")).collect()}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2}
