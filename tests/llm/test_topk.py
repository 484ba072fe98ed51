import math

import numpy as np

from cloakwork.llm.queries import ORACLE_SQL, op10_topk
from cloakwork.llm.topk import top_k

from .conftest import SF
from .helpers import compare_with_sql


def test_against_sql(spark):
    compare_with_sql(op10_topk(spark, SF), ORACLE_SQL["op10_topk"], SF)


def brute_force(rows, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    asked = {}
    for i, v in whole:
        if i % 50 == 0 and (i not in asked or np.array(v, "<i8").tobytes() < np.array(asked[i], "<i8").tobytes()):
            asked[i] = v
    out = []
    for i, q in asked.items():
        best = sorted((-score(q, v), j) for j, v in whole if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 37) % 11 - 5) / 10, ((i * 13) % 7 - 3) / 9, 0.25]) for i in range(120)]
    rows += [(150, None), (200, [0.1, None, 0.2]), (250, [nan, 0.0, 0.0]), (300, [inf, 0.0, 1.0]), (350, []), (400, [0.5]), (None, [1.0, 1.0, 1.0])]
    rows += [(7, [0.9, 0.9, 0.9]), (50, [0.2, 0.2, 0.2]), (1000, [1e6, -1e6, 1e6])]
    source = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, weights string")
    got = sorted(map(tuple, top_k(source, "vec_id % 50 = 0").collect()))
    assert got == brute_force(rows, 5)


def test_few_and_no_rows(spark):
    ddl = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(0, [1.0, 2.0])], ddl)
    assert top_k(one, "vec_id % 50 = 0").count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, -1.0])], ddl)
    assert [tuple(r) for r in top_k(two, "vec_id % 50 = 0").collect()] == [(0, 1, 1, 65536 - 131072)]
    assert top_k(spark.createDataFrame([], ddl), "vec_id % 50 = 0").count() == 0
