import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cloakwork.llm import quality
from cloakwork.llm.quality import BUCKETS, FACTORS, Model, N_STATS, features, score_quality
from cloakwork.llm.queries import op7_quality

SF10 = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    good = labels == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_accuracy(spark):
    found = op7_quality(spark, SF10).toPandas()
    labels = spark.read.parquet(f"{SF10}/labels.parquet").toPandas()
    both = found.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(found) == spark.read.parquet(f"{SF10}/documents.parquet").count()
    assert ((found.predicted == 1) == (found.score >= 0.3)).all()
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.9
    assert (held.predicted == held.quality).mean() > 0.85


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    n = BUCKETS + N_STATS
    model = Model(0.1, rng.normal(size=n), rng.normal(size=(n, FACTORS)), np.zeros(N_STATS), np.ones(N_STATS))
    f = features(pa.array(["some words, some more words", "", None]))
    x = np.zeros((3, n))
    for i in range(3):
        np.add.at(x[i], f.at[f.bounds[i] : f.bounds[i + 1]], f.x[f.bounds[i] : f.bounds[i + 1]])
    x[:, BUCKETS:] = model.dense(f.stats)
    for i, logit in enumerate(model.parts(f)[0]):
        on = np.flatnonzero(x[i])
        pairs = sum(model.factors[a] @ model.factors[b] * x[i, a] * x[i, b] for k, a in enumerate(on) for b in on[:k])
        assert abs(logit - (0.1 + model.weights @ x[i] + pairs)) < 1e-6


def test_odd_rows_and_no_labels(spark, odd, clashing, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (5, None, 0), (None, 1, 0), (9, 7, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for source in (odd, clashing):
            rows = score_quality(source, labels).collect()
            assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert score_quality(empty, labels).count() == 0
    assert {r.score for r in score_quality(odd, none).collect()} == {0.5}


def test_a_labelled_doc_id_with_many_rows_counts_once(spark):
    rows = spark.range(3_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    others = spark.range(2, 60).select(F.col("id").alias("doc_id"), F.concat(F.lit("another text "), "id").alias("text"))
    labels = spark.range(1, 60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    known = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5]
    seen = []
    before, quality.fit = quality.fit, lambda f, y: seen.append(len(y)) or before(f, y)
    try:
        quality.train(rows.unionByName(others), labels)
    finally:
        quality.fit = before
    assert seen == [len(known)]
