"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score's pairwise part, sum over i < j of <v_i, v_j> x_i x_j, is computed in
time linear in the features by the identity
half the sum over factors of (sum v x)^2 - sum (v x)^2.

Features of a whole text: its words, hashed into ``BUCKETS`` and weighted so that
their squares add up to 1; shares of upper and lower case, digits, spaces,
newlines, non-ASCII bytes and each ASCII sign; word, line and repetition
statistics; and its length as metadata. Language, source, doc_id and labels are never features.

The model is fitted by a driver on at most ``max_rows`` labelled rows (the first
by a hash of doc_id, so the choice doesn't depend on the input's order), whose
features, not texts, reach the driver. Every row is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import regroup, whole_text
from .tokens import CACHE_UNITS, distinct_units

BUCKETS = 1 << 15
FACTORS = 8
SIGNS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
N_STATS = 14 + len(SIGNS)
FEATURES = BUCKETS + N_STATS
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.08, 2e-4
#: Rows used to fit the model at most.
TRAIN_ROWS = 6000

_buckets: dict[str, int] = {}


def _bucket(word: str) -> int:
    if len(_buckets) > CACHE_UNITS:
        _buckets.clear()
    found = _buckets.get(word)
    if found is None:
        found = _buckets[word] = zlib.crc32(word.lower().strip(".,;:!?").encode()) % BUCKETS
    return found


@dataclass
class Features:
    """Sparse words of all rows (``bounds`` gives each row's part) and dense statistics."""

    bounds: np.ndarray
    at: np.ndarray
    x: np.ndarray
    stats: np.ndarray


def _statistics(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(data, minlength=256).astype(float)
    n = max(1, len(data))
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    words, lines = max(1.0, counts[32] + counts[10]), counts[10] + 1
    head = [upper / n, lower / n, digits / n, counts[32] / n, counts[10] / n, counts[128:].sum() / n, upper / max(1.0, upper + lower), n / words, n / lines / 200, np.log1p(n), np.log1p(lines)]
    return np.concatenate([head, np.sqrt(counts[SIGNS] / words)])


def features(texts: pa.Array) -> Features:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    units, indices, offsets = distinct_units(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "))
    buckets = np.fromiter(map(_bucket, units), np.int64, len(units))
    real = np.fromiter(map(bool, units), bool, len(units))[indices] if len(units) else np.zeros(0, bool)
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))[real]
    keys, counts = np.unique(rows * BUCKETS + buckets[indices[real]], return_counts=True)
    words, rows, n = rows, keys // BUCKETS, len(texts)
    total = np.bincount(rows, weights=counts, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, rows, counts)
    following = indices[real]
    echo = (following[1:] == following[:-1]) & (words[1:] == words[:-1])
    some = np.maximum(1, total)
    # A word that follows itself, the commonest word's share, distinct words against all.
    repeats = np.stack([np.bincount(words[1:][echo], minlength=n) / some, most / some, np.bincount(rows, minlength=n) / some**0.8], axis=1)
    bounds = np.searchsorted(rows, np.arange(n + 1))
    # Squares add up to at most 1, so that frequent words don't drown the rest.
    x = np.sqrt(counts / some[rows])
    signs = np.array([_statistics(t) for t in texts.to_pylist()]).reshape(-1, N_STATS - 3)
    return Features(bounds, keys % BUCKETS, x, np.concatenate([signs, repeats], axis=1))


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) * self.scale, -6, 6)

    def parts(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logit, the sums of v x by factor, scaled statistics) of each row."""
        rows = np.repeat(np.arange(len(f.bounds) - 1), np.diff(f.bounds))
        n, dense = len(f.bounds) - 1, self.dense(f.stats)
        linear = self.bias + np.bincount(rows, self.weights[f.at] * f.x, n) + dense @ self.weights[BUCKETS:]
        sums = dense @ self.factors[BUCKETS:]
        squares = dense**2 @ (self.factors[BUCKETS:] ** 2)
        for k in range(FACTORS):
            vx = self.factors[f.at, k] * f.x
            sums[:, k] += np.bincount(rows, vx, n)
            squares[:, k] += np.bincount(rows, vx**2, n)
        return linear + 0.5 * (sums**2 - squares).sum(axis=1), sums, dense

    def score(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(f)[0], -30, 30)))


def take(f: Features, rows: np.ndarray) -> Features:
    lengths = np.diff(f.bounds)[rows]
    at = np.repeat(f.bounds[rows] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    return Features(np.concatenate(([0], np.cumsum(lengths))), f.at[at], f.x[at], f.stats[rows])


def fit(f: Features, labels: np.ndarray) -> Model:
    """Adagrad on the log loss; without labels of both kinds the score is a smoothed share of label 1."""
    rng = np.random.default_rng(7)
    n, good = len(labels), float(labels.sum())
    mean = f.stats.mean(axis=0) if n else np.zeros(N_STATS)
    spread = f.stats.std(axis=0) if n else np.zeros(N_STATS)
    model = Model(float(np.log((good + 1) / (n - good + 1))), np.zeros(FEATURES), np.zeros((FEATURES, FACTORS)), mean, np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0))
    if good in (0, n):
        return model
    model.factors = rng.normal(0, 0.02, (FEATURES, FACTORS))
    g_bias, g_weights, g_factors = 1e-8, np.full(FEATURES, 1e-4), np.full((FEATURES, FACTORS), 1e-4)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for s in range(0, n, BATCH):
            own = order[s : s + BATCH]
            part = take(f, own)
            logit, sums, dense = model.parts(part)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[own]) / len(own)
            g_bias += error.sum() ** 2
            model.bias -= RATE * error.sum() / np.sqrt(g_bias)
            rows = np.repeat(np.arange(len(own)), np.diff(part.bounds))
            at, inverse = np.unique(part.at, return_inverse=True)
            ex, ex2 = error[rows] * part.x, error[rows] * part.x**2
            grad_w = np.bincount(inverse, ex, len(at))
            grad_v = np.stack([np.bincount(inverse, ex * sums[rows, k], len(at)) for k in range(FACTORS)], axis=1) if len(at) else np.zeros((0, FACTORS))
            grad_v -= model.factors[at] * np.bincount(inverse, ex2, len(at))[:, None]
            stats_w = dense.T @ error
            stats_v = (dense * error[:, None]).T @ sums - model.factors[BUCKETS:] * (dense**2).T.dot(error)[:, None]
            where = np.concatenate([at, np.arange(BUCKETS, FEATURES)])
            for values, squares, grad in ((model.weights, g_weights, np.concatenate([grad_w, stats_w])), (model.factors, g_factors, np.concatenate([grad_v, stats_v]))):
                grad = grad + DECAY * values[where] / len(own)
                squares[where] += grad**2
                values[where] -= RATE * grad / np.sqrt(squares[where])
    return model


SPARSE_DDL = "doc_id long, label double, at binary, x binary, stats binary"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in regroup(batches):
        f = features(batch.column(2))
        cut = lambda a, t: pa.array([a[f.bounds[i] : f.bounds[i + 1]].astype(t).tobytes() for i in range(batch.num_rows)], pa.binary())  # noqa: E731, B023
        stats = pa.array([row.tobytes() for row in f.stats], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cut(f.at, "<i4"), cut(f.x, "<f8"), stats], names=["doc_id", "label", "at", "x", "stats"])


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that nothing is learnt from."""
    doc = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc.cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """Fit a model on labelled documents that are not held out.

    ``labels`` has doc_id and quality (0 or 1; other values and nulls are left
    out). Several labels of a document count as their mean; of several rows of a
    document the one whose text has the smallest hash is learnt from, so that at
    most ``max_rows`` rows of features reach the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("label"))
    # At most max_rows rows of two numbers.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted(joined.mapInArrow(_extract, SPARSE_DDL).collect(), key=lambda r: r.doc_id)
    at = [np.frombuffer(r.at, "<i4").astype(np.int64) for r in rows]
    bounds = np.concatenate(([0], np.cumsum([len(a) for a in at]))).astype(np.int64)
    none = np.zeros(0)
    f = Features(bounds, np.concatenate([*at, none.astype(np.int64)]), np.concatenate([*(np.frombuffer(r.x, "<f8") for r in rows), none]), np.array([np.frombuffer(r.stats, "<f8") for r in rows]).reshape(-1, N_STATS))
    return fit(f, np.array([r.label for r in rows]))


def _score(shared, text_at: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(batches):
            scores = shared.value.score(features(batch.column(text_at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], schema=schema)

    return run


def score_quality(documents: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """``documents`` with a column ``score`` (0 to 1, higher: quality 1 is likelier).

    A null text scores like an empty one; every row is scored, whatever its
    doc_id. A column of ``documents`` named score is replaced; other columns
    pass unchanged and have no part in the score. An empty table gives an empty
    result; without labels every score is 0.5.
    """
    model = train(documents, labels, max_rows)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = [c for c in documents.columns if c != "score"]
    out = documents.select(*names, F.lit(0.0).alias("score"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return documents.select(names).mapInArrow(_score(shared, names.index("text"), to_arrow_schema(out.schema)), ddl)
