"""Exact top-k search by inner product, a block at a time.

Vectors become integers. A component of a vector is a term of it; ranges of
vectors form blocks, each with a forward index (its dense matrix) and the
largest and smallest weight of each term. For a query, the sum over its terms
of the most that a block's weights can add is a bound of the block's scores.
Blocks are taken in descending order of that bound, and a query is done once
the next bound falls below its k-th best score so far.

Vectors are dealt into cells of bounded size, queries into chunks of bounded
size; each task gets one cell and one chunk, and a query's best of each cell
are merged at the end. Nothing is broadcast and no task grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
BLOCK = 256
CELL, CHUNK = 8192, 4096


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, weights = [], []
        for i, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if vector.is_valid and vector.values.null_count == 0:
                x = np.asarray(vector.values, dtype=np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    weights.append(np.floor(SCALE * x).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(weights, pa.binary())], names=["vec_id", "weights"])


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    """Rows of weights; a shorter vector has zeros at its end."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        x = np.frombuffer(row, "<i8")
        out[i, : len(x)] = x
    return out


def exact(a: np.ndarray) -> bool:
    """Whether double precision holds every partial sum of two such rows' products."""
    return not a.size or float(np.abs(a).max()) ** 2 * a.shape[1] < 2.0**53


def best_of_cell(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) rows of each query's k best of a cell, without itself."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    if not (exact(queries) and exact(vectors)):
        queries, vectors = queries.astype(np.int64).astype(object), vectors.astype(np.int64).astype(object)
    starts = np.arange(0, len(ids), BLOCK)
    most, least = (np.array([f(vectors[s : s + BLOCK], axis=0) for s in starts]) for f in (np.max, np.min))
    positive = np.maximum(queries, 0)
    bounds = positive @ most.T + (queries - positive) @ least.T
    turns = np.argsort(-bounds, axis=1, kind="stable")
    low = np.iinfo(np.int64).min
    top_score, top_id = np.full((len(queries), k), low), np.full((len(queries), k), np.iinfo(np.int64).max)
    live = np.arange(len(queries))
    for turn in range(len(starts)):
        block = turns[live, turn]
        # A block whose bound equals the k-th score may still hold an equal score of a smaller id.
        go = (bounds[live, block] >= top_score[live, -1]).astype(bool)
        live, block = live[go], block[go]
        if not len(live):
            break
        for b in np.unique(block).tolist():
            own = live[block == b]
            at = slice(starts[b], starts[b] + BLOCK)
            scores = (queries[own] @ vectors[at].T).astype(np.int64)
            same = query_ids[own][:, None] == ids[at][None, :]
            scores[same] = low
            names = np.where(same, np.iinfo(np.int64).max, ids[at][None, :])
            score, name = np.concatenate([top_score[own], scores], axis=1), np.concatenate([top_id[own], names], axis=1)
            rank = _rank(score, name)[:, :k]
            top_score[own], top_id[own] = np.take_along_axis(score, rank, 1), np.take_along_axis(name, rank, 1)
    found = top_score > low
    return np.broadcast_to(query_ids[:, None], found.shape)[found], top_id[found], top_score[found]


def _rank(score: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Descending by score, ascending by name; the lowest number has no negative."""
    return np.lexsort((name, -np.maximum(score, np.iinfo(np.int64).min + 1)), axis=1)


def _cell(k: int):
    def run(left, right):
        queries, vectors = left, right
        rows, others = queries.column("weights").to_pylist(), vectors.column("weights").to_pylist()
        found = ([], [], [])
        if rows and others:
            width = max(map(len, rows + others)) // 8
            found = best_of_cell(queries.column("vec_id").to_numpy(), matrix(rows, width), vectors.column("vec_id").to_numpy(), matrix(others, width), k)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: str, k: int = 5, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best other rows by integer inner product.

    ``vectors`` has vec_id and an array ``column``; each component x becomes
    floor(256 x), x as a double. ``is_query`` is a SQL condition that selects
    the queries; they are compared with all rows but those of their own vec_id.
    Equal scores go by the smaller vec_id; fewer rows than ``k`` give as many.
    Vectors that are null or hold null or non-finite components take no part,
    nor do rows without a vec_id; a vector without components scores 0. A
    shorter vector counts as filled up with zeros. Rows that share a vec_id are
    candidates each; as queries one of them (the smallest by its weights)
    stands for all. Other columns are ignored, an empty table gives an empty
    result. Scores must fit 64 bits.
    """
    source = vectors.where(F.col("vec_id").isNotNull())
    ddl = "vec_id long, weights binary"
    rows = source.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding")).mapInArrow(_quantised, ddl)
    asked = source.where(is_query).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding")).mapInArrow(_quantised, ddl)
    asked = asked.groupBy("vec_id").agg(F.min("weights").alias("weights"))
    total = vectors.count()
    cells, chunks = max(1, -(-total // CELL)), max(1, -(-source.where(is_query).count() // CHUNK))
    # Runs of ids share a block if they are dealt together: cells are hashes of short ranges of ids.
    cell = F.pmod(F.xxhash64(F.shiftright("vec_id", 8)), F.lit(cells))
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    stored = rows.select("vec_id", "weights", cell.alias("cell"), each(chunks).alias("chunk"))
    probes = asked.select("vec_id", "weights", chunk.alias("chunk"), each(cells).alias("cell"))
    best = probes.groupBy("cell", "chunk").cogroup(stored.groupBy("cell", "chunk")).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
