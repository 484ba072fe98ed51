"""Main text of HTML pages by a tree-structured graphical model.

Each block of a page is a node with the label "article" or not. A node's own
potential is linear in its features (tag, words of class and id, text, links,
place); each edge of the tree has a potential for the labels of parent and
child, by the child's kind. Sum-product messages go up from the leaves and down
from the root once, which gives exact marginals on a tree. The article is the
leaves whose marginal is at least one half.

The potentials are trained by maximum likelihood, whose gradient needs the same
marginals, on labelled pages that ``html_labelled`` draws with a fixed seed;
their number is a parameter. All pages of a batch are one forest, so messages are
computed for all nodes of a depth at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import regroup, whole_text
from .html_labelled import labelled_pages
from .html_tree import N_FEATURES, N_GROUPS, Forest

TRAIN_PAGES, STEPS, RATE, DECAY = 400, 120, 0.3, 1e-4
#: HTML that is parsed into one forest.
FOREST_BYTES = 2 << 20


@dataclass
class Potentials:
    own: np.ndarray  # a weight for each feature, for label 1 against label 0
    pair: np.ndarray  # (group, parent's label, child's label)


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def marginals(parent: np.ndarray, depth: np.ndarray, group: np.ndarray, features: np.ndarray, potentials: Potentials) -> tuple[np.ndarray, np.ndarray]:
    """Each node's probability of label 1, and each edge's of its four labelings (parent, child)."""
    n = len(parent)
    below = np.zeros((n, 2))
    below[:, 1] = features @ potentials.own
    up, down = np.zeros((n, 2)), np.zeros((n, 2))
    pair = potentials.pair[group]
    levels = _levels(depth)
    for nodes in reversed(levels[1:]):
        x = pair[nodes] + below[nodes][:, None, :]
        up[nodes] = np.logaddexp(x[:, :, 0], x[:, :, 1])
        np.add.at(below, parent[nodes], up[nodes])
    joint = np.full((n, 2, 2), -np.inf)
    for nodes in levels[1:]:
        p = parent[nodes]
        rest = below[p] + down[p] - up[nodes]
        x = rest[:, :, None] + pair[nodes]
        down[nodes] = np.logaddexp(x[:, 0], x[:, 1])
        joint[nodes] = x + below[nodes][:, None, :]
    whole = below + down
    prob = 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -50, 50)))
    joint -= np.where(np.isfinite(joint), joint, -1e300).max(axis=(1, 2), keepdims=True) if n else 0
    edges = np.where(depth[:, None, None] > 0, np.exp(np.where(np.isfinite(joint), joint, -1e3)), 0.0)
    return prob, edges / np.maximum(edges.sum(axis=(1, 2), keepdims=True), 1e-300)


def labels_of(forest: Forest, parent: np.ndarray) -> np.ndarray:
    """Leaves have their own label, other nodes that of most of their text."""
    chars = np.fromiter(map(len, forest.text), np.float64, len(forest.text))
    good = chars * (np.array(forest.label) == 1)
    before = np.concatenate([np.zeros((2, 1)), np.cumsum(np.stack([chars, good]), axis=1)], axis=1)
    total, own = before[:, np.array(forest.end)] - before[:, :-1]
    return np.where(total > 0, own * 2 > total, np.array(forest.label) == 1).astype(np.int64)


@lru_cache(maxsize=4)
def train(n_pages: int = TRAIN_PAGES, seed: int = 11) -> Potentials:
    """Potentials of the greatest likelihood (with a small penalty), by Adagrad over all pages."""
    forest = Forest(labelled=True)
    for page in labelled_pages(n_pages, seed):
        forest.add_page(page)
    parent, depth, group, features = forest.arrays()
    y = labels_of(forest, parent)
    edges = np.flatnonzero(parent >= 0)
    seen = np.zeros((N_GROUPS, 2, 2))
    np.add.at(seen, (group[edges], y[parent[edges]], y[edges]), 1.0)
    potentials = Potentials(np.zeros(N_FEATURES), np.zeros((N_GROUPS, 2, 2)))
    g_own, g_pair, n = np.full(N_FEATURES, 1e-6), np.full((N_GROUPS, 2, 2), 1e-6), len(y)
    for _ in range(STEPS):
        prob, joint = marginals(parent, depth, group, features, potentials)
        grad = features.T @ (y - prob) / n - DECAY * potentials.own
        expected = np.zeros((N_GROUPS, 2, 2))
        np.add.at(expected, group[edges], joint[edges])
        grad_pair = (seen - expected) / n - DECAY * potentials.pair
        g_own += grad**2
        g_pair += grad_pair**2
        potentials.own += RATE * grad / np.sqrt(g_own)
        potentials.pair += RATE * grad_pair / np.sqrt(g_pair)
    return potentials


def main_texts(pages: list[str], potentials: Potentials) -> list[str]:
    """The main text of each page."""
    forest = Forest()
    for page in pages:
        forest.add_page(page)
    prob, _ = marginals(*forest.arrays(), potentials)
    kept: list[list[str]] = [[] for _ in pages]
    for i in np.flatnonzero(prob >= 0.5).tolist():
        if forest.text[i]:
            kept[forest.page[i]].append(forest.text[i])
    return [" ".join(blocks) for blocks in kept]


def _extract(shared, html_at: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(batches, FOREST_BYTES):
            texts = main_texts([x or "" for x in batch.column(html_at).to_pylist()], shared.value)
            columns = [c for k, c in enumerate(batch.columns) if k != html_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    return run


def extract_main_text(pages: DataFrame, n_pages: int = TRAIN_PAGES) -> DataFrame:
    """The columns of ``pages`` but html, with ``text`` (the main text) and ``n_chars`` (its code points).

    A block's white space becomes single spaces, character references are
    decoded, blocks are joined by a space in page order. A page without an
    article, a null or an empty one has an empty text. Rows are independent:
    repeated and null ids are kept. Columns named text or n_chars are replaced;
    an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train(n_pages))
    names = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    out = pages.select(*names, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    source = pages.select(*names, whole_text("html").alias("html"))
    return source.mapInArrow(_extract(shared, len(names), to_arrow_schema(out.schema)), ddl)
