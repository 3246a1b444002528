"""Isolation forest: how few random cuts set a row apart from a sample."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tree: feature (-1 at leaves), cut, child of smaller values, other child, path length at leaves.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def expected_path(n: int) -> float:
    """The mean path of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 2:
        return float(n == 2)
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(rows: np.ndarray, rng: np.random.Generator) -> Tree:
    """A tree over ``rows``; missing values (nan) are on the side of larger ones."""
    limit = math.ceil(math.log2(max(2, len(rows))))
    nodes: list[list[float]] = [[-1, 0, 0, 0, 0]]
    todo = [(0, rows, 0)]
    while todo:
        at, part, depth = todo.pop()
        span = [(j, v.min(), v.max()) for j in range(part.shape[1]) if len(v := part[~np.isnan(part[:, j]), j]) and v.min() < v.max()]
        if depth >= limit or len(part) < 2 or not span:
            nodes[at][4] = depth + expected_path(len(part))
            continue
        j, lo, hi = span[rng.integers(len(span))]
        cut = max(rng.uniform(lo, hi), np.nextafter(lo, hi))
        less = part[:, j] < cut
        nodes[at][:4] = [j, cut, len(nodes), len(nodes) + 1]
        todo += [(len(nodes), part[less], depth + 1), (len(nodes) + 1, part[~less], depth + 1)]
        nodes += [[-1, 0, 0, 0, 0], [-1, 0, 0, 0, 0]]
    feature, cut, below, other, path = np.array(nodes, float).T
    return feature.astype(np.int64), cut, below.astype(np.int64), other.astype(np.int64), path


def path_lengths(tree: Tree, rows: np.ndarray) -> np.ndarray:
    feature, cut, below, other, path = tree
    node = np.zeros(len(rows), np.int64)
    while (inner := np.flatnonzero(feature[node] >= 0)).size:
        at = node[inner]
        node[inner] = np.where(rows[inner, feature[at]] < cut[at], below[at], other[at])
    return path[node]


def fit_forest(df: DataFrame, columns: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 1) -> tuple[list[Tree], int]:
    """Trees, and the rows of each: ``sample``, or all where there are fewer.

    The trees share a sample of at most ``trees * sample`` rows, chosen by a hash of their values; only
    these reach the driver. Nulls are missing values.
    """
    values = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    pool = df.select(*values)
    pool = pool.orderBy(F.xxhash64(*pool.columns, F.lit(seed)), *pool.columns).limit(trees * sample).toArrow()
    rows = np.column_stack([c.to_numpy().astype(float) for c in pool.columns]) if pool.num_rows else np.empty((0, len(columns)))
    rng = np.random.default_rng(seed)
    size = min(sample, len(rows))
    return [grow(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(trees if size else 0)], size


def forest_scores(rows: np.ndarray, forest: list[Tree], size: int) -> np.ndarray:
    """``2 ** (-mean path / expected path)``; 0.5 where there is nothing to compare with."""
    if size < 2:
        return np.full(len(rows), 0.5)
    return 2 ** (-sum(path_lengths(t, rows) for t in forest) / len(forest) / expected_path(size))


def isolation_forest(df: DataFrame, id_col: str, columns: Sequence[str], reference: DataFrame | None = None, trees: int = 100, sample: int = 256, seed: int = 1) -> DataFrame:
    """``id_col, score, outside`` of every row; ``reference`` (``df`` itself unless given) is what rows are compared with.

    Scores near 1 are outliers. ``outside`` counts the columns whose value is beyond the reference's range.
    Rows are scored where they are read; the trees are bounded by ``trees * sample``.
    """
    known = df if reference is None else reference
    forest, size = fit_forest(known, columns, trees, sample, seed)
    schema = f"id {df.schema[id_col].dataType.simpleString()}, outside long, score double"
    lo, hi = ({c: f(F.col(c).cast("double")) for c in columns} for f in (F.min, F.max))
    ranges = known.agg(*(x[c].alias(f"{n}{i}") for i, c in enumerate(columns) for n, x in (("lo", lo), ("hi", hi))))
    beyond = [F.coalesce(((F.col(f"v{i}") < F.col(f"lo{i}")) | (F.col(f"v{i}") > F.col(f"hi{i}"))).cast("long"), F.lit(0)) for i in range(len(columns))]
    given = df.select(F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns))).crossJoin(F.broadcast(ranges))
    given = given.select("id", sum(beyond[1:], beyond[0]).alias("outside"), *(f"v{i}" for i in range(len(columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[2:]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(forest_scores(rows, forest, size))], names=["id", "outside", "score"])

    return given.mapInArrow(run, schema).select(F.col("id").alias(id_col), "score", "outside")
