"""Splits and selections of item tables that depend on groups, order or distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pestle.operators.tables import hash_split


def cluster_split(df: DataFrame, cluster: str, percent: int, seed: int = 0) -> DataFrame:
    """All members of a cluster on one side: the split is by the cluster's hash, without a shuffle."""
    return hash_split(df, cluster, percent, seed)


def chronological_split(df: DataFrame, order: str, percent: float) -> DataFrame:
    """The first ``percent`` of the rows in order are ``train``; one approximate quantile, no global sort."""
    cut = df.agg(F.percentile_approx(order, percent / 100, 100_000).alias("__cut"))
    return df.crossJoin(F.broadcast(cut)).select(*df.columns, F.when(F.col(order) <= F.col("__cut"), "train").otherwise("test").alias("split"))


def limit_neighbours(neighbours: DataFrame, k: int | None = None, below: float | None = None, least: int | None = None) -> DataFrame:
    """Neighbour lists cut to ``k`` and to distances ``below``; lists shorter than ``least`` are left out."""
    out = neighbours
    if below is not None:
        out = out.filter(F.col("distance") < below)
    if k is not None:
        out = out.filter(F.col("rank") <= k)
    if least is not None:
        enough = out.groupBy("needle").agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select("needle")
        out = out.join(enough, "needle", "left_semi")
    return out


def wide_neighbours(neighbours: DataFrame, k: int) -> DataFrame:
    """One row for each needle with columns ``id_1, d_1 ... id_k, d_k``, in one aggregation."""
    cells = [F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"{n}_{i}") for i in range(1, k + 1) for c, n in (("neighbour", "id"), ("distance", "d"))]
    return neighbours.groupBy("needle").agg(*cells)


def distance_activity(pairs: DataFrame, activity: DataFrame, value: str, width: float, id_col: str = "id") -> DataFrame:
    """``bucket, n, mean``: mean absolute activity difference by distance, for pairs ``a, b, distance``."""
    side = lambda x: activity.select(F.col(id_col).alias(x), F.col(value).cast("double").alias(f"v_{x}"))
    d = pairs.join(side("a"), "a").join(side("b"), "b")
    return d.groupBy(F.floor(F.col("distance") / width + 1e-9).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("v_a") - F.col("v_b"))).alias("mean"))


def top_by_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


def compare_ratings(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Paired t statistic of two columns by group: ``n, mean, t``."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    out = df.groupBy(by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("__sd"))
    return out.select(by, "n", "mean", F.try_divide("mean", F.col("__sd") / F.sqrt("n")).alias("t"))
