"""Neighbour expansion around seeds, generation by generation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pestle.operators.similarity import block_product, saved, tanimoto_distances


def neighbours_found(frontier: DataFrame, pool: DataFrame, radius: float) -> DataFrame:
    """``id, times_found, parent, distance``: rows of ``pool`` within ``radius`` of ``frontier``, with the nearest
    of those (ties: the smaller id). Blocks are compared in memory; each gives at most one row for a row of ``pool``."""

    def run(a_ids, a_fps, b_ids, b_fps):
        order = np.argsort(a_ids, kind="stable")
        a_ids, a_fps = a_ids[order], a_fps[order]
        out = []
        for at in range(0, len(b_ids), 256):
            d = tanimoto_distances(b_fps[at : at + 256], a_fps)
            d[(d > radius + 1e-12) | (b_ids[at : at + 256, None] == a_ids[None, :])] = np.inf
            n, k = np.isfinite(d).sum(axis=1), d.argmin(axis=1)
            hit = np.flatnonzero(n)
            out.append((b_ids[at + hit], n[hit], a_ids[k[hit]], d[hit, k[hit]]))
        return pa.table(dict(zip(("id", "n", "parent", "distance"), map(np.concatenate, zip(*out)))))

    met = block_product(frontier, pool, run, "id long, n long, parent long, distance double")
    best = met.groupBy("id").agg(F.sum("n").alias("times_found"), F.min(F.struct("distance", "parent")).alias("m"))
    return best.select("id", "times_found", F.col("m.parent").alias("parent"), F.col("m.distance").alias("distance"))


def iterative_expansion(seeds: DataFrame, haystack: DataFrame, radii: Sequence[float], id_col: str = "id", fp_col: str = "fp") -> DataFrame:
    """``id, generation, times_found, ancestor, parent, distance`` of what is found around ``seeds``.

    Generation 1 are the rows of ``haystack`` within ``radii[0]`` of a seed, generation i + 1 those not found
    before within ``radii[i]`` of one of generation i. ``parent`` is the nearest item of the generation
    before (ties: the smaller id), ``ancestor`` the seed it comes from. Seeds are never found. Ids are
    distinct; there is one pass for each radius, over what is not found yet.
    """
    take = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(fp_col).alias("fp"))
    frontier = take(seeds).withColumn("ancestor", F.col("id"))
    pool = take(haystack).join(frontier.select("id"), "id", "left_anti")
    out = None
    for i, radius in enumerate(radii, 1):
        found = neighbours_found(frontier, pool, radius)
        found = saved(found.join(frontier.select(F.col("id").alias("parent"), "ancestor"), "parent").withColumn("generation", F.lit(i).cast("long")))
        frontier = saved(pool.join(found.select("id", "ancestor"), "id"))
        pool = saved(pool.join(found.select("id"), "id", "left_anti"))
        out = found if out is None else out.unionByName(found)
    return out.select("id", "generation", "times_found", "ancestor", "parent", "distance")
