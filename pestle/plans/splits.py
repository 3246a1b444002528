"""Queries of splits and neighbour-list post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from pestle.operators import similarity as s
from pestle.operators import splits
from pestle.plans.fingerprints import TANIMOTO, fingerprints
from pestle.registry import query, table


@query("a_cluster_split", "SELECT c_custkey, c_nationkey, CASE WHEN CAST('0x' || substr(md5('5:' || c_nationkey), 1, 8) AS BIGINT) % 100 < 70 THEN 'train' ELSE 'test' END AS split FROM customer")
def a_cluster_split(spark, sf):
    return splits.cluster_split(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 70, seed=5)


@query("a_paired_t", "SELECT l_returnflag, count(*) AS n, round(avg(l_discount - l_tax), 9) AS mean, round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) AS t FROM lineitem GROUP BY 1")
def a_paired_t(spark, sf):
    out = splits.compare_ratings(table(spark, sf, "lineitem"), "l_discount", "l_tax", "l_returnflag")
    return out.select("l_returnflag", "n", F.round("mean", 9).alias("mean"), F.round("t", 6).alias("t"))


@query("c_wide_neighbours", f"WITH n AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM {TANIMOTO}) SELECT a AS needle, max(b) FILTER (r = 1) AS id_1, round(max(d) FILTER (r = 1), 6) AS d_1, max(b) FILTER (r = 2) AS id_2, round(max(d) FILTER (r = 2), 6) AS d_2 FROM n WHERE r <= 2 GROUP BY a")
def c_wide_neighbours(spark, sf):
    f = fingerprints(spark, sf)
    out = splits.wide_neighbours(s.nearest(f, f, 2), 2)
    return out.select("needle", "id_1", F.round("d_1", 6).alias("d_1"), "id_2", F.round("d_2", 6).alias("d_2"))


@query("c_distance_activity", f"SELECT CAST(floor(d / 0.1 + 1e-9) AS BIGINT) AS bucket, count(*) AS n, round(avg(abs(la - lb)), 6) AS mean FROM {TANIMOTO} WHERE a < b AND d <= 0.5 GROUP BY 1")
def c_distance_activity(spark, sf):
    f = fingerprints(spark, sf)
    return splits.distance_activity(s.close_pairs(f, 0.5), f, "label", 0.1).withColumn("mean", F.round("mean", 6))
