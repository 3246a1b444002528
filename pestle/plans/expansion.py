"""Queries of neighbour expansion, overlapping buckets and outlier scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pestle.operators import anomaly, expansion
from pestle.operators import tables as t
from pestle.plans.fingerprints import FP, TANIMOTO, fingerprints
from pestle.registry import query, table

RADII = (0.45, 0.5, 0.4, 0.5)


def _generations() -> str:
    """A chain of common table expressions, one for each radius."""
    steps, names = [], ["g0"]
    for i, r in enumerate(RADII, 1):
        seen = " UNION ALL ".join(f"SELECT id FROM {n}" for n in names)
        steps.append(f"""g{i} AS MATERIALIZED (SELECT b AS id, {i}::BIGINT AS generation, count(*) OVER (PARTITION BY b) AS times_found, ancestor, a AS parent, d AS distance
FROM near JOIN g{i - 1} ON a = g{i - 1}.id WHERE d <= {r} AND b NOT IN ({seen}) QUALIFY row_number() OVER (PARTITION BY b ORDER BY d, a) = 1)""")
        names.append(f"g{i}")
    found = " UNION ALL ".join(f"SELECT id, generation, times_found, ancestor, parent, round(distance, 6) AS distance FROM {n}" for n in names[1:])
    return f"WITH near AS MATERIALIZED (SELECT a, b, d FROM {TANIMOTO} WHERE d <= {max(RADII)}), g0 AS (SELECT id, id AS ancestor FROM {FP} WHERE id % 25 = 0), {', '.join(steps)} {found}"


@query("c_iterative_expansion", _generations())
def c_iterative_expansion(spark, sf):
    f = fingerprints(spark, sf)
    return expansion.iterative_expansion(f.filter("id % 25 = 0"), f, RADII).withColumn("distance", F.round("distance", 6))


@query("a_overlapping_distribution", "SELECT bucket, count(*) AS n FROM (SELECT unnest(range(floor((l_extendedprice - 12000.0) / 5000.0)::BIGINT + 1, floor(l_extendedprice / 5000.0)::BIGINT + 1)) AS bucket FROM lineitem) GROUP BY 1")
def a_overlapping_distribution(spark, sf):
    return t.overlapping_distribution(table(spark, sf, "lineitem"), "l_extendedprice", 5000.0, 12000.0)


@query("a_isolation_forest")
def a_isolation_forest(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("line", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return anomaly.isolation_forest(lines, "line", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
