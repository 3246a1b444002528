"""Queries of the similarity operators: the sign bits of ``embeddings`` are the fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from pestle.functions.metrics import dense, pack_signs, sparse
from pestle.operators import similarity as s
from pestle.registry import query, table

BITS = 64
FP = "(SELECT vec_id AS id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS f FROM embeddings)"
PAIR = f"(SELECT a.id AS a, b.id AS b, list_sum(list_transform(list_zip(a.f, b.f), lambda z: z[1] * z[2])) AS c, list_sum(a.f) AS na, list_sum(b.f) AS nb, a.label AS la, b.label AS lb FROM {FP} a, {FP} b WHERE a.id <> b.id)"
TANIMOTO = f"(SELECT a, b, la, lb, CASE WHEN na + nb = 0 THEN 0.0 ELSE 1 - c / (na + nb - c) END AS d FROM {PAIR})"


def fingerprints(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("id"), pack_signs(F.col("embedding"), BITS).alias("fp"), "label")


def _six(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("c_nearest", f"SELECT a AS needle, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank, b AS neighbour, round(d, 6) AS distance FROM {TANIMOTO} QUALIFY rank <= 5")
def c_nearest(spark, sf):
    f = fingerprints(spark, sf)
    out = s.nearest(f, f, 5)
    return _six(out.withColumn("rank", F.col("rank").cast("long")), "distance")


@query("c_knn_predict", f"WITH n AS (SELECT a, lb FROM {TANIMOTO} QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 5), v AS (SELECT a, lb, count(*) AS votes FROM n GROUP BY ALL) SELECT a AS needle, lb AS label, votes FROM v QUALIFY row_number() OVER (PARTITION BY a ORDER BY votes DESC, lb) = 1")
def c_knn_predict(spark, sf):
    f = fingerprints(spark, sf)
    return s.predict_by_neighbours(s.nearest(f, f, 5), f, "label")


@query("c_close_pairs", f"SELECT a, b, round(d, 6) AS distance FROM {TANIMOTO} WHERE a < b AND d <= 0.45")
def c_close_pairs(spark, sf):
    return _six(s.close_pairs(fingerprints(spark, sf), 0.45), "distance")


@query("c_distance_filter", f"SELECT a.id FROM {FP} a WHERE a.id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM {TANIMOTO} t WHERE t.a = a.id AND t.b % 2 = 0 AND t.d < 0.5)")
def c_distance_filter(spark, sf):
    f = fingerprints(spark, sf)
    return s.distance_filter(f.filter("id % 2 = 1"), f.filter("id % 2 = 0"), 0.5).select("id")


@query("c_histogram", f"SELECT CAST(floor(d / 0.05 + 1e-9) AS BIGINT) AS bucket, count(*) AS n FROM {TANIMOTO} WHERE a < b GROUP BY 1")
def c_histogram(spark, sf):
    return s.distance_histogram(fingerprints(spark, sf), 0.05)


@query("c_incremental_diversity", f"SELECT a AS id, b AS neighbour, round(d, 6) AS distance FROM {TANIMOTO} WHERE b < a QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1")
def c_incremental_diversity(spark, sf):
    return _six(s.incremental_diversity(fingerprints(spark, sf)), "distance")


_METRICS = {
    "tversky": "CASE WHEN na + nb = 0 THEN 1.0 ELSE coalesce(c / nullif(0.7 * (na - c) + 0.3 * (nb - c) + c, 0), 0) END",
    "russel_rao": "c / 64.0",
    "forbes": "coalesce(c / nullif(na * nb, 0)::DOUBLE, 0)",
    "simple_matching": "(c + 64 - na - nb + c) / 64.0",
    "dice": "1 - coalesce(c / nullif(na + nb, 0)::DOUBLE, 0)",
    "overlap": "1 - coalesce(c / nullif(least(na, nb), 0)::DOUBLE, 0)",
    "cosine": "coalesce(c / nullif(sqrt(na::DOUBLE * nb), 0), 0)",
    "fvb": "(2 - (na + nb) / 128.0) / 3 * coalesce(c / nullif(na + nb - c, 0)::DOUBLE, 1) + (1 + (na + nb) / 128.0) / 3 * coalesce((64 - na - nb + c) / nullif(64 - c, 0)::DOUBLE, 1)",
}


@query("c_metrics", "SELECT a, b, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _METRICS.items()) + f" FROM {PAIR} WHERE b = a + 1")
def c_metrics(spark, sf):
    f = fingerprints(spark, sf)
    a, b = f.select(F.col("id").alias("a"), F.col("fp").alias("x")), f.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("fp").alias("y"))
    return a.join(b, "a").select("a", "b", *[F.round(dense(k, F.col("x"), F.col("y"), BITS, 0.7, 0.3), 6).alias(k) for k in _METRICS])


@query("c_pair_distances", f"SELECT a, b, round(d, 6) AS distance FROM {TANIMOTO} WHERE b = a + 3")
def c_pair_distances(spark, sf):
    f = fingerprints(spark, sf)
    pairs = f.select(F.col("id").alias("a"), (F.col("id") + 3).alias("b"))
    return _six(s.pair_distances(pairs, f), "distance")


_SPARSE = """
WITH w AS (SELECT conv_id, unnest(string_split(coalesce(text, ''), ' ')) AS t FROM conversations WHERE turn < 2),
     n AS (SELECT conv_id, t, count(*) AS n FROM w GROUP BY ALL),
     p AS (SELECT x.conv_id AS a, x.conv_id + 1 AS b FROM (SELECT DISTINCT conv_id FROM n) x JOIN (SELECT DISTINCT conv_id FROM n) y ON y.conv_id = x.conv_id + 1),
     k AS (SELECT p.a, p.b, n.t FROM p JOIN n ON n.conv_id IN (p.a, p.b) GROUP BY ALL),
     z AS (SELECT k.a, k.b, coalesce(x.n, 0) AS x, coalesce(y.n, 0) AS y FROM k LEFT JOIN n x ON x.conv_id = k.a AND x.t = k.t LEFT JOIN n y ON y.conv_id = k.b AND y.t = k.t)
SELECT a, b, round(sum(least(x, y)) / (sum(x + y) - sum(least(x, y))), 6) AS tanimoto,
       round(sum(CASE WHEN x > 0 AND y > 0 THEN 1 ELSE 0 END) / count(*), 6) AS binary,
       round(sum(x * y) / (sum(x * x) + sum(y * y) - sum(x * y)), 6) AS continuous,
       round(sum(x * y) / sqrt(sum(x * x)::DOUBLE * sum(y * y)), 6) AS cosine,
       round(1 / (1 + sum(abs(x - y))), 6) AS manhattan, round(1 - sum(abs(x - y)) / sum(greatest(x, y)), 6) AS soergel
FROM z GROUP BY a, b
"""


@query("c_sparse_metrics", _SPARSE)
def c_sparse_metrics(spark, sf):
    c = table(spark, sf, "conversations").filter("turn < 2").select("conv_id", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("t"))
    n = c.groupBy("conv_id", "t").agg(F.count("*").alias("n"))
    fp = n.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("fp"))
    a, b = fp.select(F.col("conv_id").alias("a"), F.col("fp").alias("x")), fp.select((F.col("conv_id") - 1).alias("a"), F.col("conv_id").alias("b"), F.col("fp").alias("y"))
    kinds = ("tanimoto", "binary", "continuous", "cosine", "manhattan", "soergel")
    return a.join(b, "a").select("a", "b", *[F.round(sparse(k, F.col("x"), F.col("y")), 6).alias(k) for k in kinds])


_COMPONENTS = """
WITH RECURSIVE e AS (SELECT a, b FROM {t} WHERE d <= 0.45), r(id, m) AS (SELECT id, id FROM {f} UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id WHERE r.m < e.b)
SELECT id, min(m) AS cluster FROM r GROUP BY id
""".format(t=TANIMOTO, f=FP)


@query("c_single_linkage", _COMPONENTS)
def c_single_linkage(spark, sf):
    return s.single_linkage(fingerprints(spark, sf), 0.45)


@query("c_leader")
def c_leader(spark, sf):
    return _six(s.leader(fingerprints(spark, sf), 0.5), "distance")


@query("c_spread")
def c_spread(spark, sf):
    return _six(s.spread(fingerprints(spark, sf), 40), "distance")


@query("c_taylor_butina")
def c_taylor_butina(spark, sf):
    return s.butina(fingerprints(spark, sf), 0.45)


@query("c_jarvis_patrick")
def c_jarvis_patrick(spark, sf):
    f = fingerprints(spark, sf)
    return s.jarvis_patrick(s.nearest(f, f, 6), f, 6, 4)


@query("c_merge_neighbours", f"SELECT a AS needle, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank, b AS neighbour, round(d, 6) AS distance FROM {TANIMOTO} QUALIFY rank <= 4")
def c_merge_neighbours(spark, sf):
    f = fingerprints(spark, sf)
    lists = [s.nearest(f, f.filter(f"id % 3 = {k}"), 4) for k in range(3)]
    return _six(s.merge_neighbours(lists, 4).withColumn("rank", F.col("rank").cast("long")), "distance")
