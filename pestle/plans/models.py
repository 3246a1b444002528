"""Queries of model statistics, bit profiles and key-value stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pestle.operators import models, store
from pestle.plans.fingerprints import FP, fingerprints
from pestle.registry import query, table

BITS = f"(SELECT id, label, (i - 1)::BIGINT AS bit FROM (SELECT id, label, f, unnest(range(1, len(f) + 1)) AS i FROM {FP}) WHERE f[i] = 1)"


@query("m_bit_profile", f"WITH t AS (SELECT count(*) AS na, sum(label) AS sa FROM {FP}) SELECT bit, count(*) AS n, round(avg(label), 6) AS mean_set, round((any_value(sa) - sum(label)) / (any_value(na) - count(*)), 6) AS mean_unset, round(avg(label) - (any_value(sa) - sum(label)) / (any_value(na) - count(*)), 6) AS difference FROM {BITS}, t GROUP BY bit")
def m_bit_profile(spark, sf):
    f = fingerprints(spark, sf)
    out = models.bit_profile(models.bits_of(f), f, "label")
    return out.select("bit", "n", *[F.round(c, 6).alias(c) for c in ("mean_set", "mean_unset", "difference")])


@query("m_naive_bayes", f"WITH c AS (SELECT label, count(*) AS nc FROM {FP} GROUP BY 1), a AS (SELECT count(*) AS na FROM {FP}), b AS (SELECT bit, count(*) AS nb FROM {BITS} GROUP BY 1), p AS (SELECT bit, label, count(*) AS n FROM {BITS} GROUP BY ALL) SELECT b.bit, c.label, round(ln((coalesce(n, 0) + nb / na) / (nc + 1) / (nb / na)), 6) AS weight FROM b, c, a LEFT JOIN p ON p.bit = b.bit AND p.label = c.label")
def m_naive_bayes(spark, sf):
    f = fingerprints(spark, sf)
    return models.naive_bayes(models.bits_of(f), f, "label").withColumn("weight", F.round("weight", 6))


@query("m_information_content")
def m_information_content(spark, sf):
    f = fingerprints(spark, sf)
    return models.information_content(models.bits_of(f), f, "label")


@query("m_roc", "WITH d AS (SELECT l_quantity AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS a FROM lineitem), l AS (SELECT s, count(*) AS c, sum(a) AS p FROM d GROUP BY 1), w AS (SELECT *, coalesce(sum(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ap FROM l) SELECT sum(c)::BIGINT AS n, sum(p)::BIGINT AS actives, round(sum((c - p) * (ap + p / 2)) / (sum(p) * sum(c - p)), 9) AS roc FROM w")
def m_roc(spark, sf):
    d = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("a"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t"))
    return models.enrichment(d, "l_quantity", "a", "t").select("n", "actives", F.round("roc", 9).alias("roc"))


@query("m_enrichment")
def m_enrichment(spark, sf):
    d = table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_quantity") > 40).cast("int").alias("a"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t"))
    return models.enrichment(d, "l_extendedprice", "a", "t")


def _stores(spark, sf):
    o = table(spark, sf, "orders")
    make = lambda k: o.filter(f"o_orderkey % {k} = 0").select(F.col("o_custkey").cast("string").alias("key"), (F.col("o_orderkey") % 97).alias("v")).groupBy("key").agg(F.max("v").cast("string").alias("value"))
    return make(2), make(3)


_STORE = "(SELECT o_custkey::VARCHAR AS key, max(o_orderkey % 97)::VARCHAR AS value FROM orders WHERE o_orderkey % {} = 0 GROUP BY 1)"


@query("d_store_append", f"SELECT key, CASE WHEN a.value IS NULL THEN b.value WHEN b.value IS NULL THEN a.value ELSE a.value || ':' || b.value END AS value FROM {_STORE.format(2)} a FULL JOIN {_STORE.format(3)} b USING (key)")
def d_store_append(spark, sf):
    a, b = _stores(spark, sf)
    return store.load(a, b, "append")


@query("d_store_compare", f"SELECT key, CASE WHEN a.value IS NULL THEN 'new' WHEN b.value IS NULL THEN 'missing' ELSE 'differs' END AS state FROM {_STORE.format(2)} a FULL JOIN {_STORE.format(3)} b USING (key) WHERE a.value IS DISTINCT FROM b.value")
def d_store_compare(spark, sf):
    return store.compare(*_stores(spark, sf))


@query("d_store_exists", f"SELECT c_custkey::VARCHAR AS key, c_custkey::VARCHAR IN (SELECT key FROM {_STORE.format(3)}) AS exists FROM customer")
def d_store_exists(spark, sf):
    return store.exists(_stores(spark, sf)[1], table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key")))
