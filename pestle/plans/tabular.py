"""Queries of the table operators over the driver tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from pestle.operators import tables as t
from pestle.registry import query, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a_filter_dsl", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity <= 10 AND l_discount != 0.05) OR l_returnflag LIKE 'R%'")
def a_filter_dsl(spark, sf):
    return t.filter_rows(table(spark, sf, "lineitem"), "l_quantity<=10&&l_discount!=0.05||l_returnflag=~^R").select("l_orderkey", "l_linenumber", "l_quantity")


@query("a_filter_xor", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 25) <> (l_tax >= 0.04)")
def a_filter_xor(spark, sf):
    return t.filter_rows(table(spark, sf, "lineitem"), "l_quantity.gt.25^^l_tax.ge.0.04").select("l_orderkey", "l_linenumber")


def _customer_orders(spark, sf):
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("top_price"))
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), spent


for _how, _sql in (("left", "LEFT"), ("inner", "INNER"), ("full", "FULL")):

    @query(f"a_join_tables_{_how}", f"SELECT c_custkey, c_mktsegment, n_orders, top_price FROM (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0) {_sql} JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders, max(o_totalprice) AS top_price FROM orders GROUP BY 1) USING (c_custkey)")
    def _join(spark, sf, how=_how):
        a, b = _customer_orders(spark, sf)
        return t.join_tables([a.filter("c_custkey % 5 <> 0"), b], "c_custkey", how)


@query("a_select_columns", "SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem")
def a_select_columns(spark, sf):
    return t.select_columns(table(spark, sf, "lineitem"), ["l_orderkey"], r"^l_(quantity|extended)")


@query("a_grep_rows", "SELECT p_partkey, p_name FROM part WHERE (CASE WHEN regexp_matches(p_name, 'a.*e') OR regexp_matches(p_type, 'a.*e') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(p_name, '1') OR regexp_matches(p_type, '1') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(p_name, 'E') OR regexp_matches(p_type, 'E') THEN 1 ELSE 0 END) >= 2")
def a_grep_rows(spark, sf):
    return t.grep_rows(table(spark, sf, "part"), ["p_name", "p_type"], ["a.*e", "1", "E"], least=2).select("p_partkey", "p_name")


@query("a_unique_rows", "SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, lower(o_orderpriority) ORDER BY o_orderkey) <= 2")
def a_unique_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey").withColumn("k", F.col("o_custkey").cast("string"))
    return t.unique_rows(o, ["k", "o_orderpriority"], ["o_orderkey"], keep=2, ignore_case=True).drop("k")


@query("a_duplicate_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def a_duplicate_counts(spark, sf):
    return t.duplicate_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


def _gaps(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("x"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("y"))


GAPS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS x, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS y FROM orders)"


@query("a_missing_counts", f"SELECT 'x' AS \"column\", count(*) - count(x) AS n_missing, count(*) AS n FROM {GAPS} UNION ALL SELECT 'y', count(*) - count(y), count(*) FROM {GAPS}")
def a_missing_counts(spark, sf):
    return t.missing_counts(_gaps(spark, sf), ["x", "y"])


@query("a_rows_with_missing", f"SELECT o_orderkey FROM {GAPS} WHERE NOT (x IS NULL AND y IS NULL)")
def a_rows_with_missing(spark, sf):
    return t.rows_with_missing(_gaps(spark, sf), ["x", "y"], 1).select("o_orderkey")


@query("a_concatenate", "SELECT c_custkey AS k, c_acctbal AS bal, 'c' AS source FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 's' FROM supplier")
def a_concatenate(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return t.concatenate([c, s], ["c", "s"])


@query("a_select_rows", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def a_select_rows(spark, sf):
    ids = table(spark, sf, "orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return t.select_rows(table(spark, sf, "customer"), ids, "c_custkey").select("c_custkey", "c_name")


@query("a_select_rows_inverse", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def a_select_rows_inverse(spark, sf):
    return t.select_rows(table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", invert=True).select("c_custkey", "c_name")


@query("a_sort_rows", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 50")
def a_sort_rows(spark, sf):
    return t.sort_rows(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [("c_acctbal", True, True)], ["c_custkey"]).limit(50)


@query("a_difference_sort", "SELECT l_orderkey, l_linenumber, abs(l_discount - l_tax) AS difference FROM lineitem WHERE abs(l_discount - l_tax) > 0.09")
def a_difference_sort(spark, sf):
    return t.difference(table(spark, sf, "lineitem"), "l_discount", "l_tax", absolute=True).filter("difference > 0.09").select("l_orderkey", "l_linenumber", "difference")


_STATS = " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS n_missing, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(quantile_cont({c}, 0.5), 6) AS p50 FROM lineitem GROUP BY 1"
    for c in NUMBERS
)


@query("a_column_statistics", _STATS)
def a_column_statistics(spark, sf):
    s = t.column_statistics(table(spark, sf, "lineitem"), NUMBERS, [0.5], by=["l_returnflag"])
    return s.select("l_returnflag", "column", "n", "n_missing", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "sd", "p50")])


@query("a_bucketise", "SELECT l_orderkey, l_linenumber, CAST(floor(0.5 + (l_extendedprice - lo) / ((hi - lo) / 10)) AS BIGINT) AS l_extendedprice FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)")
def a_bucketise(spark, sf):
    return t.bucketise(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"], 10)


@query("a_distribution", "SELECT CAST(floor(0.5 + l_extendedprice / 5000.0) AS BIGINT) AS bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM lineitem GROUP BY 1")
def a_distribution(spark, sf):
    return t.distribution(table(spark, sf, "lineitem"), "l_extendedprice", 5000.0, "area").withColumn("share", F.round("share", 9))


@query("a_normalise_01", "SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 9) AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def a_normalise_01(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return t.apply_scaling(c, t.fit_scaling(c, ["c_acctbal"]), ["c_acctbal"], "01").withColumn("c_acctbal", F.round("c_acctbal", 9))


@query("a_normalise_uv", "SELECT c_custkey, round((c_acctbal - m) / s, 7) AS c_acctbal FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)")
def a_normalise_uv(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return t.apply_scaling(c, t.fit_scaling(c, ["c_acctbal"]), ["c_acctbal"], "uv").withColumn("c_acctbal", F.round("c_acctbal", 7))


@query("a_drop_outliers", "SELECT o_orderkey FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) WHERE abs(o_totalprice - m) <= 1.5 * s")
def a_drop_outliers(spark, sf):
    return t.drop_outliers(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 1.5).select("o_orderkey")


@query("a_running_average", "WITH c AS (SELECT r // 100 AS chunk, count(*) AS n, avg(v) AS mean, min(v) AS min, max(v) AS max, sum(v) AS s FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS r, o_totalprice AS v FROM orders) GROUP BY 1) SELECT chunk, n, round(mean, 6) AS mean, min, max, round(sum(s) OVER (ORDER BY chunk) / sum(n) OVER (ORDER BY chunk), 3) AS cumulative FROM c")
def a_running_average(spark, sf):
    out = t.running_average(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", 100)
    return out.select("chunk", "n", F.round("mean", 6).alias("mean"), "min", "max", F.round("cumulative", 3).alias("cumulative"))


@query("a_hash_split", "SELECT c_custkey, CASE WHEN CAST('0x' || substr(md5('7:' || c_custkey), 1, 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM customer")
def a_hash_split(spark, sf):
    return t.hash_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 80, seed=7)


@query("a_stratified_split", "SELECT c_custkey, c_mktsegment, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('3:' || c_custkey), c_custkey) * 100 <= count(*) OVER (PARTITION BY c_mktsegment) * 75 THEN 'train' ELSE 'test' END AS split FROM customer")
def a_stratified_split(spark, sf):
    return t.stratified_split(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 75, seed=3)


@query("a_classify_scores", "SELECT o_orderkey, CASE WHEN o_totalprice >= 110000 THEN 'pos' WHEN o_totalprice <= 90000 THEN 'neg' ELSE 'ambiguous' END AS class FROM orders")
def a_classify_scores(spark, sf):
    return t.classify_scores(table(spark, sf, "orders"), "o_totalprice", 100000, 10000).select("o_orderkey", "class")


@query("a_translate_labels", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'N' THEN -1.0::DOUBLE END AS l_returnflag FROM lineitem")
def a_translate_labels(spark, sf):
    return t.translate_labels(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", {"R": 1.0, "N": -1.0})


@query("a_compare_tables", "SELECT c_custkey, 'c_acctbal' AS \"column\", c_acctbal AS \"left\", CASE WHEN c_custkey % 7 = 0 THEN c_acctbal * 1.1 ELSE c_acctbal END AS \"right\" FROM customer WHERE c_custkey % 7 = 0 AND abs(c_acctbal * 1.1 - c_acctbal) > 1")
def a_compare_tables(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    other = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") * 1.1).otherwise(F.col("c_acctbal")))
    return t.compare_tables(c, other, "c_custkey", ["c_acctbal"], absolute=1.0, ratio=0.01)


def _predictions(spark, sf):
    o = table(spark, sf, "orders")
    make = lambda f: o.select("o_orderkey", (F.col("o_totalprice") * f).alias("p"))
    return o.select("o_orderkey", "o_totalprice"), [make(0.9), make(1.0), make(1.3)]


@query("a_model_average", "SELECT o_orderkey, 3::BIGINT AS n, round((o_totalprice * 0.9 + o_totalprice + o_totalprice * 1.3) / 3, 4) AS mean, round(o_totalprice, 4) AS median FROM orders")
def a_model_average(spark, sf):
    out = t.model_average(_predictions(spark, sf)[1], "o_orderkey", "p")
    return out.select("o_orderkey", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"))


@query("a_mispredicted", "SELECT o_orderkey, 3::BIGINT AS n, round(o_totalprice * 0.4 / 3, 4) AS error FROM orders WHERE o_totalprice * 0.4 / 3 >= 20000")
def a_mispredicted(spark, sf):
    obs, preds = _predictions(spark, sf)
    return t.mispredicted(obs, preds, "o_orderkey", "o_totalprice", "p", 20000.0).withColumn("error", F.round("error", 4))


@query("a_confusion", " UNION ALL ".join(f"SELECT {c}.0::DOUBLE AS cutoff, count(*) FILTER (l_extendedprice >= 40000 AND l_quantity >= {c}) AS tp, count(*) FILTER (l_extendedprice < 40000 AND l_quantity >= {c}) AS fp, count(*) FILTER (l_extendedprice >= 40000 AND l_quantity < {c}) AS fn, count(*) FILTER (l_extendedprice < 40000 AND l_quantity < {c}) AS tn FROM lineitem" for c in (10, 25, 40)))
def a_confusion(spark, sf):
    return t.confusion(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", [10, 25, 40], 40000).select("cutoff", "tp", "fp", "fn", "tn")


@query("a_spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT count(*) AS n, round(corr(a, b), 9) AS rho FROM r")
def a_spearman(spark, sf):
    return t.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 9))


_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query("a_correlated_pairs", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS) + ") WHERE abs(r) >= 0.001")
def a_correlated_pairs(spark, sf):
    return t.correlated_pairs(table(spark, sf, "lineitem"), NUMBERS, 0.001).withColumn("r", F.round("r", 6))


@query("a_regression_statistics", "SELECT l_returnflag, count(*) AS n, round(avg(p - o), 4) AS bias, round(avg(abs(p - o)), 4) AS mae, round(sqrt(avg((p - o) ** 2)), 4) AS rms, round(corr(o, p) ** 2, 6) AS r2, round(1 - avg((p - o) ** 2) / var_pop(o), 6) AS q2 FROM (SELECT l_returnflag, l_extendedprice AS o, l_quantity * 1500.0 AS p FROM lineitem) GROUP BY 1")
def a_regression_statistics(spark, sf):
    d = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("o"), (F.col("l_quantity") * 1500.0).alias("p"))
    s = t.regression_statistics(d, "o", "p", ["l_returnflag"])
    return s.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("bias", "mae", "rms")], *[F.round(c, 6).alias(c) for c in ("r2", "q2")])


@query("a_token_counts", r"SELECT CAST(len(regexp_split_to_array(trim(p_name), '\s+')) AS BIGINT) AS tokens, count(*) AS n FROM part GROUP BY 1")
def a_token_counts(spark, sf):
    return t.token_counts(table(spark, sf, "part"), "p_name")


@query("a_unbalanced", "SELECT event_id FROM events WHERE (length(props) - length(replace(props, '1', ''))) % 2 = 1")
def a_unbalanced(spark, sf):
    return t.unbalanced(table(spark, sf, "events"), "props", "1").select("event_id")


@query("a_collate_counts", "SELECT e AS event_type, sum(n)::BIGINT AS n, min(u) AS u FROM (SELECT event_type AS e, count(*) AS n, min(user_id) AS u FROM events GROUP BY event_type, user_id % 3) GROUP BY 1")
def a_collate_counts(spark, sf):
    e = table(spark, sf, "events")
    parts = [e.filter(F.pmod("user_id", F.lit(3)) == k).groupBy("event_type").agg(F.count("*").alias("n"), F.min("user_id").alias("u")) for k in range(3)]
    return t.collate_counts(parts, "event_type", "n", "u")


@query("a_svm_lite")
def a_svm_lite(spark, sf):
    return t.svm_lite(table(spark, sf, "part"), "p_size", ["p_retailprice", "p_size"], "p_partkey")
