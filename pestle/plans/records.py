"""Queries of tagged records and of further table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pestle.operators import records as r
from pestle.operators import store, tables
from pestle.registry import query, table


def order_records(spark, sf):
    """Each order as a record; every seventh has no status, every fifth a second priority."""
    o = table(spark, sf, "orders")
    base = r.record(PCN=F.col("o_orderkey"), CUST=F.col("o_custkey"), ST=F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")), PRI=F.col("o_orderpriority"), SIZE=F.col("o_orderkey") % 13)
    again = F.when(F.col("o_orderkey") % 5 == 0, r.record(PRI=F.lit("9-EXTRA"))).otherwise(F.array().cast("array<struct<tag:string,value:string>>"))
    return o.select(F.concat(base, again).alias("tags"))


def customer_records(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(r.record(CUST=F.col("c_custkey"), NAME=F.col("c_name"), SEG=F.col("c_mktsegment"), SIZE=F.col("c_nationkey")).alias("tags"))


def flat(df):
    """Records as text, to compare them."""
    return df.select(F.array_join(F.transform("tags", lambda t: F.concat_ws("=", t["tag"], t["value"])), ";").alias("record"))


STATUS = "CASE WHEN o_orderkey % 7 <> 0 THEN ';ST=' || o_orderstatus ELSE '' END"
EXTRA = "CASE WHEN o_orderkey % 5 = 0 THEN ';PRI=9-EXTRA' ELSE '' END"
RECORD = f"'PCN=' || o_orderkey || ';CUST=' || o_custkey || {STATUS} || ';PRI=' || o_orderpriority || ';SIZE=' || (o_orderkey % 13) || {EXTRA}"


@query("b_record_join", f"SELECT {RECORD} || ';NAME=' || c_name || ';SEG=' || c_mktsegment AS record FROM orders JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 = 0")
def b_record_join(spark, sf):
    few = customer_records(spark, sf).filter(r.tag("CUST").cast("long") % 3 == 0)
    return flat(r.join_records([order_records(spark, sf), few], "CUST"))


@query("b_record_join_left", f"SELECT {RECORD} || coalesce(';NAME=' || c_name || ';SEG=' || c_mktsegment || ';SIZE=' || c_nationkey, '') AS record FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 = 0")
def b_record_join_left(spark, sf):
    few = customer_records(spark, sf).filter(r.tag("CUST").cast("long") % 3 == 0)
    return flat(r.join_records([order_records(spark, sf), few], "CUST", "left", distinct_tags=False))


@query("b_record_sort", "SELECT o_orderkey::VARCHAR AS id, row_number() OVER (ORDER BY (o_orderkey % 13) DESC, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END ASC NULLS LAST, o_orderkey) - 1 AS position FROM orders")
def b_record_sort(spark, sf):
    keyed = order_records(spark, sf).select(r.tag("PCN").alias("id"), (-r.tag("SIZE").cast("double")).alias("size"), r.tag("ST").isNull().alias("none"), r.tag("ST").alias("status"), r.tag("PCN").cast("double").alias("number"))
    return tables.row_numbers(keyed, ["size", "none", "status", "number"]).select("id", F.col("__row").alias("position"))


@query("b_record_statistics", """
WITH t AS (SELECT o_orderkey AS k, 'PCN' AS tag, o_orderkey::DOUBLE AS x FROM orders UNION ALL SELECT o_orderkey, 'CUST', o_custkey FROM orders
 UNION ALL SELECT o_orderkey, 'ST', NULL FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'PRI', NULL FROM orders
 UNION ALL SELECT o_orderkey, 'PRI', NULL FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'SIZE', o_orderkey % 13 FROM orders)
SELECT tag, count(DISTINCT k) AS records, count(*) AS occurrences, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean FROM t GROUP BY tag""")
def b_record_statistics(spark, sf):
    return r.record_statistics(order_records(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("b_record_fetch", f"SELECT {RECORD} AS record FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def b_record_fetch(spark, sf):
    return flat(r.fetch_records(order_records(spark, sf), table(spark, sf, "customer").filter("c_acctbal > 5000").select("c_custkey"), "CUST"))


@query("b_record_fetch_not", f"SELECT {RECORD} AS record FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def b_record_fetch_not(spark, sf):
    return flat(r.fetch_records(order_records(spark, sf), table(spark, sf, "customer").filter("c_acctbal > 5000").select("c_custkey"), "CUST", invert=True))


@query("b_record_project", "SELECT o_orderstatus AS smiles, o_orderkey::VARCHAR AS name, o_orderpriority AS PRI FROM orders WHERE o_orderkey % 7 <> 0")
def b_record_project(spark, sf):
    return r.to_smiles(order_records(spark, sf), "ST", "PCN", ["PRI"])


@query("b_record_filter", f"SELECT {RECORD} AS record FROM orders WHERE (o_orderkey % 13 >= 4 AND o_orderkey % 13 < 9 AND o_orderkey % 7 <> 0 AND o_orderstatus = 'F') OR o_custkey <= 20")
def b_record_filter(spark, sf):
    return flat(r.filter_records(order_records(spark, sf), "SIZE>=4&&SIZE<9&&ST=~^F$||CUST<=20", ["SIZE", "ST", "CUST"]))


@query("d_store_from_records", "SELECT o_custkey::VARCHAR AS key, min((o_orderkey % 13)::VARCHAR) AS value FROM orders GROUP BY 1")
def d_store_from_records(spark, sf):
    return r.to_store(order_records(spark, sf), "CUST", "SIZE")


@query("d_store_into_records", f"SELECT {RECORD} || ';SEG=' || coalesce(c_mktsegment, '.') AS record FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 4 = 1")
def d_store_into_records(spark, sf):
    kept = table(spark, sf, "customer").filter("c_custkey % 4 = 1").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    return flat(r.from_store(order_records(spark, sf), store.merge([kept]), "CUST", "SEG", "."))


@query("a_in_stock", "SELECT l_partkey, sum(l_quantity) AS amount FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1 HAVING sum(l_quantity) >= 700")
def a_in_stock(spark, sf):
    li = table(spark, sf, "lineitem")
    parts = [li.filter(F.col("l_linenumber") % 2 == k) for k in (0, 1)]
    return tables.in_stock(parts, "l_partkey", "l_quantity", 700, table(spark, sf, "part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey")))


@query("a_deviation", "SELECT l_returnflag, median(l_quantity) AS l_quantity_median, round(mad(l_quantity) * 1.4826, 6) AS l_quantity_mad, median(l_extendedprice) AS l_extendedprice_median, round(mad(l_extendedprice) * 1.4826, 6) AS l_extendedprice_mad FROM lineitem GROUP BY 1")
def a_deviation(spark, sf):
    out = tables.deviation(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"])
    return out.withColumn("l_quantity_mad", F.round("l_quantity_mad", 6)).withColumn("l_extendedprice_mad", F.round("l_extendedprice_mad", 6))


@query("a_extremes", "WITH e AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1) SELECT l_returnflag, lo AS min, min(CASE WHEN l_quantity = lo THEN l_orderkey END) AS min_key, hi AS max, min(CASE WHEN l_quantity = hi THEN l_orderkey END) AS max_key, count(*) FILTER (l_quantity = lo) AS n_min, count(*) FILTER (l_quantity = hi) AS n_max FROM lineitem JOIN e USING (l_returnflag) GROUP BY ALL")
def a_extremes(spark, sf):
    return tables.extremes(table(spark, sf, "lineitem"), "l_quantity", "l_orderkey", ["l_returnflag"])


@query("a_changes", "SELECT o_orderkey, o_orderstatus, previous FROM (SELECT *, lag(o_orderstatus) OVER (ORDER BY o_orderkey) AS previous, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1 OR o_orderstatus <> previous")
def a_changes(spark, sf):
    return tables.changes(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus")


@query("a_shuffled_columns", "SELECT * FROM supplier")
def a_shuffled_columns(spark, sf):
    return tables.shuffled_columns(table(spark, sf, "supplier"), 7, ["s_suppkey"])


@query("a_intersect", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def a_intersect(spark, sf):
    return tables.common_rows(table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("a_except", "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def a_except(spark, sf):
    return tables.common_rows(table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], invert=True)


@query("a_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a_rollup(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.sum("l_quantity").alias("quantity"))


@query("a_collate_complements", "WITH p AS (SELECT o_orderpriority AS fragment, o_orderstatus AS complement, count(*) AS n FROM orders GROUP BY ALL) SELECT fragment, sum(n)::BIGINT AS total, string_agg(complement || ':' || n, ',' ORDER BY complement) AS complements FROM p GROUP BY fragment")
def a_collate_complements(spark, sf):
    o = table(spark, sf, "orders").withColumn("one", F.lit(1))
    out = tables.collate_complements([o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1")], "o_orderpriority", "o_orderstatus", "one")
    return out.withColumn("complements", F.array_join(F.transform("complements", lambda c: F.concat_ws(":", c["complement"], c["n"].cast("string"))), ","))


GRID = "SELECT (l_linenumber * 0.5)::DOUBLE AS x, (l_suppkey * 0.5)::DOUBLE AS y, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag = '{}' GROUP BY 1, 2"


@query("a_grid_overlap", f"SELECT a.x, a.y, round(a.v, 6) AS v, round(b.v, 6) AS other, abs(a.v - b.v) <= 2 AS overlaps FROM ({GRID.format('A')}) a JOIN ({GRID.format('N')}) b ON a.x = b.x AND a.y = b.y")
def a_grid_overlap(spark, sf):
    grid = lambda flag, shift: table(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag).groupBy((F.col("l_linenumber") * 0.5).cast("double").alias("x"), (F.col("l_suppkey") * 0.5 + shift).cast("double").alias("y")).agg(F.avg("l_quantity").alias("v"))
    out = tables.grid_overlap(grid("A", 0.0), grid("N", 0.1), ["x", "y"], "v", 0.5, 2.0)
    return out.withColumn("v", F.round("v", 6)).withColumn("other", F.round("other", 6))
