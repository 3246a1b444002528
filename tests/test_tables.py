import duckdb
import pytest
from pestle.functions.filter_dsl import expression
from pestle.operators import tables as t
from pestle.plans import load


def test_filter_language(spark):
    df = spark.createDataFrame([(1, 1.0, "ab"), (2, None, "cd"), (3, 5.0, None)], "id int, x double, s string")
    ids = lambda text, **k: [r.id for r in df.filter(expression(text, **k)).orderBy("id").collect()]
    assert ids("x!=3") == [1, 3] and ids("x!=3", missing_passes=True) == [1, 2, 3]
    assert ids("x<2||s=~d$") == [1, 2] and ids("x.lt.2||x>4;;id>1") == [3] and ids("x<2^^id<3") == [2]
    assert ids("x>0&&x<2||id=2") == [1, 2]
    for bad in ("x", "x<a", "x<1^^id<2^^id<3", "x<1^^id<2&&id<3"):
        with pytest.raises(ValueError):
            expression(bad)


def test_joins_and_duplicates(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, x string")
    b = spark.createDataFrame([(1, 10), (1, 5), (4, 7)], "k int, y int")
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert rows(t.join_tables([a, b], "k", "left", "first")) == [(1, "a", 5), (2, "b", None), (3, "c", None)]
    assert len(rows(t.join_tables([a, b], "k", "full", "first"))) == 4
    with pytest.raises(Exception, match="repeated key"):
        t.join_tables([a, b], "k", "inner").collect()
    assert rows(t.join_tables([a, b.filter("y > 5")], "k", "left", fill=0)) == [(1, "a", 10), (2, "b", 0), (3, "c", 0)]


def test_scaling_round_trip(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(20)], "k int, x double")
    p = t.fit_scaling(df, ["x"])
    for kind in ("01", "11", "uv", "mc"):
        back = t.undo_scaling(t.apply_scaling(df, p, ["x"], kind), p, ["x"], kind)
        assert all(abs(r.x - r.k**2) < 1e-9 for r in back.collect())
    constant = spark.createDataFrame([(1, 2.0), (2, 2.0)], "k int, x double")
    assert {r.x for r in t.apply_scaling(constant, t.fit_scaling(constant, ["x"]), ["x"], "01").collect()} == {None}
    assert {r.x for r in t.bucketise(constant, ["x"], 5).collect()} == {None}


def test_columns_and_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, -1.0), (2, 1.0, 6.0, 2.0), (3, 1.0, 7.0, 3.0)], "k int, a double, b double, c double")
    assert t.informative_columns(df, ["a", "b", "c"]) == ["b", "c"]
    assert t.same_sign_columns(df, ["a", "b", "c"]) == ["a", "b"]
    assert t.select_columns(df, ["c", "k"]).columns == ["c", "k"] and t.select_columns(df, ["c"], invert=True).columns == ["k", "a", "b"]
    assert t.select_columns(df, ["zz"], pad=".").first()[0] == "."
    with pytest.raises(ValueError):
        t.select_columns(df, ["zz"])
    assert [r["__row"] for r in t.row_numbers(df, ["k"]).orderBy("k").collect()] == [0, 1, 2]
    assert {r.line for r in t.svm_lite(df, "k", ["a", "c"], "k").collect()} == {"1 1:1.0 2:-1.0", "2 1:1.0 2:2.0", "3 1:1.0 2:3.0"}
    assert t.transpose(df, "k").count() == 3


@pytest.mark.parametrize("name", ["a_join_tables_full", "a_unique_rows", "a_column_statistics", "a_running_average", "a_spearman", "c_metrics", "c_sparse_metrics", "c_single_linkage"])
def test_registered_queries_equal_sql(spark, name):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables are absent")
    registry = load()
    got = registry.QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    want = con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    key = lambda d: sorted(repr([None if x != x or x is None else float(x) if isinstance(x, (int, float)) or hasattr(x, "dtype") else x for x in r]) for r in d[cols].itertuples(index=False))
    assert key(got) == key(want)
