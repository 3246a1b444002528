import math
import random
import statistics

from pestle.operators import tables as t


def test_deviation_is_exact_and_holds_no_group_whole(spark):
    rng = random.Random(6)
    data = [(g, rng.choice([round(rng.gauss(0, 5), 2), float(rng.randrange(3))]), None if rng.random() < 0.1 else rng.lognormvariate(0, 9)) for g in ("a", "b", None, "c") for _ in range(3000 if g == "a" else 40)]
    data += [("c", 1.5, None), ("none", None, None), ("one", 2.5, -1.0), ("two", 1.0, 2.0), ("two", 4.0, 2.0)]
    df = spark.createDataFrame(data, "g string, x double, y double").repartition(4)

    def want(g, i):
        v = [r[i] for r in data if r[0] == g and r[i] is not None]
        m = statistics.median(v) if v else None
        return (m, statistics.median(abs(x - m) for x in v) * 1.4826) if v else (None, None)

    same = lambda p, q: p is None and q is None or math.isclose(p, q, rel_tol=1e-12)
    got = {r.g: r for r in t.deviation(df, ["x", "y"], ["g"]).collect()}
    assert set(got) == {r[0] for r in data}
    for g, r in got.items():
        assert all(map(same, (r.x_median, r.x_mad, r.y_median, r.y_mad), (*want(g, 1), *want(g, 2)))), g
    assert got["a"].x_median == t.deviation(df.filter("g = 'a'"), ["x"]).first().x_median
    narrow = {r.g: r.p0 for r in t.exact_percentiles(df, ["y"], [0.5], ["g"], width=1e-9).collect()}
    assert narrow == {g: r.y_median for g, r in got.items() if g != "none"}
    plan = t.deviation(df, ["x"], ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_statistics_with_percentiles(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i % 3 or None, rng.gauss(0, 1), None if i % 3 == 1 else float(i % 7)) for i in range(2000)], "g int, x double, y double")
    got = {(r.g, r.column): (r.p0, r.p12_5, r.p50, r.p100) for r in t.column_statistics(df, ["x", "y"], [0, 0.125, 0.5, 1], ["g"]).collect()}
    q = spark.sql
    df.createOrReplaceTempView("v")
    for c in ("x", "y"):
        for r in q(f"SELECT g, percentile({c}, array(0, 0.125, 0.5, 1)) AS p FROM v GROUP BY g").collect():
            assert got.pop((r.g, c)) == (tuple(r.p) if r.p else (None,) * 4)
    assert not got
    plan = t.column_statistics(df, ["x"], [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
