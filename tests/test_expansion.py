import numpy as np
from pestle.operators.anomaly import fit_forest, forest_scores, isolation_forest
from pestle.operators.expansion import iterative_expansion
from pestle.operators.tables import overlapping_distribution


def distance(a, b):
    either = (a | b).bit_count()
    return 1 - ((a & b).bit_count() / either if either else 1)


def test_expansion_equals_plain_loops(spark):
    rng = np.random.default_rng(3)
    fps = {i: int(rng.integers(1, 1 << 10)) for i in range(150)}
    df = spark.createDataFrame([(i, [f]) for i, f in fps.items()], "id long, fp array<long>")
    radii = (0.35, 0.3, 0.4)
    got = sorted((r.id, r.generation, r.times_found, r.ancestor, r.parent, round(r.distance, 9)) for r in iterative_expansion(df.filter("id % 50 = 0"), df, radii).collect())
    frontier, left, want = {i: i for i in fps if i % 50 == 0}, {i for i in fps if i % 50}, []
    for g, radius in enumerate(radii, 1):
        new = {}
        for i in sorted(left):
            if near := sorted((distance(fps[i], fps[j]), j) for j in frontier if distance(fps[i], fps[j]) <= radius + 1e-12):
                new[i] = frontier[near[0][1]]
                want.append((i, g, len(near), new[i], near[0][1], round(near[0][0], 9)))
        frontier, left = new, left - set(new)
    assert got == sorted(want) and len({w[1] for w in want}) == 3
    assert iterative_expansion(df.limit(0), df, radii).count() == 0


def test_forest(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(1000, 9.0, -9.0), (1001, None, 0.0), (1002, 0.0, None), (1003, None, None)]
    df = spark.createDataFrame(rows, "row long, a double, b double")
    got = {r.row: r for r in isolation_forest(df, "row", ["a", "b"], trees=50, sample=64).collect()}
    assert len(got) == len(rows) and max(got.values(), key=lambda r: r.score).row == 1000 and not any(r.outside for r in got.values())
    forest, size = fit_forest(df, ["a", "b"], 50, 64)

    def walk(tree, row):
        at = 0
        while tree[0][at] >= 0:
            x = row[tree[0][at]]
            at = (tree[2] if x is not None and x < tree[1][at] else tree[3])[at]
        return tree[4][at]

    norm = 2 * (np.log(size - 1) + 0.5772156649) - 2 * (size - 1) / size
    for i, *row in rows:
        assert abs(got[i].score - 2 ** (-np.mean([walk(t, row) for t in forest]) / norm)) < 1e-12
    beyond = isolation_forest(df, "row", ["a", "b"], reference=df.filter("row < 400"), trees=10).filter("outside > 0").collect()
    assert [(r.row, r.outside) for r in beyond] == [(1000, 2)]
    assert isolation_forest(df.limit(0), "row", ["a", "b"]).count() == 0
    assert {r.score for r in isolation_forest(df.filter("row = 1"), "row", ["a", "b"]).collect()} == {0.5}
    assert len(forest_scores(np.zeros((3, 2)), forest, size)) == 3


def test_overlapping_buckets(spark):
    values = [None, 0.0, 1.0, 2.5, -3.0, 10.0, 10.0]
    got = {r.bucket: r.n for r in overlapping_distribution(spark.createDataFrame([(v,) for v in values], "v double"), "v", 1.0, 2.5).collect()}
    want = {i: sum(i <= v < i + 2.5 for v in values if v is not None) for i in range(-10, 20)}
    assert got == {k: n for k, n in want.items() if n}
