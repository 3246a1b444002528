import math
import random

import pytest
from pestle.operators import models, molecules, store
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_store(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "key string, value string")
    b = spark.createDataFrame([("y", "2"), ("z", "3")], "key string, value string")
    c = spark.createDataFrame([("y", "9")], "key string, value string")
    assert rows(store.load(a, b)) == [("x", "1"), ("y", "2"), ("z", "3")]
    assert rows(store.load(a, c, "overwrite")) == [("x", "1"), ("y", "9")]
    assert rows(store.load(a, b, "append")) == [("x", "1"), ("y", "2:2"), ("z", "3")]
    assert rows(store.load(a, b, "append_different")) == [("x", "1"), ("y", "2"), ("z", "3")]
    found, missing = store.fetch(a, b.select("key"))
    assert rows(found) == [("y", "2")] and rows(missing) == [("z",)]
    assert rows(store.exists(a, b.select("key"))) == [("y", True), ("z", False)]
    assert rows(store.delete(a, c)) == [("x", "1")] and rows(store.listing(a, "^y")) == [("y", "2")]
    assert rows(store.compare(a, b)) == [("x", "missing"), ("z", "new")] and rows(store.compare(a, c)) == [("x", "missing"), ("y", "differs")]
    assert rows(store.merge([a, b, c], "append_different")) == [("x", "1"), ("y", "2:9"), ("z", "3")]
    with pytest.raises(ValueError):
        store.load(a, b, "other")


def test_enrichment(spark):
    rng = random.Random(2)
    data = [(rng.randrange(20), int(rng.random() < 0.3), i) for i in range(200)]
    r = models.enrichment(spark.createDataFrame(data, "s int, a int, t int"), "s", "a", "t").first()
    ranked = sorted(data, key=lambda x: (-x[0], x[2]))
    pos, neg = [x for x in data if x[1]], [x for x in data if not x[1]]
    assert math.isclose(r.roc, sum((p[0] > q[0]) + (p[0] == q[0]) / 2 for p in pos for q in neg) / len(pos) / len(neg))
    n, k, alpha = 200, len(pos), 20.0
    rie = sum(math.exp(-alpha * (i + 1) / n) for i, x in enumerate(ranked) if x[1]) / (k / n * (1 - math.exp(-alpha)) / (math.exp(alpha / n) - 1))
    want = rie * (k / n) * math.sinh(alpha / 2) / (math.cosh(alpha / 2) - math.cosh(alpha / 2 - alpha * k / n)) + 1 / (1 - math.exp(alpha * (1 - k / n)))
    assert math.isclose(r.bedroc, want) and 0 <= r.bedroc <= 1
    assert math.isclose(r.ef_0_05, sum(x[1] for x in ranked[:10]) / 10 / (k / n))


def test_bits_and_classes(spark):
    fps = spark.createDataFrame([(1, [0b101, 0]), (2, [0b100, 1 << 31]), (3, [0, 0])], "id long, fp array<long>")
    bits = models.bits_of(fps)
    assert rows(bits) == [(1, 0), (1, 2), (2, 2), (2, 63)]
    act = spark.createDataFrame([(1, 1.0, "a"), (2, 0.0, "b"), (3, 5.0, "b")], "id long, v double, c string")
    p = {r.bit: r for r in models.bit_profile(bits, act, "v").collect()}
    assert p[2].n == 2 and p[2].mean_set == 0.5 and p[2].mean_unset == 5.0
    scores = {(r.id, r.label): r.score for r in models.score_naive_bayes(bits, models.naive_bayes(bits, act, "c")).collect()}
    assert scores[1, "a"] > scores[1, "b"]
    gain = {r.bit: r.gain for r in models.information_content(bits, act, "c").collect()}
    assert math.isclose(gain[0], math.log2(3) - 2 / 3) and gain[2] < gain[0]
    near = spark.createDataFrame([(1, 2, 0.2), (1, 3, 0.4)], "needle long, neighbour long, distance double")
    e = models.evidence(near, act, "v").first()
    assert (e.n, e["mean"], e.closest) == (2, 2.5, 0.0) and math.isclose(e.weighted, 5 * 0.6 / 1.4)


def test_sparse_fingerprints(spark):
    df = spark.createDataFrame([(1, {5: 2, 70: 1}), (2, {5: 1}), (3, {})], "id long, bits map<long,int>")
    assert rows(models.fold_sparse(df, 64)) == [(1, [1 << 5 | 1 << 6, 0]), (2, [1 << 5, 0]), (3, [0, 0])]
    assert rows(models.fold_sparse(df, 64, support=2)) == [(1, [32, 0]), (2, [32, 0]), (3, [0, 0])]
    assert df.select(models.flatten_counts(F.col("bits")).alias("b")).first().b == {5: 1, 70: 1}
    act = spark.createDataFrame([(1, 0.5), (2, 1.0)], "id long, v double")
    assert rows(models.sparse_svm_lite(df, act, "v")) == [(1, "0.5 1:2 2:1"), (2, "1.0 1:1")]
    genes = spark.createDataFrame([(1, "g", 3), (1, "h", -1), (2, "g", 2), (2, "h", 2)], "id long, gene string, rank int")
    assert {(r.needle, r.neighbour): r.score for r in models.rank_association(genes, genes).collect()}[1, 2] == (6 - 2) / 10


def test_molecule_tables(spark):
    df = spark.createDataFrame([("a", "CCO", 1.0), ("b", "OCC", 2.0), ("c", "CCN", 5.0), ("d", "C.CC", 0.0), ("e", "x(", 0.0)], "id string, smiles string, v double")
    assert {r.names for r in molecules.common_names(df, "id").collect()} == {"a:b", "c", "d"}
    assert {r.unique_smiles: (r.n, r.consistent) for r in molecules.activity_consistency(df, "v", 0.5).collect()}["CCO"] == (2, False)
    assert sorted(r.fragment for r in molecules.explode_fragments(df.filter("id = 'd'")).collect()) == ["C", "CC"]
    pairs = rows(molecules.matched_pairs(df, "id", "v"))
    assert any(p[1:3] in {("a", "c"), ("c", "a")} and abs(p[5]) == 4.0 for p in pairs)
    t = molecules.pair_transforms(molecules.matched_pairs(df, "id", "v"))
    assert t.filter("n >= 2").count() >= 1
    assert {r.id: r.violations for r in molecules.rule_of_five(df).collect()} == {"a": 0, "b": 0, "c": 0, "d": 0, "e": None}
    assert [r.id for r in molecules.sort_by_properties(df, ["-natoms"], tie="id").collect()] == ["a", "b", "c", "d", "e"]
