from pestle.operators import molecules as m
from pestle.operators import structures as s


def smiles(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, smiles string")


def column(df, name):
    return [r[name] for r in df.sort("id").collect()]


def test_rewritten_structures_stay_the_same(spark):
    df = smiles(spark, "CC(=O)Oc1ccccc1C(=O)O", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "C[N+](C)(C)CC([O-])=O.O", None, "not a molecule")
    again = s.with_random_smiles(df, 3).drop("smiles").withColumnRenamed("random_smiles", "smiles")
    assert column(m.with_canonical(again), "unique_smiles") == column(m.with_canonical(df), "unique_smiles")
    assert column(again, "smiles")[3:] == [None, None]
    assert column(s.with_random_smiles(df, 3), "random_smiles") == column(s.with_random_smiles(df, 3), "random_smiles")


def test_numbers_roots_parts_and_symmetry(spark):
    df = smiles(spark, "CCO", "c1ccccc1O", "C1CC1.[Na+]")
    assert column(s.with_numbered_smiles(df), "numbered_smiles")[0] == "[1CH3][2CH2][3OH]"
    assert [x and x[0] for x in column(s.with_first_atom(df, "[OX2]"), "rooted_smiles")] == ["O", "O", None]
    assert column(m.with_canonical(s.with_subset(df, "a").select("id", s.F.col("subset").alias("smiles"))), "unique_smiles")[1:] == ["c1ccccc1", None]
    assert column(s.with_symmetry(df), "symmetry_classes") == [3, 5, 2]
    assert column(s.with_longest_path(df), "longest_path") == [2, 4, 1]
    assert [x.id for x in s.fragment_filter(df, 1, 3).sort("id").collect()] == [0, 1]


def test_counts_and_look_ups(spark):
    df = smiles(spark, "ClCBr", "[nH]1cccc1", "OCC", "C%12CC%12")
    assert [r.n for r in df.select("id", s.count_atoms(s.F.col("smiles")).alias("n")).sort("id").collect()] == [3, 5, 3, 3]
    assert [r.id for r in s.find_structures(df, smiles(spark, "CCO", "c1cc[nH]c1", "CCO")).sort("id").collect()] == [1, 2]
