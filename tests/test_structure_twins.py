"""The queries over made structures equal their SQL for every structure that a key can stand for."""

import duckdb
import pytest
from pestle.operators import molecules as m
from pestle.operators import structures as s
from pestle.plans import load


def test_matches_without_overlap(spark):
    df = spark.createDataFrame([(0, "OC(=O)O"), (1, "OC(=O)CC(=O)O"), (2, "OCO")], "id long, smiles string")
    acid = {"acids": "[CX3](=O)[OX2H]"}
    counts = lambda **k: [r.acids for r in m.substructure_counts(df, acid, **k).sort("id").collect()]
    assert counts() == [2, 2, 0] and counts(overlap=False) == [1, 2, 0]
    assert [r.subset is not None and r.subset.count("O") for r in s.with_subset(df, acid["acids"], overlap=False).sort("id").collect()] == [2, 4, False]


@pytest.mark.parametrize("name", ["e_many_substructure", "e_subset"])
def test_equal_to_sql_for_all_structures(spark, tmp_path, name):
    # 4900 keys in a row hold every structure; key 3920 is carbonic acid
    spark.range(3900, 8800).selectExpr("id AS p_partkey", "CAST(id AS string) AS p_name").coalesce(2).write.parquet(str(tmp_path / "part.parquet"))
    registry = load()
    got = sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.ORACLES[name]).fetchall())
