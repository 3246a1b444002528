import time

import pytest
from pestle.sources import files as f
from pestle.streaming import records as r
from pyspark.sql import functions as F


def test_smiles_and_descriptors(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CCO ethanol x y\n\nC methane\nCC\n")
    assert sorted(map(tuple, f.read_smiles(spark, f"{tmp_path}/a.smi").collect()), key=str) == [("C", "methane", None), ("CC", None, None), ("CCO", "ethanol", "x y")]
    f.write_smiles(f.read_smiles(spark, f"{tmp_path}/a.smi").dropna(subset=["id"]), f"{tmp_path}/out.smi")
    assert f.read_smiles(spark, f"{tmp_path}/out.smi").count() == 2
    (tmp_path / "d.dat").write_text("Name a b\nx 1 .\ny 2.5 3\n")
    d = f.read_descriptors(spark, f"{tmp_path}/d.dat")
    assert sorted(map(tuple, d.collect())) == [("x", 1.0, None), ("y", 2.5, 3.0)]
    f.write_descriptors(d, f"{tmp_path}/e.dat")
    assert sorted(map(tuple, f.read_descriptors(spark, f"{tmp_path}/e.dat").collect())) == [("x", 1.0, None), ("y", 2.5, 3.0)]


def test_tdt(spark, tmp_path):
    text = "$SMI<CCO>\nPCN<ethanol>\nNC<1>\nNC<2>\n|\n$SMI<C>\nbroken\nPCN<methane>\n|\n"
    (tmp_path / "a.tdt").write_text(text)
    t = f.read_tdt(spark, f"{tmp_path}/a.tdt")
    rows = t.select(f.tag("$SMI").alias("s"), f.tag("PCN").alias("p"), f.tag("NC", 2).alias("n")).collect()
    assert sorted(map(tuple, rows)) == [("C", "methane", None), ("CCO", "ethanol", "2")]
    assert [x.line for x in f.invalid_tdt(spark, f"{tmp_path}/a.tdt").collect()] == ["broken"]
    f.write_tdt(t.withColumn("tags", f.with_tag("NEW", F.lit("7"))), f"{tmp_path}/b.tdt")
    assert f.read_tdt(spark, f"{tmp_path}/b.tdt").filter(f.tag("NEW") == "7").count() == 2


def test_sdf(spark, tmp_path):
    block = "mol{0}\n  x\n\n  1  0  0\n    0.0 0.0 0.0 C\nM  END\n>  <ID>\n{0}\n\n> <note> (1)\ntwo\nlines\n\n$$$$\n"
    (tmp_path / "a.sdf").write_text("".join(block.format(i) for i in range(3)))
    rows = sorted(f.read_sdf(spark, f"{tmp_path}/a.sdf").collect(), key=lambda x: x.title)
    assert [x.title for x in rows] == ["mol0", "mol1", "mol2"] and rows[1].tags == {"ID": "1", "note": "two\nlines"} and rows[0].ctab.endswith("M  END")


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [(i, i % 3, f"2024-01-01 00:{i:02d}:00", float(i)) for i in range(30)]
    src = f"{tmp_path}/in"
    spark.createDataFrame(rows, "id long, k long, t string, v double").withColumn("t", F.to_timestamp("t")).repartition(2).write.parquet(src)
    stream = lambda: spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    assert len(drain(r.distinct_stream(stream(), ["k"]), "distinct_k")) == 3
    means = {(x.k, x.id): x["mean"] for x in drain(r.latest_means(stream(), "k", "id", "v", 3), "means")}
    assert len(means) == 30 and means[0, 27] == (27 + 24 + 21) / 3 and means[1, 1] == 1.0
    assert sum(x.n for x in drain(r.windowed_counts(stream(), "t", "1 minute", "10 minutes", ["k"]), "counts", "complete")) == 30


def test_streamed_haystack(spark, tmp_path):
    from pestle.operators.similarity import nearest

    hay = spark.createDataFrame([(i, [i * 2654435761 % 2**32]) for i in range(60)], "id long, fp array<long>")
    needles = hay.filter("id % 20 = 0")
    for k in range(3):
        hay.filter(f"id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/hay")
        time.sleep(0.05)
    s = spark.readStream.schema(hay.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/hay")
    q = s.writeStream.foreachBatch(r.nearest_of_stream(needles, f"{tmp_path}/out", 4)).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/2").collect()))
    assert got == sorted(map(tuple, nearest(needles, hay, 4, same_id=True).collect()))


@pytest.mark.parametrize("n", [7])
def test_split_files(spark, tmp_path, n):
    f.split_files(spark.range(20).coalesce(1), f"{tmp_path}/parts", n)
    assert len(list((tmp_path / "parts").glob("*.parquet"))) == 3
