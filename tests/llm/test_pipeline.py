import corpus_pipeline as cp
from pestle.llm.bpe import WordBpe, default_path
from pestle.llm.exact_dedup import exact_dedup


def test_stages_on_a_small_corpus(spark, tmp_path):
    good = [" ".join(f"w{i * 7 % 50 + j * k % 13}a" for j in range(40)) for i, k in enumerate(range(1, 31))]
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    docs += [(100, good[3] + "  ", "en", "s", 1), (101, good[4].replace("w", "w", 1) + " tail", "en", "s", 1)]
    docs += [(102, good[5] + " " + leak + " " + good[6], "en", "s", 1), (103, None, "en", "s", 0), (104, "§§§ %%% " * 30, "en", "s", 1), (None, good[7] + " w1a w2a w3a", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "n_chars AS row", "lang AS trusted", "true AS kept").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(102, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    early = exact_dedup(table)
    at, kept = table, []
    for _, stage in cp.STAGES[:-1]:
        at = cp.written(stage(spark, at, str(tmp_path)), keep=True)
        assert at.columns == table.columns
        kept.append({r.doc_id for r in at.collect()})
    whole = {*range(30), 100, 101, 102, None}
    # Junk and empty texts go; of 3 and its copy 100 the longer one stays; 101 is a near copy of 4; 102 holds a benchmark item.
    assert kept == [whole, whole - {3}, whole - {3, 101}, whole - {3, 101, 102}]
    # Tables of other queries are not the pipeline's to delete.
    assert early.filter("kept").count() == len(docs) - 1
    out = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert set(out) == kept[3]
    bpe = WordBpe(open(default_path(), encoding="utf-8").read())
    for i, r in out.items():
        if i is not None and i < 30:
            assert bytes(r.ids) == bpe.encode(good[i])[0] and r.n_tokens == len(r.ids) // 4


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
