import hashlib

from pestle.llm.exact_dedup import exact_dedup, run_stream, digest_rows
from pestle.llm.common import shared_dir


def brute(rows):
    strip = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for r in rows:
        groups.setdefault(strip(r[1]), []).append(r)
    out = []
    for norm, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1] or ""), r[0] is not None, r[0] or 0))
        for r in g:
            out.append((r[0], keep[0], len(g), r is keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (7, "é 🙂"), (8, "é🙂"), (9, "a b"), (10, "x" * 30000), (11, "x" * 30000 + " "), (12, "A b")] + [(100 + i, "hot text") for i in range(300)]


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(*r, "z", 0, True) for r in ROWS], "doc_id long, text string, digest string, row int, kept boolean")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(df).collect()), key=repr)
    assert got == brute(ROWS)


def test_repeated_and_null_ids_keep_one_row(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c")], "doc_id long, text string")
    got = exact_dedup(df).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 3
    assert {r.keep_id for r in got if r.group_size == 3} == {None}
    assert exact_dedup(df.limit(0)).count() == 0


def test_rows_behind_a_shuffle(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(7).union(spark.createDataFrame([(13, None)], "doc_id long, text string"))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(df).collect()), key=repr)
    assert got == brute([*ROWS, (13, None)])


def test_state_goes_on_where_it_ended(spark):
    base = shared_dir(spark)
    one = digest_rows(spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string"))
    one.write.parquet(f"{base}/in")
    run_stream(spark, f"{base}/in", one.schema, f"{base}/state")
    two = digest_rows(spark.createDataFrame([(1, "ab"), (2, "a b"), (7, "d")], "doc_id long, text string"))
    two.write.mode("append").parquet(f"{base}/in")
    got = {r.keep_id: r["size"] for r in run_stream(spark, f"{base}/in", one.schema, f"{base}/state").collect()}
    assert got == {2: 3, 6: 1, 7: 1}
