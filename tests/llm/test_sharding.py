import zlib

from pestle.llm.sharding import shard_by_bytes


def check(rows, got, shards):
    n = len(rows)
    assert len(got) == n
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    got = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got] == want
    total, at = sum(w[2] for w in want), 0
    sizes = [0] * shards
    for k, r in enumerate(got):
        assert r.start == at and r.shard == min(shards - 1, (2 * at + r["size"]) * shards // (2 * total))
        assert r.slot == k - next(j for j, x in enumerate(got) if x.shard == r.shard)
        at += r["size"]
        sizes[r.shard] += r["size"]
    assert max(sizes) - min(sizes) <= 2 * max(w[2] for w in want)


def test_contiguous_balanced_shards(spark):
    rows = [(i, "é" * (i * 37 % 91)) for i in range(500)] + [(3, "é" * 20)] * 40 + [(None, "x"), (900, None), (901, "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, size int, shard int")
    check(rows, shard_by_bytes(df, 24).collect(), 24)
    check(rows, shard_by_bytes(df, 3).collect(), 3)


def test_edges(spark):
    df = spark.createDataFrame([(1, "x" * 10_000), (2, "y")], "doc_id long, text string")
    assert sorted((r.doc_id, r.shard) for r in shard_by_bytes(df, 24).collect()) == [(1, 11), (2, 23)]
    assert shard_by_bytes(df.limit(0)).count() == 0
