import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pestle.llm.quality import ORDER, WORD, Texts, accepted_rows, classify, count_grams, fold_of, mark_trusted, quality_model, word_starts


def brute_model(texts):
    """Interpolated modified Kneser-Ney by plain dictionaries; returns p(gram)."""
    counts = {ORDER: Counter(), **{k: Counter() for k in range(1, ORDER)}}
    for t in texts:
        b = b"\0" * (ORDER - 1) + t.encode()
        counts[ORDER].update(b[i : i + ORDER] for i in range(len(b) - ORDER + 1))
    for k in range(ORDER - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    d, context = {}, {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d[k] = [0.0]
        for i in (1, 2, 3):
            raw = i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else i / 2
            d[k].append(min(max(raw, i / 20), i))
        context[k] = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            x = context[k][g[:-1]]
            x[0] += v
            x[1] += d[k][min(v, 3)]

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / 256
        if g[:-1] not in context[k]:
            return below
        total, left = context[k][g[:-1]]
        v = counts[k].get(g, 0)
        return (v - d[k][min(v, 3)]) / total + left / total * below

    return p


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["ba", "lo", "mi", "é", "tu", "the"]) for _ in range(rng.randrange(1, 4)))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(5, 60))), "en" if i % 3 else "fr") for i in range(90)]
    docs += [(200 + i, " ".join(rng.choice(["XQ!!", "@@##", "ZZ%%"]) for _ in range(20)), "en") for i in range(5)]
    docs += [(300, None, "en"), (301, "", "en"), (302, "no language", None), (None, "ba lo mi", "en"), (303, "only here", "xx"), (304, "ba" * 40_000, "fr"), (1, "ba lo mi", "en")]
    return docs


def test_probabilities_equal_a_plain_model(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, gram int")
    trusted = spark.createDataFrame([(i,) for i in range(60)] + [(5,), (None,)], "doc_id long")
    held = {r.doc_id for r in df.filter(fold_of("doc_id") == 0).select("doc_id").distinct().collect()}
    assert 0 < len(held) < 60
    model = {(r.lang, r.gram): r.logp for r in quality_model(mark_trusted(df, trusted, "doc_id", "lang"), "text").collect()}
    import pestle.llm.quality as q

    monkeypatch.setattr(q, "FEW_LANGUAGES", 0)
    again = {(r.lang, r.gram): r.logp for r in quality_model(mark_trusted(df, trusted, "doc_id", "lang"), "text").collect()}
    assert again.keys() == model.keys() and all(math.isclose(v, again[k], abs_tol=1e-6) for k, v in model.items())
    for lang in ("en", "fr"):
        p = brute_model([t or "" for i, t, k in docs if i is not None and i < 60 and k == lang and i not in held])
        own = {g: v for (k, g), v in model.items() if k == lang}
        assert len(own) > 100
        for g, v in own.items():
            assert abs(math.log(p(g.to_bytes(ORDER, "big"))) - v) < 1e-4
        for c in list(own)[:20]:  # a context's probabilities sum to one
            ctx = c.to_bytes(ORDER, "big")[:-1]
            assert abs(sum(p(ctx + bytes([b])) for b in range(256)) - 1) < 1e-9


def test_verdicts(spark):
    df = spark.createDataFrame([(*d, 1) for d in corpus()], "doc_id long, text string, lang string, perplexity int")
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    got = classify(df, trusted, 0.0, 1.0).collect()
    held = {r.doc_id for r in df.filter(fold_of("doc_id") == 0).select("doc_id").distinct().collect()}
    assert len(got) == len(corpus())
    by = {r.doc_id: r for r in got if r.doc_id != 1}
    assert not any(by[200 + i].accepted for i in range(5))
    assert all(by[i].accepted for i in range(60) if i != 1 and i in held)
    assert sum(by[i].accepted for i in range(90) if i != 1) >= 80
    assert not by[300].accepted and by[300].perplexity is None and by[301].n_bytes == 0
    assert by[302].lang == "und" and by[302].low is None and by[302].accepted and by[303].accepted
    assert not by[302].judged and by[302].n_trusted == 0 and by[5].judged and by[5].n_trusted == sum(k == "en" for i, t, k in corpus() if i is not None and i < 60)
    assert by[None].accepted is not None
    assert classify(df.limit(0), trusted).count() == 0


def test_blocks_shards_and_joined_ids_change_nothing(spark, monkeypatch):
    """Workers are forked anew for each value; they get it from the plan's closures or from the module."""
    import pestle.llm.quality as q

    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    counts = lambda: sorted(map(tuple, count_grams(mark_trusted(df, trusted, "doc_id", "lang"), "text").collect()))
    verdicts = lambda: sorted((str(r.doc_id), r.n_bytes, round(r.perplexity or 0, 5), r.accepted) for r in classify(df, trusted).collect())
    kept = lambda: sorted((str(r.doc_id), r.text) for r in accepted_rows(df, trusted).collect())
    want = counts(), verdicts(), kept()
    assert [r[:2] for r in want[2]] == sorted((r[0], t) for r in want[1] if r[3] for i, t, _ in corpus() if str(i) == r[0] and len((t or "").encode()) == r[1])
    monkeypatch.setattr(q, "BROADCAST_IDS", 3)
    monkeypatch.setattr(q, "SHARD_GRAMS", 300)
    monkeypatch.setattr(q, "LEAST_SHARD", 100)
    assert (counts(), verdicts(), kept()) == want


def test_blocks_and_pieces_of_any_size():
    import pestle.llm.quality as q

    texts = pa.array(["", "abc  def", None, "é" * 50 + " x", "a", "longwordlongwordlongwordlongwordlongwordlongword " * 3, ""])
    raw = [(t or "").encode() for t in texts.to_pylist()]
    want = [int.from_bytes((b"\0" * (ORDER - 1) + t)[i : i + ORDER], "big") for t in raw for i in range(len(t))]
    old = q.PIECE, q.BLOCK_BYTES, q.HELD_BYTES
    try:
        for q.PIECE in (1, 2, 3, 7, 1000):
            assert [int(g) for _, p in Texts(texts).pieces() for g in p] == want
            assert [int(g) for _, p in Texts(texts.slice(3, 3)).pieces() for g in p] == [int.from_bytes((b"\0" * (ORDER - 1) + t)[i : i + ORDER], "big") for t in raw[3:6] for i in range(len(t))]
        row = pa.StructArray.from_arrays([texts, pa.array(range(7))], ["text", "id"])
        batch = pa.RecordBatch.from_arrays([row, pa.array(["x", "y"] * 3 + ["x"]), pa.array([0, 1, 0, 1, 2, 0, 0], pa.int32()), pa.array([True] * 7)], names=["row", "lang", "fold", "trusted"])
        for q.BLOCK_BYTES, q.HELD_BYTES in ((1, 1), (20, 30), (1 << 20, 40), (1 << 20, 1 << 20)):
            got = [(lang, fold, r["id"], r["text"]) for lang, fold, b, _ in q.blocks_of(iter([batch, batch.slice(0, 0), batch]), "text") for r in b.column(0).to_pylist()]
            assert sorted(got, key=str) == sorted(2 * [(lang, f, i, t) for i, (lang, f, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts.to_pylist()))], key=str)
    finally:
        q.PIECE, q.BLOCK_BYTES, q.HELD_BYTES = old


def test_words_start_after_white_space_and_every_so_many_bytes():
    raw = b"ab  cd" + b"x" * 100 + b" y" + b"z" * 64
    starts = np.array([0, 0, 6, 106, len(raw), len(raw)])
    want, last = [], None
    for i in range(len(raw)):
        if i in (0, 6, 106) or raw[i - 1] <= 32 or i - last == WORD:
            want.append(i)
            last = i
    assert word_starts(np.frombuffer(raw, np.uint8), starts).tolist() == want


def test_rows_keep_their_scores_when_the_table_is_read_in_another_order(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")

    def anew(batches):  # another order whenever the plan is computed
        for b in batches:
            yield b.take(np.random.default_rng().permutation(b.num_rows))

    verdicts = lambda d: sorted((str(r.doc_id), r.n_bytes, round(r.perplexity or 0, 4), r.accepted) for r in classify(d, trusted).collect())
    assert verdicts(df.mapInArrow(anew, df.schema)) == verdicts(df)


def test_clashing_names_and_whole_rows(spark):
    names = ["row", "lang", "fold", "trusted", "bytes", "logp", "word", "block", "shard", "perplexity", "own", "low", "accepted"]
    docs = [(i, t, k, *range(len(names) - 1)) for i, t, k in corpus()]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, " + ", ".join(f"{c} int" for c in names if c != "lang"))
    got = accepted_rows(df, spark.createDataFrame([(i,) for i in range(60)], "doc_id long"), 0.0, 1.0)
    assert got.columns == df.columns
    rows = {tuple(r) for r in got.collect()}
    assert rows and rows <= set(docs)


def test_a_very_long_text(spark):
    long = " ".join(corpus()[i % 60][1] for i in range(1500))
    assert len(long) > 200_000
    df = spark.createDataFrame([*corpus(), (400, long, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in classify(df, spark.createDataFrame([(i,) for i in range(60)], "doc_id long"), 0.0, 1.0).collect()}
    assert got[400].n_bytes == len(long.encode()) and 1 < got[400].perplexity < 20


def test_limits_are_quantiles_of_trusted_texts_at_any_size(spark):
    docs = [d for d in corpus() if d[0] is not None and d[0] not in (1, 300, 301)]
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    for some in (docs, [d for d in docs if d[0] % 4 == 0]):
        got = classify(spark.createDataFrame(some, "doc_id long, text string, lang string"), trusted, 0.0, 1.0).collect()
        for lang in ("en", "fr"):
            own = [r for r in got if r.lang == lang]
            scores = [r.perplexity for r in own if r.doc_id < 60]
            assert {(r.low, r.high) for r in own} == {(min(scores), max(scores))}


def test_no_trusted_text_is_scored_by_a_model_that_has_seen_it(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in classify(df, spark.createDataFrame([(i,) for i in range(60)], "doc_id long")).collect()}
    fold = {r.doc_id: r.f for r in df.select("doc_id", fold_of("doc_id").alias("f")).distinct().collect()}
    text = {i: (t, k) for i, t, k in corpus() if i is not None and i < 60 and i != 1}
    for f in range(5):
        p = brute_model([t for i, t, k in corpus() if i is not None and i < 60 and k == "en" and fold[i] != f])
        for i in [i for i in text if fold[i] == f and text[i][1] == "en"][:3]:
            b = b"\0" * (ORDER - 1) + text[i][0].encode()
            mean = sum(math.log(p(b[j : j + ORDER])) for j in range(len(b) - ORDER + 1)) / (len(b) - ORDER + 1)
            assert math.isclose(got[i].perplexity, math.exp(-mean), rel_tol=1e-4)


def test_a_few_bad_words_and_repeated_stretches_are_seen_in_a_long_text(spark):
    rng = random.Random(9)
    words = [w for i, t, k in corpus() if i is not None and i < 60 and k == "en" for w in (t or "").split()]
    fine = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(3)]
    docs = [*corpus(), (400, fine[0] + " QX@#ZK@ " + fine[1], "en"), (401, fine[0] + " " + "the " * 200 + fine[1], "en"), (402, fine[2], "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in [*range(60), 402]], "doc_id long")
    got = {r.doc_id: r for r in classify(df, trusted, 0.0, 1.0).collect()}
    assert all(got[i].low <= got[i].perplexity <= got[i].high for i in (400, 401, 402))
    assert [got[i].accepted for i in (400, 401, 402)] == [False, False, True]


def test_limits_do_not_depend_on_the_order_of_rows(spark):
    from pestle.llm.quality import limits_of

    rng = random.Random(1)
    rows = [("en", True, 10, -10 * rng.uniform(0.5, 2), rng.uniform(0, 9), rng.uniform(-3, 0), rng.uniform(0, 9)) for _ in range(3000)] + [("fr", True, 5, -7.0, 1.0, 1.0, None), ("de", False, 5, -7.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "lang string, trusted boolean, bytes long, logp double, word double, dull double, odd double")
    one, two = (sorted(limits_of(d, 0.01, 0.99).collect(), key=lambda r: r.own) for d in (df.coalesce(1), df.orderBy("word").repartition(5)))
    assert one == two and [(r.own, r.n_trusted) for r in one] == [("en", 3000), ("fr", 1)] and one[1].odd_high is None
    word = sorted(r[4] for r in rows[:3000])
    assert word[2969] <= one[0].word_high < word[2969] + 1 / 4096
