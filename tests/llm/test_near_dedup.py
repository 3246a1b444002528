import random
import re

import numpy as np
from pestle.llm.components import components
from pestle.llm.near_dedup import MinHasher, Shingler, near_dedup

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, size):
    sets = [shingle_set(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        least[top(i)] = min(least.get(top(i), k), k)
    return sorted((k, len(sets[i]), least[top(i)], k == least[top(i)]) for i, (k, _) in enumerate(docs))


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "É", "中"] * 30
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs = []
    for _ in range(25):
        base = text(rng.choice([3, 8, 20, 60, 150]))
        for _ in range(rng.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 16))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w))
    chain = text(100)  # a chain whose ends are not alike
    for k in range(20):
        chain = chain[:k * 4] + text(4) + chain[k * 4 + 4 :]
        docs.append(" ".join(chain))
    docs += ["", " \n\t", None, "one", "ONE", "one\n", "one two", "One\x0btwo", "a b a b a b", "a b a b"]
    rng.shuffle(docs)
    return list(enumerate(docs))


def rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_equals_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, digest string, row int")
    for size in (2, 5):
        assert rows(near_dedup(df, size=size)) == brute(docs, size)


def test_two_families_and_small_blocks_lose_no_link(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for k in range(150):  # two families that share buckets
        w = list(base)
        if k % 2:
            w[:6] = [f"q{i}" for i in range(6)]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"z{rng.randrange(1000)}"
        docs.append((k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 2)
    assert rows(near_dedup(df, size=2)) == want
    import pestle.llm.near_dedup as nd

    monkeypatch.setattr(nd, "BLOCK", 8)
    assert rows(near_dedup(df, size=2)) == want


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, None), (None, None), (3, "word " * 30000)], "doc_id long, text string")
    got = near_dedup(df).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (0, 1, 4, False), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 4, False), (4, 1, 4, True)]
    assert near_dedup(df.limit(0)).count() == 0


def test_estimates():
    s, h = Shingler(1), MinHasher()
    a = s(" ".join(f"x{i}" for i in range(1000)))
    b = s(" ".join(f"x{i}" for i in range(200, 1200)))
    assert abs(np.mean(h.signature(a) == h.signature(b)) - 800 / 1200) < 0.1


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (7000, 7000)]
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for u, v in edges:
        if u != v:
            a, b = top(u), top(v)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: top(n) for n in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
