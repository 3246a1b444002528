import random
import re

from pestle.llm.decontaminate import build_index, decontaminate, term_counts

LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, size=10):
    out = []
    for i, text, *_ in docs:
        w, hit, found = tokens(text), set(), set()
        for item, t in items:
            b = tokens(t)
            for x in [b] if 0 < len(b) < size else [b[k : k + size] for k in range(len(b) - size + 1)]:
                for p in range(len(w) - len(x) + 1) if x else ():
                    if w[p : p + len(x)] == x:
                        hit.update(range(p, p + len(x)))
                        found.add("" if item is None else str(item))
        out.append((i if i is not None else -1, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def fixture():
    rng = random.Random(7)
    vocab = ["the", "of", "é", "Ünï", "a1", "x", "y", "中文", "to", "be"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 12, 40]))) for i in range(12)] + [(100, ""), (101, None), (None, "q w e"), (5, "The repeated ITEM id"), (102, "the, the; the the the the the the the the the")]
    docs = [(i, text(rng.randrange(60))) for i in range(60)]
    docs += [(100 + k, f"{text(5)} {rng.choice(items)[1] or ''}! {text(4)}") for k in range(60)]
    docs += [(300, None), (301, ""), (302, " the" * 400), (None, items[4][1]), (303, items[4][1]), (303, items[4][1]), (304, "Q-w\ne " * 50)]
    return docs, items


def rows(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=repr)


def test_equals_brute_force_in_one_and_many_passes(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id int, text string, row int")
    want = brute(docs, items)
    for limit in (200_000, 40, 7):
        out = decontaminate(d, b, pass_windows=limit)
        assert rows(out) == want, limit
        for r in out.collect():
            assert r.n_hit == sum(s.end - s.start for s in r.spans) and set(r["items"]) <= set(r.near_items)


def test_all_words_indexed_by_their_hashes_change_nothing(spark, monkeypatch):
    import pestle.llm.decontaminate as m

    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id int, text string")
    every = lambda: sorted((str(r.doc_id), r.n_words, str(r["items"]), str(r.near_items), str(r.spans)) for r in decontaminate(d, b, pass_windows=40).collect())
    want = every()
    monkeypatch.setattr(m, "VOCABULARY", 3)
    assert every() == want and rows(decontaminate(d, b)) == brute(docs, items)


def test_very_long_text_and_other_ids(spark):
    item = " ".join(f"w{i}" for i in range(30))
    long = ("filler words here " * 150_000) + item + " more" * 10
    d = spark.createDataFrame([("a", long), ("b", "filler words"), (None, item)], "doc_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, [(s.start, s.end) for s in r.spans]) for r in decontaminate(d, spark.createDataFrame([("i", item)], "item_id string, text string")).collect()}
    assert got == {"a": (450_040, 30, [(450_000, 450_030)]), "b": (2, 0, []), None: (30, 30, [(0, 30)])}
    dates = decontaminate(d.selectExpr("date'2020-01-01' AS doc_id", "text"), spark.createDataFrame([("i", item)], "item_id string, text string"))
    assert [str(r.doc_id) for r in dates.collect()] == ["2020-01-01"] * 3


def test_proximity(spark):
    d = spark.createDataFrame([(1, "red blue green one two three four five six seven"), (2, "red blue or green one two three four five six seven"), (3, "seven and then red")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "red blue green one two three four five six seven")], "item_id long, text string")
    assert {r.doc_id: (r.n_hit, r.near_items) for r in decontaminate(d, b).collect()} == {1: (10, ["9"]), 2: (0, ["9"]), 3: (0, [])}


def test_empty_and_index(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontaminate(d, b)) == [(1, 3, 0, []), (2, 0, 0, [])]
    assert decontaminate(d.limit(0), b).count() == 0
    from pestle.llm.common import shared_dir

    index = build_index(d, None, f"{shared_dir(spark)}/all")
    assert sorted(r.n for r in term_counts(index).collect()) == [1, 2]


def test_proximity_at_the_border_of_a_document():
    import numpy as np
    from pestle.llm.decontaminate import Matcher

    # Term 2 ends the first document, just where it is wanted for the second one, which has it one word later.
    texts = [[3, 2], [1, 2, 3], [2, 1], [2, 3]]
    flat = np.concatenate(texts)
    terms = np.unique(flat)
    positions = np.concatenate([np.flatnonzero(flat == t) for t in terms])
    offsets = np.concatenate([[0], np.cumsum([(flat == t).sum() for t in terms])])
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for window, want in (((2, 1), [1, 2]), ((1, 2), [1, 2])):
        _, near = Matcher([window], {1: 1, 2: 5}).search(terms, offsets, positions, starts)
        assert [d.tolist() for _, d in near] == [want]
