import random
import struct

from pestle.llm.bpe import FOREIGN, WordBpe, bpe_encode, default_path
from tokenizers import Tokenizer

SPEC = open(default_path(), encoding="utf-8").read()
LIB = Tokenizer.from_str(SPEC)

TEXTS = [
    "", " \t\n ", "Hello, World! it's 42 o'clock''s", "a<|endoftext|>B <|startoftext|>", "İstanbul ΑΣ ΣΑΣ é é ﬁ", "日本語テキスト 中文", "🙂🙂 👨‍👩‍👧 x",
    "%%% &&& *** $$$ !!", "١٢٣ Ⅷ ½", "a b c​d", "x" * 5000, "ab" * 3001, "".join(random.Random(3).choice("aeinrst") for _ in range(20000)),
    "".join(random.Random(4).choice("!?.,-=") for _ in range(3000)), "".join(chr(random.Random(5).choice([0xE9, 0x4E2D, 0x61, 0x1F642])) for _ in range(2000)), "\x00\x1f\x85",
]


def library(text):
    e = LIB.encode(text, add_special_tokens=False)
    return struct.pack(f"<{len(e.ids)}I", *e.ids), LIB.decode(e.ids, skip_special_tokens=False)


def test_equals_library():
    bpe = WordBpe(SPEC)
    rng = random.Random(1)
    alphabet = "abcdefghijklmnopqrstuvwxyz ABCé'’0123456789.,!-\n\tßü中🙂"
    for t in TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(300)]:
        assert bpe.encode(t) == library(t), t[:80]


def test_tree_equals_whole_for_any_leaf():
    rng = random.Random(2)
    whole = WordBpe(SPEC, leaf=1 << 30)
    for leaf in (1, 2, 3, 7, 32):
        bpe = WordBpe(SPEC, leaf=leaf, window=1)
        for _ in range(60):
            w = "".join(rng.choice("aabeilnorst") for _ in range(rng.randrange(1, 300)))
            assert bpe.piece(w) == whole.piece(w), w


def test_every_code_point_and_every_pair_that_python_handles():
    bpe = WordBpe(SPEC)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4000):
        t = " ".join(f"{c}a{c}É1{c}!{c}" for c in points[at : at + 4000])
        if bpe.encode(t) != library(t):
            assert [hex(ord(c)) for c in points[at : at + 4000] if bpe.encode(f"{c}a{c}É1{c}!{c}") != library(f"{c}a{c}É1{c}!{c}")] == []
    plain = [c for c in points if not FOREIGN.search(c)]
    assert 600 < len(plain) < 1000
    for c in plain:
        t = " ".join(f"{c}{d}" for d in plain) + f" {c}" * 3
        assert bpe.encode(t) == library(t), hex(ord(c))


def test_what_is_remembered_is_bounded():
    bpe = WordBpe(SPEC)
    bpe.known.most = 50_000
    for i in range(2000):
        bpe.encode(f"word{i} again")
        assert bpe.known.held <= 51_000 and len(bpe.known) <= 200
    bpe.known.clear()
    assert bpe.known.held == 0 and bpe.encode("again") == library("again")


def test_long_texts_are_cut_and_joined(spark, monkeypatch):
    import pestle.llm.bpe as b

    monkeypatch.setattr(b, "STRETCH", 64)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, "Zé" * 700 + " end " + "x1!" * 200), (101, None), (None, "a b " * 300)]
    bpe = WordBpe(SPEC)
    assert all(len(x) <= 64 + 64 // 4 for t in TEXTS for _, _, _, x in bpe.stretches(t) if x not in bpe.added)
    got = bpe_encode(spark.createDataFrame(rows, "doc_id long, text string"), long=10).collect()
    assert sorted((r.doc_id or -1, bytes(r.ids), r.decoded) for r in got) == sorted((i or -1, *library(t or "")) for i, t in rows)


def test_long_texts_are_normalised_once(spark, monkeypatch):
    import pestle.llm.bpe as b

    monkeypatch.setattr(b, "STRETCH", 64)
    cases = ["a <|ENDOFTEXT|> b", "<|StartOfText|>", "a<|endoftext|>B <|ENDOFTEXT|>", "H\u0331 T\u0308 J\u030c W\u030a", "\x1cH\u0331 Σ\x1d <|ENDOFTEXT|>"]
    rows = [(i, (t + " ") * 40) for i, t in enumerate(cases)]
    got = bpe_encode(spark.createDataFrame(rows, "doc_id long, text string"), long=10).collect()
    assert sorted((r.doc_id, bytes(r.ids), r.decoded) for r in got) == [(i, *library(t)) for i, t in rows]


def test_frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "x"), (0, TEXTS[2], "y")]
    got = bpe_encode(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, bytes(r.ids), r.decoded) for r in got) == sorted((i or -1, *library(t or "")) for i, t, _ in rows)
    assert bpe_encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
