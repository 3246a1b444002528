import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pestle.llm.pii import KINDS, find_spans, pii_spans, redact


def brute(text):
    """The base kinds by plain regular expressions."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def base(text):
    return [s for s in find_spans(text) if s[0] in ("email", "ip", "card", "phone")]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.@-+_% 0123459()\né٣", max_size=60))
def test_base_kinds_equal_plain_patterns(text):
    assert base(text) == brute(text)


def test_examples():
    for t in ["a.b+c@d.e.f, x@y z@w.q", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.03.4 0000000255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (017) 555-7713 +12 +1+2 +1 23456789 ", "🙂 me@x.org " * 50]:
        assert base(t) == brute(t)
    rng = random.Random(0)
    for _ in range(500):
        t = "".join(rng.choice("01234567890 .-+@ab") for _ in range(rng.randrange(200)))
        assert base(t) == brute(t)


def test_long_runs_stay_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1.1." * 60_000, "+1 " * 60_000):
        find_spans(t)


def test_cues():
    kinds = lambda t: [(k, t[s:e]) for k, s, e in find_spans(t) if k in ("url", "iban", "account", "ssn", "secret")]
    assert kinds("see https://ex.org/a?b=1, or http://nohost") == [("url", "https://ex.org/a?b=1")]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 end") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN DE89 3704 0044 0532 0130 01") == []
    assert kinds("account no. 12345678; discount 12345678") == [("account", "12345678")]
    assert kinds("ssn 123-45-6789, ssn 000-45-6789") == [("ssn", "123-45-6789")]
    assert kinds('token = "04dbebab91ab33eeaaf9" x') == [("secret", "04dbebab91ab33eeaaf9")]


def test_frame(spark):
    df = spark.createDataFrame([(1, "me@x.org", "a"), (2, None, "b"), (None, "", "c"), (1, "me@x.org", "a")], "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, [tuple(s) for s in r.spans]) for r in pii_spans(df).collect())
    assert got == [(0, []), (1, [("email", 0, 8)]), (1, [("email", 0, 8)]), (2, [])]
    assert sorted(r.text for r in redact(df).collect()) == ["", "", "[EMAIL]", "[EMAIL]"]
    assert pii_spans(df.limit(0)).count() == 0


def test_query_counts_every_kind(spark, tmp_path):
    from pestle.llm.queries import op3_pii

    texts = ["me@x.org 1.2.3.4 token=04dbebab91ab33eeaaf9", "ssn 123-45-6789 and https://ex.org/a, IBAN: DE89 3704 0044 0532 0130 00", None, "", "plain words", "x " * 200_000 + "account no. 12345678"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op3_pii(spark, str(tmp_path)).collect():
        spans = find_spans(texts[r.doc_id] or "")
        assert r.n_spans == len(spans) and r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert {k: r[f"n_{k}"] for k in KINDS} == {k: sum(s[0] == k for s in spans) for k in KINDS}
