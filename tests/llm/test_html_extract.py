import random
import re

import numpy as np
import pytest
from pestle.llm.boosting import Boosted
from pestle.llm.dom import features, finished, parse
from pestle.llm.html_extract import DROP, KEEP, MIXED, decode, default_model, extract_all, extract_text, node_classes, training_page


def words(t):
    return re.findall(r"\w+", t)


def overlap(got, want):
    from collections import Counter

    a, b = Counter(words(got)), Counter(words(want))
    common = sum((a & b).values())
    return common / max(1, sum(a.values())), common / max(1, sum(b.values()))


def test_held_out_layouts():
    rng = random.Random(999)
    precision, recall = [], []
    for _ in range(300):
        html = training_page(rng)
        page = finished(parse(html, labels=True))
        want = " ".join(t for (node, t, _), c in ((r, node_classes(page)[r[0]]) for r in page.runs) if c == KEEP)
        p, r = overlap(extract_all([re.sub(r' data-y="."', "", html)], default_model())[0], want)
        precision.append(p)
        recall.append(r)
    assert np.mean(precision) > 0.97 and np.mean(recall) > 0.97, (np.mean(precision), np.mean(recall))


PAGE = """<!DOCTYPE html><html><head><title>Ti</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<div class="cookie-notice"><p>We use cookies to make this site better for you.</p><button>OK</button></div>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></ul></nav><!-- ad --><div class="ad">Buy this now, it is cheap and good.</div>
<article><h1>The title</h1><p><b>First &amp; foremost   text, with
a line end.<br><p>Second one, which is a bit longer &copy; and &#233; and &lt;tag&gt;.</p><ul><li>One item here.</li><li>Two</ul></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=x>Other story</a></li></ul></aside>
<div id="comments"><div class="comment"><p>What a lovely article, I agree with all of it.</p></div></div>
<form action="/s"><label>Search</label><input name=q></form><footer>&copy; Someone &middot; All rights reserved. Somewhere.</footer></body></html>"""


def test_example():
    want = "The title\n\nFirst & foremost text, with a line end.\n\nSecond one, which is a bit longer © and é and <tag>.\n\nOne item here.\n\nTwo"
    assert extract_all([PAGE], default_model()) == [want]


def test_decoding_has_no_contradictions():
    rng = np.random.default_rng(0)
    page = finished(parse(PAGE))
    _, (size,) = features([page])
    for _ in range(200):
        log_p = np.log(rng.dirichlet([1, 1, 1], len(size)))
        kept = decode(page, log_p, size)
        # every pair of runs below a node that is not free agrees: compare with exhaustive search on small trees
        assert len(kept) == len(page.tag)
    tree = finished(parse("<div>x<p>a</p><section><p>b</p><p>c</p></section></div>"))
    _, (size,) = features([tree])
    n = len(tree.tag)
    for seed in range(60):
        log_p = np.log(np.random.default_rng(seed).dirichlet([1, 1, 1], n))
        best, choice = -1e9, None
        for code in range(3**n):
            s = [code // 3**i % 3 for i in range(n)]
            leaf = [i not in tree.parent for i in range(n)]
            if any(s[i] == MIXED and leaf[i] for i in range(n)) or any(s[tree.parent[i]] != MIXED and s[i] != s[tree.parent[i]] for i in range(1, n)):
                continue
            v = sum(log_p[i, s[i]] for i in range(n) if size[i] > 0)
            if v > best:
                best, choice = v, s
        assert decode(tree, log_p, size) == [c == KEEP for c in choice]


@pytest.mark.parametrize("html", ["", "plain text", "<", "<<<>>>", "<p", "<a href='", "</p></p>", "<script>", "<!--", "<div>" * 3000, "&#xFFFFFFF; &bogus; &amp", "<td><li><p><b>", "x" * 100_000, "<p>é" * 5000, "<table><tr><td>a<tr><td>b</table>"])
def test_any_string_parses(html):
    assert isinstance(extract_all([html], default_model())[0], str)


def test_parse_rules():
    runs = lambda h: [t for _, t, _ in finished(parse(h)).runs]
    assert runs("<p>a<p>b<div>c</div>d") == ["a", "b", "c", "d"]
    assert runs("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert runs("x <b>y</b><i>z</i>\n w<script>no</script>v<style>no</style><!-- no -->u") == ["x yz wvu"]
    assert runs("<p>a &amp;&nbsp; b</p><title>no</title><textarea>no</textarea>") == ["a & b"]


P = [f"This is sentence number {i} of the article, which goes on for a while, as articles do." for i in range(6)]
SHELL = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><article><h1>Title</h1>%s</article><footer>&copy; Someone, all rights reserved.</footer></body></html>"


@pytest.mark.parametrize(
    "inside, want",
    [
        (f"<p>{P[0]} İ</p><SCRIPT>x('</p>')</SCRIPT><p>{P[1]}</p><script>1</ſcript></sCript >", [P[0] + " İ", P[1]]),
        (f"<p>{P[0]}</p><!-- a --!><p>{P[1]}</p><!--><p>{P[2]}</p><!---><p>{P[3]}</p><!-- -- > --><p>{P[4]}</p>", P[:5]),
        (f"<p>{P[0]} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><p>{P[1]} <object>seen</object> <canvas>drawn</canvas></p><noscript><p>{P[2]}</p></noscript>", [P[0] + " x=1 holds", P[1] + " seen drawn", P[2]]),
        (f"<p>{P[0]} ab\u200bcd \ufeffx a&nbsp;&#160;b\t\n c</p><p>{P[1]}</p>", [P[0] + " ab\u200bcd \ufeffx a b c", P[1]]),
        (f"<p>{P[0]}</p><select><option>Red<option>Green<p>{P[1]}</p><p>{P[2]}</p>", [P[0], P[1], P[2]]),
        (f"<p>{P[0]}</p><button>Okay<p>{P[1]}</p><template><p>never shown</p></template><p>{P[2]}</p>", [P[0], P[1], P[2]]),
        (f"<p>{P[0]}</p><video><source src=x><p>{P[1]}</p><svg><title>no</title><path d='x'/></svg><p>{P[2]}</p>", [P[0], P[1], P[2]]),
        ("".join(f"<p>{x}" for x in P) + f"<div class=ad>Buy this now, it is cheap.</div><p>{P[0]}</p>", [*P, P[0]]),
    ],
)
def test_golden_pages(html_model, inside, want):
    assert extract_all([SHELL % inside], html_model) == ["\n\n".join(["Title", *want])]


@pytest.fixture(scope="module")
def html_model():
    return default_model()


def test_very_long_and_very_deep_pages(html_model):
    long = [f"{x} {i}" for i in range(4000) for x in P]
    assert extract_all([SHELL % "".join(f"<p>{x}</p>" for x in long)], html_model) == ["\n\n".join(["Title", *long])]
    deep = SHELL % ("<div>" * 30_000 + "</x>" * 30_000 + "<li>" * 2000)
    assert isinstance(extract_all([deep], html_model)[0], str)


def test_query_equals_pages_one_by_one(spark, tmp_path, html_model):
    from pestle.llm.queries import op10_html_text

    rng = random.Random(5)
    rows = [(i, f"u{i % 7}", training_page(rng) if i % 10 else [None, "", SHELL % f"<p>{P[0]}</p>"][i % 3]) for i in range(200)]
    rows += [rows[3], (None, None, rows[4][2])]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    want = [(i, u, t := extract_all([h or ""], html_model)[0], len(t)) for i, u, h in rows]
    assert sorted(map(tuple, op10_html_text(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_boosting_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = np.where(x[:, 0] * x[:, 1] > 0, 0, np.where(x[:, 2] > 0, 1, 2))
    m = Boosted(3).fit(x[:2000], y[:2000])
    assert (m.log_probability(x[2000:]).argmax(axis=1) == y[2000:]).mean() > 0.9
    assert DROP == 1


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (None, None, None, "t"), (1, "u", "", "t")], "page_id long, url string, html string, text string")
    got = extract_text(df).collect()
    assert sorted(len(r.text) > 0 for r in got) == [False, False, True]
    assert extract_text(df.limit(0)).count() == 0
