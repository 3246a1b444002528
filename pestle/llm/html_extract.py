"""Main text of web pages: boosted trees over DOM nodes and a hierarchical decoding of their classes."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pestle.llm.boosting import Boosted
from pestle.llm.common import text_of
from pestle.llm.dom import Page, features, finished, parse

KEEP, DROP, MIXED = 0, 1, 2
#: Pages of the training set (a bounded, seeded sample of generated layouts) and its seed.
TRAINING_PAGES, SEED = 700, 11
#: Pages whose nodes are classified at once.
BATCH_PAGES = 128


def training_page(rng: random.Random) -> str:
    """A page of a random layout whose regions bear ``data-y``: k (article) or d (everything else)."""
    controls = random.Random(rng.getstate()[1][0])
    syllables = [a + b for a in "bcdfglmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er", "é")]

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(n))

    def sentence(n: int | None = None) -> str:
        n = n or rng.randrange(3, 22)
        s = words(n).split(" ")
        for i in range(len(s) - 1):
            if rng.random() < 0.1:
                s[i] += ","
        return " ".join(s).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def text(most: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.randrange(1, most + 1)))

    def a(label: str) -> str:
        return f'<a href="/{words(1)}">{label}</a>'

    def attr(names: str, p: float = 0.8) -> str:
        names = names.split()
        if rng.random() > p:
            return f' class="{rng.choice("abcdxyz")}{rng.randrange(99)}"' if rng.random() < 0.4 else ""
        extra = rng.choice(["", "", "-wrapper", "-box", "_1", "Inner", "-container"])
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}{extra}"'

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li>{a(words(rng.choice([1, 1, 2, 5])))}{rng.choice(['</li>', '</li>', ''])}" for _ in range(n)) + "</ul>"

    shout = rng.random() < 0.1

    def paragraph() -> str:
        t = sentence(rng.randrange(1, 4)) if rng.random() < 0.12 else text(8)
        if rng.random() < 0.2:
            t = t.replace(" ", f" {a(words(2))} ", 1)
        if rng.random() < 0.1:
            t = f"<b>{t}</b>" if rng.random() < 0.5 else f"<b>{t}<br>"
        return f"<p>{t.upper() if shout else t}" + rng.choice(["</p>", "</p>", "</p>", ""])

    def article() -> str:
        parts = [f"<h1>{sentence(rng.randrange(2, 9))}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 15])):
            r = rng.random()
            if r < 0.8:
                parts.append(paragraph())
            elif r < 0.86:
                parts.append(f"<h{rng.randrange(2, 4)}>{sentence(rng.randrange(1, 6))}</h2>")
            elif r < 0.9:
                parts.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rng.randrange(2, 6))) + "</ul>")
            elif r < 0.93:
                parts.append(f"<blockquote><p>{text(3)}</p></blockquote>")
            elif r < 0.95:
                parts.append("<table>" + "".join(f"<tr><td>{words(2)}</td><td>{words(1)}</td></tr>" for _ in range(rng.randrange(2, 6))) + "</table>")
            elif r < 0.97:
                parts.append(f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>")
            else:
                parts.append(f"<pre>{words(9)}\n{words(5)}</pre>")
        if rng.random() < 0.12:
            parts.insert(rng.randrange(len(parts) + 1), junk(rng.choice(["ad", "share", "related", "notice"])))
        if controls.random() < 0.08:
            parts.insert(controls.randrange(len(parts) + 1), controls.choice(['<button data-y="d">Okay</button>', '<select data-y="d"><option>Red<option>Dark green</select>']))
        body = "".join(parts)
        r = rng.random()
        if r < 0.55:
            return f'<article data-y="k"{attr("post article entry story", 0.4)}>{body}</article>'
        if r < 0.9:
            return f'<div data-y="k"{attr("content article-body entry-content post story main-text page-content text")}>{body}</div>'
        return f'<section data-y="k">{body}</section>'

    def junk(kind: str) -> str:
        if kind == "nav":
            tag = rng.choice(["nav", "nav", "div"])
            return f'<{tag} data-y="d"{attr("nav menu main-menu navigation", 1 if tag == "div" else 0.3)}>{links(rng.randrange(3, 9))}</{tag}>'
        if kind == "header":
            tag = rng.choice(["header", "div"])
            return f'<{tag} data-y="d"{attr("header masthead topbar site-header", 1 if tag == "div" else 0.4)}>{rng.choice([a(words(2)), "<h2>" + words(2) + "</h2>", "<p>" + sentence(4) + "</p>"])}</{tag}>'
        if kind == "footer":
            tag = rng.choice(["footer", "footer", "div"])
            return f'<{tag} data-y="d"{attr("footer site-footer colophon", 1 if tag == "div" else 0.3)}>&copy; {rng.choice([words(2), text(5), "<p>" + text(3) + "</p>" + links(4)])}</{tag}>'
        if kind == "ad":
            tag = rng.choice(["div", "div", "aside", "section"])
            return f'<{tag} data-y="d"{attr("ad ads advert banner sponsored promo ad-slot", 1)}>{rng.choice([text(3), text(3), "<p>" + text(4) + "</p>", a(sentence())])}</{tag}>'
        if kind == "side":
            tag = rng.choice(["aside", "aside", "div"])
            inner = rng.choice([f"<h3>{words(2)}</h3>" + links(5), f"<p>{text(4)}</p>", f"<div>{sentence()}</div><p>{text(2)}</p>"])
            return f'<{tag} data-y="d"{attr("sidebar side widget rail", 1 if tag == "div" else 0.5)}>{inner}</{tag}>'
        if kind == "related":
            return f'<div data-y="d"{attr("related recommended more-stories trending popular", 1)}><h4>{words(2)}</h4>{links(4) if rng.random() < 0.6 else "".join(f"<p>{a(sentence())}</p>" for _ in range(3))}</div>'
        if kind == "share":
            return f'<div data-y="d"{attr("share social sharing follow", 1)}>{a(words(1))} {a(words(1))} {rng.choice(["", sentence(5)])}</div>'
        if kind == "notice":
            return f'<div data-y="d"{attr("cookie-notice consent notice alert newsletter popup gdpr subscribe", 1)}><p>{text(3)}</p><button>{words(1)}</button></div>'
        if kind == "form":
            tag = rng.choice(["form", "form", "div"])
            return f'<{tag} data-y="d"{attr("search login signup contact-form subscribe", 1 if tag == "div" else 0.5)}>{rng.choice(["", "<p>" + text(2) + "</p>"])}<label>{words(2)}</label><input name=q><input type=submit></{tag}>'
        inner = "".join(f'<{t}{attr("comment reply", 0.8)}><div{attr("author meta", 0.5)}>{words(2)}</div><p>{text(5)}</p></{t}>' for t in [rng.choice(["div", "li", "article"])] for _ in range(rng.randrange(1, 6)))
        tag = rng.choice(["section", "div", "div", "ol"])
        return f'<{tag} data-y="d"{attr("comments responses discussion comment-list reader-comments", 1)}>{rng.choice(["", f"<h3>{words(2)}</h3>"])}{inner}</{tag}>'

    some = lambda kinds, p: "".join(junk(k) for k in kinds if rng.random() < p)
    core = article()
    if rng.random() < 0.25:
        core = f'<div{attr("col left column primary", 0.5)}>{core}{some(["share", "related", "comments"], 0.4)}</div>'
    core = f'{some(["share", "notice", "ad", "nav"], 0.12)}{core}{some(["share", "related", "ad", "comments", "form"], 0.25)}'
    if rng.random() < 0.3:
        core = f"<main>{core}</main>"
    if rng.random() < 0.4:
        core = f'<div{attr("wrapper container row page layout", 0.7)}>{core}{some(["side"], 0.6)}</div>'
    top = some(["notice"], 0.15) + some(["header"], 0.35) + some(["nav"], 0.75) + some(["form"], 0.15)
    page = f"<html><head><title>{words(4)}</title><style>p{{}}</style><script>x('</p>')</script></head><body>{top}<!-- {words(2)} -->{some(['ad'], 0.4)}{core}{some(['side', 'related', 'notice'], 0.12)}{some(['footer'], 0.85)}</body></html>"
    return page[: rng.randrange(len(page) * 2 // 3, len(page))] if rng.random() < 0.08 else page


def node_classes(page: Page) -> list[int]:
    """The class of each node: of the nearest labelled ancestor, MIXED above labels of both kinds."""
    n = len(page.tag)
    given = [{"k": KEEP, "d": DROP}.get(x, -1) for x in page.label]
    for i in range(1, n):
        if given[i] < 0 and given[page.parent[i]] >= 0:
            given[i] = given[page.parent[i]]
    below = [0] * n
    for node, _, _ in page.runs:
        below[node] |= 1 << max(given[node], 0) if given[node] >= 0 else 2
    for i in range(n - 1, 0, -1):
        below[page.parent[i]] |= below[i]
    # A region inside another kind of region makes the outer one mixed.
    return [MIXED if below[i] == 3 else given[i] if given[i] >= 0 else (DROP if below[i] == 2 else KEEP) for i in range(n)]


def train(pages: int = TRAINING_PAGES, seed: int = SEED) -> Boosted:
    rng = random.Random(seed)
    parsed = [finished(parse(training_page(rng), labels=True)) for _ in range(pages)]
    x, sizes = features(parsed)
    y = np.array([c for p in parsed for c in node_classes(p)])
    keep = np.concatenate(sizes) > 0
    return Boosted(classes=3).fit(x[keep], y[keep])


@lru_cache(maxsize=1)
def default_model() -> Boosted:
    return train()


def decode(page: Page, log_p: np.ndarray, size: np.ndarray) -> list[bool]:
    """Which nodes are kept, by the most probable classes without contradictions.

    All descendants of a kept node are kept and all of a dropped node are dropped; only a mixed node
    leaves its children free. One pass up finds the best sum of each subtree, one pass down takes it.
    """
    n = len(page.tag)
    p = np.where(size[:, None] > 0, log_p, 0.0)
    keep, drop, mixed = p[:, KEEP].tolist(), p[:, DROP].tolist(), p[:, MIXED].tolist()
    free = [0.0] * n
    kids = [0] * n
    state = [DROP] * n
    best = [0.0] * n
    for i in range(n - 1, -1, -1):
        m = mixed[i] + free[i] if kids[i] else -1e300
        k, d = keep[i], drop[i]
        state[i] = MIXED if m > k and m > d else KEEP if k > d else DROP
        best[i] = max(k, d, m)
        if i:
            q = page.parent[i]
            keep[q] += keep[i]
            drop[q] += drop[i]
            free[q] += best[i]
            kids[q] += 1
    for i in range(1, n):
        if state[page.parent[i]] != MIXED:
            state[i] = state[page.parent[i]]
    return [s == KEEP for s in state]


def extract_all(htmls: list[str], model: Boosted) -> list[str]:
    """The main text of each page: its kept blocks in page order, joined by two line ends."""
    out: list[str] = []
    for at in range(0, len(htmls), BATCH_PAGES):
        pages = [finished(parse(h)) for h in htmls[at : at + BATCH_PAGES]]
        x, sizes = features(pages)
        log_p = model.log_probability(x)
        first = 0
        for page, size in zip(pages, sizes):
            kept = decode(page, log_p[first : first + len(size)], size)
            first += len(size)
            out.append("\n\n".join(text for node, text, _ in page.runs if kept[node]))
    return out


def extract_text(pages: DataFrame, model: Boosted | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text`` of every whole page.

    The model is trained here, on ``TRAINING_PAGES`` generated layouts, so its size is fixed and it is
    broadcast; pages are handled where they are read, without a shuffle. Null, empty and markup-free html
    is defined too: no text, or the text itself if it looks like an article; cut-off, very long and very deep
    pages are read to their end. Ids and urls may be null or repeat; an empty table gives no rows; further columns are
    ignored.
    """
    carried = pages.sparkSession.sparkContext.broadcast(model or default_model())
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH_PAGES):
                part = b.slice(at, BATCH_PAGES)
                texts = extract_all(part.column(2).to_pylist(), carried.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), text_of(pages[html_col]).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string").withColumnsRenamed({"id": id_col, "url": url_col})
