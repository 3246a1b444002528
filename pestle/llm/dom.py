"""A small DOM of block elements: tolerant parsing, text runs, and features of every node."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np

#: Fixed values from the HTML standard: elements without content, and elements whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math meter nobr object output progress q rb rp rt ruby s samp small span strike strong sub sup svg time tt u var video".split())
INLINE |= frozenset("annotation menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE |= frozenset("circle defs desc ellipse g line lineargradient path polygon polyline radialgradient rect stop symbol text textpath tspan use".split())
#: Controls, which any block but their own options ends, and elements whose content is never shown.
CONTROLS, OPTIONS = frozenset("button datalist optgroup option select".split()), frozenset("optgroup option".split())
HIDDEN = frozenset(["template"])
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dt dd main menu nav ol p pre section summary table ul td th tr tbody thead tfoot".split())
#: An opening tag ends these open elements, up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "button": ({"button"}, {"form", "table"}),
}
TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LABEL = re.compile(r"data-y=\"(\w)\"")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
#: What ends the content of each RAW element; letters are folded in ASCII only.
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I | re.A) for name in RAW}
MARKS = re.compile(r"[.,;:!?。、]")

#: Attribute tokens by what they usually name.
TOKENS = {
    "ad": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion adsense dfp",
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs tabs pagination pager toc skip",
    "comment": "comment comments reply replies respond discussion disqus thread responses",
    "side": "sidebar side aside widget rail secondary related recommended more trending popular tags tag",
    "foot": "footer foot copyright legal bottom colophon credits",
    "head": "header head masthead topbar top logo brand site",
    "share": "share sharing social follow like tweet buttons",
    "notice": "cookie cookies consent notice notification alert popup modal overlay newsletter subscribe gdpr warning message",
    "form": "form search login signup register input contact",
    "main": "article content post entry main story body text prose page blog news",
}
TOKEN_GROUP = {t: i for i, (_, words) in enumerate(TOKENS.items()) for t in words.split()}
N_GROUPS = len(TOKENS)
TAGS = [
    {"nav", "menu"}, {"footer"}, {"aside"}, {"header"}, {"form", "fieldset", "dialog", "button", "select", "datalist", "option", "optgroup"}, {"article"}, {"main"}, {"h1", "h2", "h3", "h4", "h5", "h6"},
    {"p", "pre", "blockquote", "figure", "figcaption"}, {"li", "ul", "ol", "dl", "dt", "dd"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th"}, {"div", "section", "center"}, {"#text"}, {"html", "body"},
]
TAG_GROUP = {t: i for i, group in enumerate(TAGS) for t in group}
N_TAGS = len(TAGS)


class Page:
    """Block nodes in page order (a node precedes its descendants), and text runs that belong to them."""

    __slots__ = ("tag", "parent", "attrs", "runs", "inputs", "tags", "label")

    def __init__(self):
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.attrs: list[str] = [""]
        self.inputs: list[int] = [0]
        self.tags: list[int] = [0]
        self.label: list[str] = [""]
        #: (node, text, characters inside links)
        self.runs: list[tuple[int, str, int]] = []


def parse(html: str, labels: bool = False) -> Page:
    """Parse any string: unclosed, crossed and cut-off markup included, of any length and depth. Nothing raises,
    nothing is skipped but comments, declarations and the content of ``RAW`` and ``HIDDEN`` elements. A ``RAW``
    element without its end tag goes on to the end of the page, as in browsers; any other ends with its parent."""
    page = Page()
    stack: list[tuple[str, int]] = [("#root", 0)]  # block elements
    links = 0  # open links in the current block
    pieces: list[str] = []
    linked = 0
    hidden = 0  # open HIDDEN elements
    opened: Counter[str] = Counter()  # open block elements by name
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", unescape("".join(pieces))).strip()
            if text and not hidden:
                page.runs.append((stack[-1][1], text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links, hidden
        flush()
        for name, _ in stack[depth:]:
            opened[name] -= 1
            hidden -= name in HIDDEN
        del stack[depth:]
        links = 0

    while at < n:
        start = html.find("<", at)
        if start < 0:
            start = n
        if start > at:
            text = html[at:start]
            pieces.append(text)
            if links:
                linked += len(text)
        if start >= n:
            break
        m = TAG.match(html, start)
        if m is None:
            pieces.append("<")
            at = start + 1
            continue
        at = m.end()
        close, name, attrs = m.group(1, 2, 3) if m.group(2) is not None else m.group(4, 5, 6)
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            page.tags[stack[-1][1]] += 1
            if name == "a":
                links = 0 if close else 1
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name == "input":
            page.inputs[stack[-1][1]] += 1
            continue
        if name in VOID:
            page.tags[stack[-1][1]] += 1
            if name == "hr":
                flush()
            continue
        if close:
            for depth in range(0) if not opened[name] else range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
            continue
        if name in RAW:
            if name == "textarea":
                page.inputs[stack[-1][1]] += 1
            else:
                page.tags[stack[-1][1]] += 1
            end = RAW_END[name].search(html, at)
            at = end.end() if end else n
            continue
        if name in ("button", "select"):
            page.inputs[stack[-1][1]] += 1
        while stack[-1][0] in CONTROLS and name not in OPTIONS and (name in CLOSES_P or name in CONTROLS):
            pop_to(len(stack) - 1)
        if name in CLOSES_P and stack[-1][0] == "p":
            pop_to(len(stack) - 1)
        if name in IMPLIED:
            ends, stops = IMPLIED[name]
            for depth in range(0) if not any(opened[x] for x in ends) else range(len(stack) - 1, 0, -1):
                if stack[depth][0] in stops:
                    break
                if stack[depth][0] in ends:
                    pop_to(depth)
        flush()
        links = 0
        page.tag.append(name)
        page.parent.append(stack[-1][1])
        page.inputs.append(0)
        page.tags.append(1)
        found = ATTRIBUTE.findall(attrs) if attrs else ()
        page.attrs.append(" ".join(a or b or c for a, b, c in found))
        y = LABEL.search(attrs) if labels and attrs else None
        page.label.append(y.group(1) if y else "")
        if not attrs.endswith("/"):
            stack.append((name, len(page.tag) - 1))
            opened[name] += 1
            hidden += name in HIDDEN
    flush()
    return page


def finished(page: Page) -> Page:
    """Text runs of nodes that also have children become nodes of their own, so that only leaves hold text."""
    n = len(page.tag)
    has_child = bytearray(n)
    for p in page.parent[1:]:
        has_child[p] = 1
    if not any(has_child[r[0]] for r in page.runs):
        return page
    # Keep page order: a run follows the children opened before it.
    runs = []
    for node, text, linked in page.runs:
        if has_child[node]:
            page.tag.append("#text")
            page.parent.append(node)
            page.attrs.append("")
            page.inputs.append(0)
            page.tags.append(0)
            page.label.append("")
            node = len(page.tag) - 1
        runs.append((node, text, linked))
    page.runs = runs
    return page


NAMES_BEFORE_GROUPS = 20
N_FEATURES = NAMES_BEFORE_GROUPS + N_TAGS + 2 * N_GROUPS + 2


def features(pages: list[Page]) -> tuple[np.ndarray, list[np.ndarray]]:
    """One row of features for every node of the pages, and per page each node's characters of text."""
    rows, sizes = [], []
    for page in pages:
        n = len(page.tag)
        parent = page.parent
        chars, linked, marks, blocks, p_chars, li = ([0] * n for _ in range(6))
        start = [-1] * n
        inputs, tags = list(page.inputs), list(page.tags)
        before = 0
        for node, text, link in page.runs:
            size = len(text)
            chars[node] += size
            linked[node] += link
            marks[node] += len(MARKS.findall(text))
            blocks[node] += 1
            if page.tag[node] == "p":
                p_chars[node] += size
            elif page.tag[node] == "li":
                li[node] += 1
            if start[node] < 0:
                start[node] = before
            before += size
        total = before
        kids = [0] * n
        first = list(start)
        # Children have larger numbers than their parents, so one backward pass adds up subtrees.
        for i in range(n - 1, 0, -1):
            q = parent[i]
            chars[q] += chars[i]
            linked[q] += linked[i]
            marks[q] += marks[i]
            blocks[q] += blocks[i]
            p_chars[q] += p_chars[i]
            li[q] += li[i]
            inputs[q] += inputs[i]
            tags[q] += tags[i]
            kids[q] += 1
            if first[i] >= 0 and (first[q] < 0 or first[i] < first[q]):
                first[q] = first[i]
        depth, index, above = [0] * n, [0] * n, [0] * n
        own, inherited = [0] * n, [0] * n
        seen = [0] * n
        last_child = [-1] * n
        prev, nxt = [0] * n, [0] * n
        for i in range(1, n):
            q = parent[i]
            depth[i] = depth[q] + 1
            index[i] = seen[q]
            seen[q] += 1
            if (k := last_child[q]) >= 0:
                prev[i] = chars[k]
                nxt[k] = chars[i]
            last_child[q] = i
            mask = 0
            if page.attrs[i]:
                for t in TOKEN.findall(page.attrs[i]):
                    g = TOKEN_GROUP.get(t.lower())
                    if g is not None:
                        mask |= 1 << g
            own[i] = mask
            inherited[i] = inherited[q] | mask
            g = TAG_GROUP.get(page.tag[i], -1)
            above[i] = above[q] | (1 if 0 <= g <= 4 else 0) | (2 if g in (5, 6) else 0)
        size = np.array(chars, np.float64)
        par = np.array(parent)
        par[0] = 0
        link = np.array(linked) / np.maximum(size, 1)
        f = np.zeros((n, N_FEATURES), np.float32)
        f[:, 0] = depth
        f[:, 1] = np.log1p(size)
        f[:, 2] = link
        f[:, 3] = np.array(tags) / (size + 1)
        f[:, 4] = np.log1p(blocks)
        f[:, 5] = np.array(p_chars) / np.maximum(size, 1)
        f[:, 6] = size / np.maximum(blocks, 1)
        f[:, 7] = np.array(marks) / np.maximum(size, 1)
        f[:, 8] = np.array(li) / np.maximum(blocks, 1)
        f[:, 9] = np.minimum(inputs, 20)
        f[:, 10] = np.array(index) / np.maximum(np.array(kids)[par] - 1, 1)
        f[:, 11] = size / np.maximum(size[par], 1)
        f[:, 12] = size / max(total, 1)
        f[:, 13] = np.log1p(np.array(kids)[par])
        f[:, 14] = link[par]
        f[:, 15] = np.array(first) / max(total, 1)
        f[:, 16] = np.log1p(prev)
        f[:, 17] = np.log1p(nxt)
        f[:, 18] = np.log1p(size[par])
        f[:, 19] = np.log1p(kids)
        groups = np.array([TAG_GROUP.get(t, -1) for t in page.tag])
        known = np.flatnonzero(groups >= 0)
        f[known, NAMES_BEFORE_GROUPS + groups[known]] = 1
        at = NAMES_BEFORE_GROUPS + N_TAGS
        bits = np.arange(N_GROUPS)
        f[:, at : at + N_GROUPS] = (np.array(own)[:, None] >> bits) & 1
        f[:, at + N_GROUPS : at + 2 * N_GROUPS] = (np.array(inherited)[:, None] >> bits) & 1
        f[:, -2] = np.array(above) & 1
        f[:, -1] = (np.array(above) >> 1) & 1
        rows.append(f)
        sizes.append(size)
    return (np.concatenate(rows) if rows else np.empty((0, N_FEATURES), np.float32)), sizes
