"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers find the boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pestle.llm.common import text_of

#: Kinds in output order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "ssn", "secret")
BASE = KINDS[:4]
#: Schemes, and the cues of each identifier.
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "api key", "apikey"),
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
# A match that starts inside a run of digits exists only if one starts at the run's first digit, so the
# lookbehind changes no result and keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
HOST = re.compile(r"(?:[^/@\s]*@)?(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+(?::[0-9]{1,5})?(?=[/?#]|$)")
AFTER_CUE = r"[\x20\t]*(?:number|no\.?|nr\.?|#)?[\x20\t]*[:=#]?[\x20\t]*"
IBAN = re.compile(AFTER_CUE + r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.I)
ACCOUNT = re.compile(AFTER_CUE + r"([0-9](?:[\x20-]?[0-9]){5,19})(?![0-9])", re.I)
SSN = re.compile(AFTER_CUE + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])", re.I)
SECRET = re.compile(r"[\"']?[\x20\t]*[:=][\x20\t]*([\"']?)([A-Za-z0-9_+/=.-]{16,})(?:\1)")

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("+", ("+", 1))
    for s in SCHEMES:
        for x in {s, s.upper(), s.capitalize()}:
            found.add_word(x, ("url", len(x)))
    for kind, cues in CUES.items():
        for c in cues:
            for x in {c, c.upper(), c.capitalize(), c.title()}:
                found.add_word(x, (kind, len(x)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def emails(text: str, ats: list[int]) -> Iterator[Span]:
    end = 0
    for p in ats:
        if p < end:
            continue
        s = p
        while s > end and text[s - 1] in LOCAL:
            s -= 1
        if s < p and (m := DOMAIN.match(text, p + 1)):
            end = m.end()
            yield "email", s, end


def phones(text: str, pluses: list[int]) -> Iterator[Span]:
    end = 0
    for p in pluses:
        if p >= end and (m := PHONE.match(text, p)):
            end = m.end()
            if 9 <= len(DIGIT.findall(m.group())) <= 15:
                yield "phone", p, end


def numbers(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()


def cued(text: str, kind: str, start: int, end: int) -> Span | None:
    """The span that the cue at ``start:end`` announces, if it holds up."""
    if kind == "url":
        m = URL.match(text, end)
        if m is None:
            return None
        stop = m.end()
        while stop > end and text[stop - 1] in ".,;:!?)]":
            stop -= 1
        body = text[end:stop]
        scheme = text[start:end].lower()
        ok = HOST.match(body) if "//" in scheme else ("@" in body if scheme == "mailto:" else len(DIGIT.findall(body)) >= 7)
        return (kind, start, stop) if ok else None
    if kind == "secret":
        m = SECRET.match(text, end)
        return (kind, m.start(2), m.end(2)) if m and DIGIT.search(m.group(2)) else None
    if start and text[start - 1].isalpha():
        return None
    m = {"iban": IBAN, "account": ACCOUNT, "ssn": SSN}[kind].match(text, end)
    if m is None:
        return None
    if kind == "iban":
        for stop in range(m.end(1), m.start(1) + 14, -1):
            value = text[m.start(1) : stop].replace(" ", "").upper()
            if text[stop - 1] != " " and mod97(value):
                return kind, m.start(1), stop
        return None
    if kind == "ssn" and (text[m.start(1) : m.start(1) + 3] in ("000", "666") or text[m.start(1)] == "9"):
        return None
    return kind, m.start(1), m.end(1)


def find_spans(text: str) -> list[Span]:
    """All spans of one text, by kind as in ``KINDS``, then start. Offsets in code points, end exclusive."""
    ats: list[int] = []
    pluses: list[int] = []
    cues: list[tuple[str, int, int]] = []
    for last, (kind, n) in automaton().iter(text):
        if kind == "@":
            ats.append(last)
        elif kind == "+":
            pluses.append(last)
        else:
            cues.append((kind, last + 1 - n, last + 1))
    has_digit = DIGIT.search(text) is not None
    if not (ats or cues or has_digit):
        return []
    found: list[Span] = [*emails(text, ats)]
    if has_digit:
        found += [*phones(text, pluses), *numbers(text)]
    ends: dict[str, int] = {}
    for kind, start, end in sorted(cues, key=lambda c: c[1]):
        if (span := cued(text, kind, start, end)) and span[1] >= ends.get(kind, 0):
            ends[kind] = span[2]
            found.append(span)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (order[s[0]], s[1]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text: ``id_col, spans array<struct<kind, start, end>>``.

    The base kinds are leftmost and non-overlapping per kind: email; ip (parts at most 255); card (13 to
    19 digits passing Luhn); phone (9 to 15 digits); failing matches are dropped without another try.
    Schemes and cues add url, iban (mod 97), account, ssn and secret spans. Texts are scanned where they
    are read, without a shuffle. Null and empty texts give an empty array; ids may be null or repeat;
    further columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, SPANS)], names=["id", "spans"])

    out = df.select(df[id_col].alias("id"), text_of(df[text_col]).alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with every span replaced by ``[KIND]``; overlapping spans become one, named after the first."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1):
                text, parts, at = t.as_py(), [], 0
                for k, s, e in sorted(find_spans(text), key=lambda x: (x[1], -x[2])):
                    if s >= at:
                        parts += [text[at:s], f"[{k.upper()}]"]
                    at = max(at, e)
                out.append("".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    out = df.select(df[id_col].alias("id"), text_of(df[text_col]).alias("text")).mapInArrow(run, f"id {kind}, text string")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def joined_spans(spans):
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
