"""Word-end byte-pair encoding with tree concatenation for long unsplit text."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pestle.llm.common import lean, shuffle_partitions, text_of

#: Symbols of the longest stretch that is encoded in one go; longer ones are halved.
LEAF = 192
#: Tokens on either side of a join that the first window holds; it doubles until both sides agree.
WINDOW = 4
#: Bytes, about, of the words whose encoding a task keeps; they are dropped when full and when the task ends.
CACHED_BYTES = 24 << 20
#: Characters outside the range whose letters, cases and white space are the same for Python, ``regex`` and the
#: library (a test tries them all, and all pairs of them); words with others are left to the library.
FOREIGN = re.compile("[^\\x00-\\x1b\\x20-\\u024f\\u2010-\\u2027\\u2030-\\u203a\\u20a0-\\u20bf]")
FIRST, SECOND = itemgetter(0), itemgetter(1)
#: Texts of at least LONG characters are cut into stretches of at most STRETCH that are encoded by different tasks.
LONG, STRETCH = 262_144, 16_384
#: Text characters in an output batch at most (one document at least).
BATCH_CHARS = 4_000_000
#: What a stretch of a long text is: normalised words, an added token, or a part of one unsplit piece.
WORDS, ADDED, PART = "words", "added", "part"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Remembered(dict):
    """Values by word, made when first asked for; long words are not kept."""

    def __init__(self, make, most: int = CACHED_BYTES):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= 64:
            if self.held >= self.most:
                self.clear()
            self.held += 320 + 8 * len(word)  # key, ids, decoded text, their pair and the entry
            self[word] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.held = 0


class WordBpe:
    """Encoder and decoder for one ``tokenizers`` file: split by pattern, byte level, word-end suffix."""

    def __init__(self, spec: str, leaf: int = LEAF, window: int = WINDOW):
        import regex
        from tokenizers import Tokenizer

        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or data.get("post_processor") or data.get("decoder"):
            raise ValueError("not a plain BPE file: a post-processor or decoder would change the result")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        library = Tokenizer.from_str(spec)
        self.normalizer, self.pre_tokenizer, self.model = library.normalizer, library.pre_tokenizer, library.model
        if [n["type"] for n in data["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not the normalizer that words() follows")
        split = data["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.added_pattern = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.symbols = byte_symbols()
        self.leaf, self.window = leaf, window
        self.byte_map = {b: c for b, c in enumerate(self.symbols)}
        self.known = Remembered(self.word)

    def merged(self, parts: list[str]) -> list[str]:
        """Apply merges, lowest rank first and leftmost among equals."""
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, None
            for pair in zip(parts, parts[1:]):
                r = ranks.get(pair)
                if r is not None and (best is None or r < best):
                    best, at = r, pair
            if at is None:
                break
            a, b = at
            out, i, n = [], 0, len(parts)
            while i < n:
                if i + 1 < n and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def units(self, tokens: Iterable[str]) -> list[str]:
        """The initial symbols that the tokens were merged from."""
        out = []
        for t in tokens:
            if self.suffix and t.endswith(self.suffix):
                body = t[: -len(self.suffix)]
                out += [*body[:-1], body[-1] + self.suffix]
            else:
                out += t
        return out

    def tree(self, parts: list[str]) -> list[str]:
        """Encode leaves on their own, then join neighbours level by level."""
        return self.joined_all([self.merged(parts[i : i + self.leaf]) for i in range(0, len(parts), self.leaf)])

    def joined_all(self, level: list[list[str]]) -> list[str]:
        while len(level) > 1:
            level = [self.joined(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def joined(self, left: list[str], right: list[str]) -> list[str]:
        """Both encodings as one. The window around the join is encoded again and grows until its first
        token is the left side's and its last token the right side's: then every neighbouring pair of
        tokens is one that the merges themselves leave apart, so that the whole is the encoding."""
        n = self.window
        while True:
            i, j = max(0, len(left) - n), min(len(right), n)
            inner = self.merged(self.units(left[i:] + right[:j]))
            if (i == 0 or inner[0] == left[i]) and (j == len(right) or inner[-1] == right[j - 1]):
                return left[:i] + inner + right[j:]
            n *= 2

    def coded(self, word: str) -> list[str]:
        """The pieces of a normalised word, as byte symbols."""
        if FOREIGN.search(word):
            return [p for p, _ in self.pre_tokenizer.pre_tokenize_str(word)]
        symbols = lambda p: p if p.isascii() and p.isprintable() else p.encode("utf-8").decode("latin-1").translate(self.byte_map)
        return [symbols(p) for p in self.pattern.findall(word)]

    def piece(self, coded: str) -> list[str]:
        """Tokens of one piece, given as byte symbols: short ones by the library's model."""
        if len(coded) <= self.leaf:
            return [t.value for t in self.model.tokenize(coded)]
        return self.tree([*coded[:-1], coded[-1] + self.suffix])

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids (unsigned, 32 bits) and decoded text of a stretch without white space."""
        tokens = [t for p in self.coded(word) for t in self.piece(p)]
        return array("I", map(self.vocab.__getitem__, tokens)).tobytes(), " ".join(tokens)

    def words(self, text: str) -> list[str]:
        """The normalised text's stretches without white space."""
        if FOREIGN.search(text):
            return [w for w in self.normalizer.normalize_str(text).split(" ") if w]
        return text.lower().split()

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of text, and the added tokens between them."""
        at = 0
        if any(t in text for t in self.added):
            for m in self.added_pattern.finditer(text):
                yield text[at : m.start()], False
                yield m.group(), True
                at = m.end()
        yield text[at:], False

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        ids, out = [], []
        for part, special in self.segments(text):
            x, y = self.encode_unit(part, ADDED) if special else self.encode_words(self.words(part))
            if x:
                ids.append(x)
                out.append(y)
        return b"".join(ids), " ".join(out)

    def encode_words(self, words: list[str]) -> tuple[bytes, str]:
        """Ids and decoded text of normalised words."""
        got = list(map(self.known.__getitem__, words))
        return b"".join(map(FIRST, got)), " ".join(map(SECOND, got))

    def encode_unit(self, part: str, kind: str) -> tuple[bytes, str]:
        """Ids and decoded text of a stretch of WORDS, which are not normalised again, or of an ADDED token."""
        if kind == ADDED:
            return array("I", [self.added[part]]).tobytes(), part
        return self.encode_words(part.split(" ") if part else [])

    def stretches(self, text: str) -> Iterator[tuple[int, str, bool, str]]:
        """The text cut for different tasks, as (unit, kind, last, symbols): WORDS and an ADDED token are encoded
        on their own; the stretches of one unit of kind PART are parts of one unsplit piece, in order, as byte
        symbols. There is at least one."""
        unit, held, size = 0, [], 0

        def ready() -> Iterator[tuple[int, str, bool, str]]:
            nonlocal unit, held, size
            if held:
                yield unit, WORDS, True, " ".join(held)
                unit, held, size = unit + 1, [], 0

        for part, special in self.segments(text):
            if special:
                yield from ready()
                yield unit, ADDED, True, part
                unit += 1
                continue
            for word in self.words(part):
                if len(word) < STRETCH // 4:
                    held.append(word)
                    size += len(word) + 1
                    if size >= STRETCH:
                        yield from ready()
                    continue
                yield from ready()
                for coded in self.coded(word):
                    for i in range(0, len(coded), STRETCH):
                        yield unit, PART, i + STRETCH >= len(coded), coded[i : i + STRETCH]
                    unit += 1
        yield from ready()
        if not unit:
            yield 0, WORDS, True, ""


@lru_cache(maxsize=2)
def encoder(spec: str) -> WordBpe:
    return WordBpe(spec)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """Encode and decode every whole text: ``id_col, ids (binary, little-endian uint32), decoded``.

    ``path``: a ``tokenizers`` JSON file; it is read on the driver and its fixed size is what the tasks
    carry. Texts are independent, so the scan's partitions are encoded where they are read. Only texts of
    at least ``long`` characters are cut: their stretches are encoded in parallel by different tasks, and
    one task for each text joins them, re-encoding windows around the cuts inside unsplit pieces.
    Null and empty texts give no ids and an empty decoded text; ids may be null, and repeated rows give repeated
    rows; an empty table gives no rows; further columns are ignored.
    """
    with open(path or default_path(), encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(df[id_col].alias("id"), text_of(df[text_col]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            start = 0
            while start < b.num_rows:
                ids, decoded, chars, i = [], [], 0, start
                while i < b.num_rows and (i == start or chars < BATCH_CHARS):
                    text = texts[i].as_py()
                    chars += len(text)
                    x, y = bpe.encode(text)
                    ids.append(x)
                    decoded.append(y)
                    i += 1
                yield pa.RecordBatch.from_arrays([keys.slice(start, i - start), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])
                start = i
        bpe.known.clear()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        for b in batches:
            for i in range(b.num_rows):
                rows = list(bpe.stretches(b.column(2)[i].as_py()))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[i].as_py()] * n, b.schema.field(0).type), pa.array([b.column(1)[i].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.string())],
                    names=["id", "row", "seq", "unit", "kind", "last", "part"],
                )

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        for b in batches:
            tokens, ids = [], []
            for kind, last, part in zip(*(b.column(c).to_pylist() for c in (4, 5, 6))):
                if kind != PART:
                    x, y = bpe.encode_unit(part, kind)
                    ids.append(x)
                    tokens.append([y])
                else:
                    symbols = list(part)
                    if last:
                        symbols[-1] += bpe.suffix
                    ids.append(None)
                    tokens.append(bpe.tree(symbols))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(ids, pa.binary()), pa.array(tokens, pa.list_(pa.string()))], names=["id", "row", "seq", "unit", "kind", "ids", "tokens"])
        bpe.known.clear()

    def assemble(frame):
        import pandas as pd

        bpe = encoder(spec.value)
        frame = frame.sort_values("seq")
        ids, out = [], []
        for _, unit in frame.groupby("unit", sort=True):
            if unit["kind"].iloc[0] != PART:
                ids += list(unit["ids"])
                out += [t[0] for t in unit["tokens"]]
            else:
                tokens = bpe.joined_all([list(t) for t in unit["tokens"]])
                ids.append(array("I", map(bpe.vocab.__getitem__, tokens)).tobytes())
                out += tokens
        return pd.DataFrame({"id": frame["id"].iloc[:1], "ids": [b"".join(ids)], "decoded": [" ".join(out)]})

    size = F.length("text")
    schema = f"id {kind}, ids binary, decoded string"
    short = texts.filter(size < long).mapInArrow(lean(run, forget=False), schema)
    parts = texts.filter(size >= long).select("id", F.monotonically_increasing_id().alias("row"), "text")
    parts = parts.mapInArrow(cut, f"id {kind}, row bigint, seq bigint, unit bigint, kind string, last boolean, part string")
    parts = parts.repartition(shuffle_partitions(df.sparkSession), "row", "unit", "seq")
    done = parts.mapInArrow(encode_parts, f"id {kind}, row bigint, seq bigint, unit bigint, kind string, ids binary, tokens array<string>")
    whole = done.groupBy("row").applyInPandas(assemble, schema)
    return short.unionByName(whole).withColumnRenamed("id", id_col)
