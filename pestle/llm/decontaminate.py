"""Benchmark decontamination over a document-partitioned positional inverted index."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pestle.llm.common import shared_dir, text_of, written

#: Fixed value: the words of the contract, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. Every
#: byte of a character beyond ASCII is a word byte, so the rule holds for UTF-8 bytes alike.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Consecutive words of a window.
WINDOW = 10
#: Words of text that one block of the index holds at most (one document at least).
BLOCK_WORDS = 400_000
#: Distinct windows that one pass over the index carries to the tasks; a larger benchmark takes more passes.
PASS_WINDOWS = 200_000
#: Distinct words of the benchmark up to which only they are indexed; beyond, all words are, by 64-bit hashes.
VOCABULARY = 1_000_000
#: Terms of a window, rarest first, that a proximity match needs, and how far each may be displaced.
NEAR_TERMS, NEAR_SLOP = 4, 5


def words(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(TABLE).split()


def hashed(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word) - (1 << 63)


def windows_of(tokens: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    """All windows of ``size`` words; fewer words, but not none, are one window."""
    if not tokens:
        return set()
    if len(tokens) < size:
        return {tuple(tokens)}
    return {tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)}


INDEX_SCHEMA = "ids array<{kind}>, rows binary, starts binary, terms binary, offsets binary, positions binary"


def build_index(docs: DataFrame, vocabulary: list[bytes] | None, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the postings of ``docs`` below ``path``, one row per block of whole documents.

    A row holds the block's document ids, the position of each document's first word (and, last, the
    number of words), and for each term its ascending positions. With a ``vocabulary``, terms are its
    indexes and other words have no postings; without, terms are 64-bit hashes of all words. Blocks are
    built where documents are read: nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)

    def block(ids: list, rows: list[int], counts: list[int], terms: list[np.ndarray], places: list[np.ndarray]) -> dict:
        starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        term = np.concatenate(terms) if terms else np.empty(0, np.int64)
        place = np.concatenate([p + s for p, s in zip(places, starts)]) if places else np.empty(0, np.int64)
        order = np.argsort(term, kind="stable")
        term = term[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
        return {
            "ids": ids,
            "rows": np.array(rows, np.int64).tobytes(),
            "starts": starts.tobytes(),
            "terms": term[first].astype(np.int64).tobytes(),
            "offsets": np.concatenate([first, [len(term)]]).astype(np.int64).tobytes(),
            "positions": place[order].astype(np.uint32).tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None if known is None else {w: i for i, w in enumerate(known.value)}
        out = pa.schema([("ids", pa.list_(batch_type)), ("rows", pa.binary()), ("starts", pa.binary()), ("terms", pa.binary()), ("offsets", pa.binary()), ("positions", pa.binary())])
        ids, rows, counts, terms, places, n = [], [], [], [], [], 0
        for b in batches:
            for key, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                tokens = words(text.as_py())
                if n and n + len(tokens) > BLOCK_WORDS:
                    yield pa.RecordBatch.from_pylist([block(ids, rows, counts, terms, places)], out)
                    ids, rows, counts, terms, places, n = [], [], [], [], [], 0
                if index is None:
                    term = np.fromiter(map(hashed, tokens), np.int64, len(tokens))
                    place = np.arange(len(tokens))
                else:
                    get = index.get
                    term = np.fromiter([get(w, -1) for w in tokens], np.int64, len(tokens))
                    place = np.flatnonzero(term >= 0)
                    term = term[place]
                ids.append(key)
                rows.append(row)
                counts.append(len(tokens))
                terms.append(term)
                places.append(place)
                n += len(tokens)
        if ids:
            yield pa.RecordBatch.from_pylist([block(ids, rows, counts, terms, places)], out)

    batch_type = to_arrow_type(docs.schema[id_col].dataType)
    schema = INDEX_SCHEMA.format(kind=kind)
    rows = docs.select(docs[id_col].alias("id"), F.monotonically_increasing_id().alias("row"), text_of(docs[text_col]).alias("text")).mapInArrow(run, schema)
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def term_counts(index: DataFrame) -> DataFrame:
    """``term, n``: how often each indexed term occurs, summed over the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[int, int] = defaultdict(int)
            for t, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, n in zip(np.frombuffer(t, np.int64).tolist(), np.diff(np.frombuffer(o, np.int64)).tolist()):
                    total[k] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    return index.select("terms", "offsets").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


class Matcher:
    """Phrase and proximity search of a set of windows in one block."""

    def __init__(self, windows: list[tuple[int, ...]], frequency: dict[int, int]):
        self.windows = windows
        #: per window: (term, offset) from the rarest term to the most frequent
        self.plans = [sorted(enumerate(w), key=lambda x: (frequency.get(x[1], 0), x[0])) for w in windows]
        self.rarest = np.array([p[0][1] for p in self.plans], np.int64)
        near = []
        for p in self.plans:
            seen, keep = set(), []
            for offset, term in p:
                if term not in seen and len(keep) < NEAR_TERMS:
                    seen.add(term)
                    keep.append((offset, term))
            near.append(keep)
        self.near = near

    def search(self, terms: np.ndarray, offsets: np.ndarray, positions: np.ndarray, starts: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], list[tuple[int, np.ndarray]]]:
        """Exact starts of each window that occurs, and the documents (by number) with a proximity match.

        The list of the rarest term, less its offset, is intersected with the others in order of
        frequency, and the search ends as soon as nothing is left.
        """
        if not len(terms):
            return [], []
        at = np.minimum(np.searchsorted(terms, self.rarest), len(terms) - 1)
        exact, near = [], []
        postings = lambda t: positions[offsets[t] : offsets[t + 1]]
        where = {int(t): i for i, t in enumerate(terms)}
        for w in np.flatnonzero(terms[at] == self.rarest).tolist():
            plan, size = self.plans[w], len(self.windows[w])
            anchor = postings(at[w])
            begin = anchor - plan[0][0]
            doc = np.searchsorted(starts, anchor, side="right") - 1
            ok = (begin >= starts[doc]) & (begin + size <= starts[doc + 1])
            left = begin[ok]
            for offset, term in plan[1:]:
                if not len(left):
                    break
                k = where.get(term)
                if k is None:
                    left = left[:0]
                    break
                p = postings(k)
                want = left + offset
                i = np.minimum(np.searchsorted(p, want), len(p) - 1)
                left = left[p[i] == want]
            if len(left):
                exact.append((w, left))
            keep = np.ones(len(begin), bool)
            for offset, term in self.near[w][1:]:
                k = where.get(term)
                if k is None:
                    keep[:] = False
                    break
                p = postings(k)
                want = begin + offset
                # The nearest postings of the document itself, which stand around the wanted place moved into it.
                i = np.searchsorted(p, np.clip(want, starts[doc], starts[doc + 1] - 1))
                near_by = np.stack([p[np.maximum(i - 1, 0)], p[np.minimum(i, len(p) - 1)]])
                keep &= ((np.abs(near_by - want) <= NEAR_SLOP) & (near_by >= starts[doc]) & (near_by < starts[doc + 1])).any(0)
                if not keep.any():
                    break
            if keep.any():
                near.append((w, np.unique(doc[keep])))
        return exact, near


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """Whole-word matches of benchmark windows in every document.

    Returns ``id_col, n_words, n_hit, items (array, sorted as strings), near_items (array), spans``:
    ``spans`` are the maximal stretches of hit words, as word offsets with the end exclusive;
    ``near_items`` also has the items of which only the ``NEAR_TERMS`` rarest terms of a window stand
    within ``NEAR_SLOP`` words of their places.

    The documents' postings of all benchmark words are stored once, in blocks that are never shuffled, and
    counted over the whole corpus. The benchmark's windows then search them in passes of at most
    ``pass_windows`` distinct windows, each broadcast, so that what a task holds stays bounded however large the
    benchmark is. Null and empty texts have no words and no hits; texts of any length are indexed whole; items
    without words match nothing; repeated documents and items are searched as they stand (an item_id that
    repeats is one item); empty tables give no rows or no hits; further columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    items = benchmark.filter(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string"), item_text_col)
    known = benchmark_words(items, item_text_col)
    number = None if known is None else {w: i for i, w in enumerate(known)}
    index = build_index(docs, known, f"{shared_dir(spark)}/index", id_col, text_col)
    counts = written(term_counts(index), "counts")
    parts: list[DataFrame] = []

    group: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items.toLocalIterator():
        for w in windows_of(words(text), window):
            if w not in group and len(group) >= pass_windows:
                parts.append(one_pass(index, counts, number, group, kind))
                group = {}
            group.setdefault(w, set()).add("" if item is None else item)
    if group or not parts:
        parts.append(one_pass(index, counts, number, group, kind))
    out = parts[0] if len(parts) == 1 else merged(parts)
    return out.drop("row").withColumnRenamed("id", id_col)


def benchmark_words(items: DataFrame, text_col: str) -> list[bytes] | None:
    """The distinct words of all items in order; None if there are more than VOCABULARY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in b.column(0).to_pylist() for w in words(t)}), pa.binary())], names=["word"])

    found = items.select(text_col).mapInArrow(run, "word binary").distinct().limit(VOCABULARY + 1).collect()
    return None if len(found) > VOCABULARY else sorted(bytes(r["word"]) for r in found)


def merged(parts: list[DataFrame]) -> DataFrame:
    """The rows of all passes, one per document: spans that meet become one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    every = lambda c: F.flatten(F.collect_list(c))
    out = out.groupBy("id", "row").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(every("items"))).alias("items"),
        F.array_sort(F.array_distinct(every("near_items"))).alias("near_items"),
        F.array_sort(every("spans")).alias("raw"),
    )
    joined = F.expr("""
        aggregate(raw, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, s) ->
            CASE WHEN size(acc) > 0 AND s.start <= element_at(acc, -1).end
                 THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end))))
                 ELSE concat(acc, array(named_struct('start', s.start, 'end', s.end))) END)
    """)
    out = out.withColumn("spans", joined)
    return out.select("id", "row", "n_words", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_hit"), "items", "near_items", "spans")


RESULT = "id {kind}, row long, n_words long, n_hit long, items array<string>, near_items array<string>, spans array<struct<start:bigint,end:bigint>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def one_pass(index: DataFrame, counts: DataFrame, number: dict[bytes, int] | None, group: dict[tuple[bytes, ...], set[str]], kind: str) -> DataFrame:
    """The rows of all documents for the windows in ``group``; ``number``: the terms of words, else their hashes."""
    spark = index.sparkSession
    term = hashed if number is None else number.__getitem__
    windows = sorted(group)
    sequences = [tuple(map(term, x)) for x in windows]
    terms = spark.createDataFrame([(t,) for t in {t for s in sequences for t in s}], "term long")
    frequency = {r["term"]: r["n"] for r in counts.join(F.broadcast(terms), "term", "left_semi").collect()}  # of the pass's terms
    carried = spark.sparkContext.broadcast((sequences, [sorted(group[x]) for x in windows], frequency))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences, owners, counts = carried.value
        matcher = Matcher(sequences, counts)
        lengths = [len(s) for s in sequences]
        for b in batches:
            for r in range(b.num_rows):
                ids = b.column(0)[r].as_py()
                rows, starts, terms, offsets = (np.frombuffer(b.column(c)[r].as_py(), np.int64) for c in (1, 2, 3, 4))
                positions = np.frombuffer(b.column(5)[r].as_py(), np.uint32).astype(np.int64)
                exact, near = matcher.search(terms, offsets, positions, starts)
                hit = np.zeros(int(starts[-1]) + 1, np.int64)
                found: dict[int, set[str]] = defaultdict(set)
                close: dict[int, set[str]] = defaultdict(set)
                for w, begins in exact:
                    np.add.at(hit, begins, 1)
                    np.add.at(hit, begins + lengths[w], -1)
                    for d in np.unique(np.searchsorted(starts, begins, side="right") - 1).tolist():
                        found[d].update(owners[w])
                for w, which in near:
                    for d in which.tolist():
                        close[d].update(owners[w])
                covered = (np.cumsum(hit)[:-1] > 0).astype(np.int8)
                total = np.concatenate([[0], np.cumsum(covered, dtype=np.int64)])
                n_hit = total[starts[1:]] - total[starts[:-1]]
                spans = [[] for _ in ids]
                for d in found:
                    own = np.diff(np.concatenate([[0], covered[starts[d] : starts[d + 1]], [0]]))
                    spans[d] = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[r].values, pa.array(rows), pa.array(np.diff(starts)), pa.array(n_hit), pa.array([sorted(found.get(d, ())) for d in range(len(ids))], pa.list_(pa.string())),
                     pa.array([sorted(close.get(d, set()) | found.get(d, set())) for d in range(len(ids))], pa.list_(pa.string())), pa.array(spans, SPANS)],
                    names=["id", "row", "n_words", "n_hit", "items", "near_items", "spans"],
                )

    return index.mapInArrow(run, RESULT.format(kind=kind))
