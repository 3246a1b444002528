"""Quality classifier: an interpolated modified Kneser-Ney model over bytes, trained on trusted text.

Texts of one language and fold are handled in blocks. A block asks the shards of the model for its distinct
n-grams, and the answers meet it again in a shuffle: neither the model nor any part of it passes the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pestle.llm.common import discard, lean, shuffle_partitions, steady, written

#: Bytes of an n-gram; packed big-endian into a bigint.
ORDER = 5
#: Quantiles of the trusted texts' perplexity and local statistics, per language, between which a text is
#: accepted; chosen by the rates on the labels that the README gives.
LOW, HIGH = 0.001, 0.99
#: Bytes of a word at most (a longer one counts as several), bytes that a shorter one counts as, and words of a stretch.
WORD, SHORT_WORD, STRETCH = 32, 6, 48
#: Local statistics of a text, each with limits of its own: its least likely word, its likeliest and least likely stretch.
LOCAL = ("word", "dull", "odd")
#: Quantiles of trusted texts are taken over cells of 1/GRID.
GRID = 4096
#: Folds of the identifiers. A text is judged by the model of the trusted texts of the other folds, be it trusted or not.
HELD_OUT = 5
#: Trusted identifiers up to which they are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Text bytes of a block (one text at least), text bytes that a task holds in unfinished blocks, and bytes whose
#: n-grams are computed at once.
BLOCK_BYTES, HELD_BYTES, PIECE = 2 << 20, 16 << 20, 1 << 18
#: Distinct n-grams of blocks, of all languages together, that a task holds before it passes counts on.
HELD_GRAMS = 400_000
#: N-grams of one shard of the model: at most, and below which a smaller model is not cut further.
SHARD_GRAMS, LEAST_SHARD = 500_000, 50_000
UNKNOWN = "und"
#: Languages up to which their discounts are broadcast; more meet the counts in a salted join.
FEW_LANGUAGES, SALTS = 10_000, 64


def language(docs: DataFrame, lang_col: str):
    return F.coalesce(docs[lang_col].cast("string"), F.lit(UNKNOWN))


class Texts:
    """Texts one after the other as bytes, and the n-grams that end at each of their bytes."""

    def __init__(self, texts: pa.Array):
        column = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.raw = (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[offsets[0] : offsets[-1]]
        #: where each text starts, and, last, where the last one ends
        self.starts = (offsets - offsets[0]).astype(np.int64)

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        """First byte, and the n-grams that end at it and at the following ones, for all bytes in order."""
        n = len(self.raw)
        for at in range(0, n, PIECE):
            to = min(at + PIECE, n)
            base = max(0, at - ORDER + 1)
            own = self.raw[base:to].astype(np.int64)
            packed = own.copy()
            for k in range(1, ORDER):
                packed[k:] |= own[:-k] << 8 * k
            packed = packed[at - base :]
            # The first bytes of a text have zero bytes before them, not the text before.
            for k in range(ORDER - 1):
                first = self.starts[(self.starts + k >= at) & (self.starts + k < to)] + k - at
                packed[first] &= (1 << 8 * (k + 1)) - 1
            yield at, packed

    def distinct(self) -> np.ndarray:
        """The n-grams of all texts, ascending."""
        import pandas as pd

        parts = [pd.unique(p) for _, p in self.pieces()]
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


def blocks_of(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[str, int, pa.RecordBatch, Texts]]:
    """Language, fold, rows and texts of each block of ``row, lang, fold, trusted``; ``text`` is a field of ``row``."""
    held: dict[tuple[str, int], list[pa.RecordBatch]] = {}
    size: dict[tuple[str, int], int] = {}

    def block(key: tuple[str, int]):
        size.pop(key)
        rows = pa.Table.from_batches(held.pop(key)).combine_chunks().to_batches()[0]
        return *key, rows, Texts(rows.column(0).field(text))

    for b in batches:
        if not b.num_rows:
            continue
        lengths = np.diff(Texts(b.column(0).field(text)).starts)
        names = b.column(1).dictionary_encode()
        group = names.indices.to_numpy() * HELD_OUT + b.column(2).to_numpy()
        for g in np.unique(group).tolist():
            rows = np.flatnonzero(group == g)
            key = (names.dictionary[g // HELD_OUT].as_py(), g % HELD_OUT)
            run = np.cumsum(lengths[rows]) // BLOCK_BYTES
            cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(rows)]
            for x, y in zip(cuts, cuts[1:]):
                held.setdefault(key, []).append(b.take(pa.array(rows[x:y])))
                size[key] = size.get(key, 0) + int(lengths[rows[x:y]].sum())
                if size[key] >= BLOCK_BYTES:
                    yield block(key)
        while sum(size.values()) > HELD_BYTES:
            yield block(max(size, key=size.get))
    for key in list(held):
        yield block(key)


def count_grams(rows: DataFrame, text: str) -> DataFrame:
    """``lang, gram, n0, n1, ...`` over ``row, lang, fold, trusted``: every n-gram, counted in the trusted texts
    of all folds but the one of the column's number."""
    names = [f"n{k}" for k in range(HELD_OUT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        held: dict[str, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        total = 0

        def out() -> Iterator[pa.RecordBatch]:
            while held:
                name, parts = held.popitem()
                codes, keys = pd.factorize(np.concatenate([p[0] for p in parts]))
                sums, at = np.zeros((len(keys), HELD_OUT), np.int64), 0
                for own, n, fold in parts:
                    sums[codes[at : at + len(own)], fold] += n  # an n-gram occurs once in a part
                    at += len(own)
                yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(np.zeros(len(keys), np.int32), [name]).cast(pa.string()), pa.array(keys), *(pa.array(sums[:, k]) for k in range(HELD_OUT))], names=["lang", "gram", *names])

        for name, fold, block, texts in blocks_of(batches, text):
            own = texts.distinct()
            n = np.zeros(len(own), np.int64)
            trusted = block.column(3).to_numpy(zero_copy_only=False)
            if trusted.any():
                for at, packed in texts.pieces():
                    codes, keys = pd.factorize(packed)
                    which = trusted[np.searchsorted(texts.starts, np.arange(at, at + len(packed)), side="right") - 1]
                    n[np.searchsorted(own, keys)] += np.bincount(codes[which], minlength=len(keys))
            held.setdefault(name, []).append((own, n, fold))
            total += len(own)
            if total > HELD_GRAMS:
                yield from out()
                total = 0
        yield from out()

    counts = rows.mapInArrow(lean(run), f"lang string, gram bigint, {', '.join(f'{c} bigint' for c in names)}")
    counts = counts.groupBy("lang", "gram").agg(*(F.sum(c).alias(c) for c in names))
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return counts.select("lang", "gram", *((total - F.col(c)).alias(c) for c in names))


def discounts(counts: DataFrame, names: list[str]) -> DataFrame:
    """Modified Kneser-Ney discounts of one order by language, from the counts of counts: for each column
    ``n`` of ``names``, ``n_d1, n_d2, n_d3``."""
    n = [F.sum(F.when(F.col(c) == k, 1).otherwise(0)).cast("double").alias(f"{c}_{k}") for c in names for k in (1, 2, 3, 4)]
    t = counts.groupBy("lang").agg(*n)

    def d(c: str, k: int):
        y = F.try_divide(f"{c}_1", F.col(f"{c}_1") + 2 * F.col(f"{c}_2"))
        raw = k - (k + 1) * y * F.try_divide(f"{c}_{k + 1}", f"{c}_{k}")
        return F.least(F.greatest(F.coalesce(raw, F.lit(k / 2)), F.lit(k / 20)), F.lit(float(k))).alias(f"{c}_d{k}")

    return t.select("lang", *(d(c, k) for c in names for k in (1, 2, 3)))


def train(counts: DataFrame) -> DataFrame:
    """``lang, gram`` and, for each column of counts, the log probability of the last byte of every n-gram of
    the corpus: ``logp, logp1, logp2, ...``.

    ``counts`` holds every n-gram of the corpus, with 0 for those not in trusted text, so that no lookup
    fails later. Lower orders count the distinct bytes before an n-gram; each order joins the one below.
    """
    names = counts.columns[2:]
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        up, mask = levels[k + 1], (1 << 8 * k) - 1
        suffix = F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")
        levels[k] = up.groupBy("lang", suffix).agg(*(F.sum((F.col(c) > 0).cast("long")).alias(c) for c in names))
    few = counts.select("lang").distinct().limit(FEW_LANGUAGES + 1).count() <= FEW_LANGUAGES
    probability = None
    for k in range(1, ORDER + 1):
        # Never dealt by language alone: most n-grams may be of one language.
        rates = discounts(levels[k], names)
        if few:
            own = levels[k].join(F.broadcast(rates), "lang", "left")
        else:
            salted = levels[k].withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)).cast("int"))
            spread = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            own = salted.join(spread.hint("merge"), ["lang", "salt"], "left").drop("salt")
        context = W.partitionBy("lang", "context")  # at most 256 rows
        own = own.withColumn("context", F.shiftright("gram", 8))
        d = lambda c: F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, F.col(f"{c}_d1")).when(F.col(c) == 2, F.col(f"{c}_d2")).otherwise(F.col(f"{c}_d3"))
        own = own.select("lang", "gram", "context", *names, *(d(c).alias(f"{c}_d") for c in names))
        own = own.select("*", *(F.sum(c).over(context).alias(f"{c}_total") for c in names), *(F.sum(f"{c}_d").over(context).alias(f"{c}_left") for c in names))
        seen = lambda c: F.col(f"{c}_total") > 0
        here = {c: F.when(seen(c), (F.col(c) - F.col(f"{c}_d")) / F.col(f"{c}_total")).otherwise(0.0) for c in names}
        rest = {c: F.when(seen(c), F.col(f"{c}_left") / F.col(f"{c}_total")).otherwise(1.0) for c in names}
        if k == 1:
            probability = own.select("lang", "gram", *((here[c] + rest[c] / 256).alias(c) for c in names))
        else:
            own = own.select("lang", "gram", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("lower"), *(here[c].alias(f"{c}_here") for c in names), *(rest[c].alias(f"{c}_rest") for c in names))
            below = probability.select("lang", F.col("gram").alias("lower"), *(F.col(c).alias(f"{c}_below") for c in names))
            mixed = lambda c: (F.col(f"{c}_here") + F.col(f"{c}_rest") * F.col(f"{c}_below")).alias(c)
            probability = own.join(below, ["lang", "lower"]).select("lang", "gram", *map(mixed, names))
    return probability.select("lang", "gram", *(F.log(c).cast("float").alias(f"logp{i or ''}") for i, c in enumerate(names)))


def mark_trusted(docs: DataFrame, trusted: DataFrame, id_col: str, lang_col: str) -> DataFrame:
    """``row`` (all columns of ``docs``), ``lang``, ``fold`` and ``trusted``; ``trusted`` holds the identifiers of
    trusted texts. The result is read more than once: rows come in the same order each time."""
    ids = trusted.select(F.col(trusted.columns[0]).alias("id")).filter("id IS NOT NULL").distinct().withColumn("known", F.lit(True))
    docs = steady(docs)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), language(docs, lang_col).alias("lang"), fold_of(docs[id_col]).cast("int").alias("fold"))
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    joined = rows.join(F.broadcast(ids) if small else ids.hint("merge"), F.col("row").getField(id_col) == ids["id"], "left")
    marked = joined.select("row", "lang", "fold", F.coalesce("known", F.lit(False)).alias("trusted"))
    return marked if small else written(marked, "marked")


def fold_of(id_col):
    return F.pmod(F.xxhash64((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")), F.lit(HELD_OUT))


def word_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where, in the texts one after the other, a word starts: after white space, and every WORD bytes."""
    first = np.zeros(len(raw), bool)
    first[1:] = raw[:-1] <= 32
    first[starts[:-1][np.diff(starts) > 0]] = True
    at = np.flatnonzero(first)
    times = -(-np.diff(np.append(at, len(raw))) // WORD)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(at, times) + WORD * nth


def local(sums: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LOCAL of each text that is not empty, in nats a byte, from the log probabilities of its words."""
    first = np.searchsorted(words, starts[:-1][np.diff(starts) > 0])
    size = np.diff(np.append(words, starts[-1]))
    worst = np.maximum.reduceat(-sums / np.maximum(size, SHORT_WORD), first)
    # A stretch starts at each word that has enough words of its text behind it, and at the text's first.
    end = np.repeat(np.append(first[1:], len(words)), np.diff(np.append(first, len(words))))
    at = np.arange(len(words))
    valid = at + STRETCH <= end
    valid[first] = True
    to = np.minimum(at + STRETCH, end)
    total, length = np.concatenate([[0.0], np.cumsum(-sums)]), np.append(words, starts[-1])
    mean = (total[to] - total[at]) / (length[to] - length[at])
    return worst, np.minimum.reduceat(np.where(valid, mean, np.inf), first), np.maximum.reduceat(np.where(valid, mean, -np.inf), first)


def block_key(lang: str, fold: int, texts: Texts) -> bytes:
    """Digest of a block's texts: the same in each reading of a table."""
    from xxhash import xxh3_128

    h = xxh3_128(f"{lang} {fold} ".encode())
    h.update(texts.starts.tobytes())
    h.update(np.ascontiguousarray(texts.raw))
    return h.digest()


def requests(rows: DataFrame, text: str, shards: int) -> DataFrame:
    """``block, shard, lang, fold, grams``: the distinct n-grams that each block asks of each shard of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for lang, fold, _, texts in blocks_of(batches, text):
            own = texts.distinct()
            shard = own % shards
            order = np.argsort(shard, kind="stable")
            own, at = own[order], np.searchsorted(shard[order], np.arange(shards + 1))
            asked = np.flatnonzero(np.diff(at))
            grams = [pack.compress(np.diff(own[at[k] : at[k + 1]], prepend=0).tobytes()) for k in asked.tolist()]
            n = len(asked)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block_key(lang, fold, texts)] * n, pa.binary()), pa.array(asked.astype(np.int32)), pa.array([lang] * n, pa.string()), pa.array([fold] * n, pa.int32()), pa.array(grams, pa.binary())],
                names=["block", "shard", "lang", "fold", "grams"],
            )

    return rows.mapInArrow(lean(run), "block binary, shard int, lang string, fold int, grams binary")


def answers(asked: DataFrame, model: DataFrame, shards: int) -> DataFrame:
    """``block, shard, values``: the log probabilities (32-bit floats) of the n-grams that ``asked`` holds.

    A task reads the n-grams of one shard, and then the requests to it one batch at a time.
    """
    columns = [F.array(*model.columns[2:]).alias("logp"), *(F.lit(None).cast(t).alias(c) for c, t in (("block", "binary"), ("fold", "int"), ("grams", "binary")))]
    held = model.select(F.pmod("gram", F.lit(shards)).cast("int").alias("shard"), "lang", "gram", *columns)
    asks = asked.select("shard", "lang", F.lit(None).cast("bigint").alias("gram"), F.lit(None).cast("array<float>").alias("logp"), "block", "fold", "grams")
    both = held.unionByName(asks).repartitionById(shards, "shard")
    both = both.sortWithinPartitions(F.col("block").isNotNull(), "lang", "gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        loaded: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            split = int(np.count_nonzero(b.column(4).is_null().to_numpy(zero_copy_only=False)))
            if split:  # n-grams of the model, ascending in each language
                part = b.slice(0, split)
                lang = part.column(1).dictionary_encode()
                code = lang.indices.to_numpy()
                gram, logp = part.column(2).to_numpy(), part.column(3).flatten().to_numpy().reshape(split, -1)
                for i, name in enumerate(lang.dictionary.to_pylist()):
                    own = code == i
                    loaded.setdefault(name, []).append((gram[own], logp[own]))
            rest = b.slice(split)
            if not rest.num_rows:
                continue
            while loaded:
                name, parts = loaded.popitem()
                tables[name] = tuple(np.concatenate(x) for x in zip(*parts))
            values = []
            for name, fold, grams in zip(*(rest.column(c).to_pylist() for c in (1, 5, 6))):
                own = np.cumsum(np.frombuffer(unpack.decompress(grams), np.int64))
                keys, logp = tables[name]
                at = np.searchsorted(keys, own)
                if at[-1] >= len(keys) or (keys[at] != own).any():
                    raise ValueError("the table changed while it was read: an n-gram of it was not counted")
                values.append(pack.compress(logp[at, fold].tobytes()))
            yield pa.RecordBatch.from_arrays([rest.column(4), rest.column(0), pa.array(values, pa.binary())], names=["block", "shard", "values"])

    return both.mapInArrow(lean(run), "block binary, shard int, values binary")


def packed_blocks(rows: DataFrame, text: str) -> DataFrame:
    """``block, lang, data``: each block with its compressed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for lang, fold, block, texts in blocks_of(batches, text):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema) as out:
                out.write_batch(block)
            yield pa.RecordBatch.from_arrays([pa.array([block_key(lang, fold, texts)], pa.binary()), pa.array([lang]), pa.array([pack.compress(sink.getvalue())], pa.binary())], names=["block", "lang", "data"])

    return rows.mapInArrow(lean(run), "block binary, lang string, data binary")


def scored_blocks(blocks: DataFrame, found: DataFrame, row_type: str, text: str, shards: int) -> DataFrame:
    """``row, lang, trusted, bytes, logp`` (summed over the text's bytes) and LOCAL, of all rows of ``blocks``;
    ``found`` has the answers to their requests."""
    left = found.select("block", "shard", "values", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("binary").alias("data"))
    right = blocks.select("block", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("values"), "lang", "data")
    both = left.unionByName(right).repartition(shuffle_partitions(blocks.sparkSession), "block").sortWithinPartitions("block", F.col("data").isNotNull())

    def score(block: pa.RecordBatch, lang: str, values: dict[int, bytes]) -> pa.RecordBatch:
        import pandas as pd

        texts = Texts(block.column(0).field(text))
        raw, starts = texts.raw, texts.starts
        n, size = block.num_rows, np.diff(texts.starts)
        logp, own = np.zeros(n), np.full((len(LOCAL), n), np.nan)
        if len(raw):
            keys = texts.distinct()
            at, answer = keys % shards, np.empty(len(keys), np.float32)
            for k in np.unique(at).tolist():
                if k not in values:
                    raise ValueError("the table changed while it was read: a block has no answer")
                answer[at == k] = np.frombuffer(values[k], np.float32)
            words = word_starts(raw, starts)
            sums = np.zeros(len(words))
            for first, packed in texts.pieces():
                codes, distinct = pd.factorize(packed)
                value = answer[np.searchsorted(keys, distinct)].astype(np.float64)[codes]
                a, b = int(np.searchsorted(words, first, side="right")) - 1, int(np.searchsorted(words, first + len(packed)))
                sums[a:b] += np.add.reduceat(value, np.maximum(words[a:b] - first, 0))
            at = np.searchsorted(words, starts)
            logp = np.diff(np.concatenate([[0.0], np.cumsum(sums)])[at])
            own[:, size > 0] = local(sums, words, starts)
        return pa.RecordBatch.from_arrays([block.column(0), pa.array([lang] * n, pa.string()), block.column(3), pa.array(size), pa.array(logp), *(pa.array(x, from_pandas=True) for x in own)], names=["row", "lang", "trusted", "bytes", "logp", *LOCAL])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        key, values = None, {}
        for b in batches:
            for i in range(b.num_rows):
                if (own := b.column(0)[i].as_py()) != key:
                    key, values = own, {}
                data = b.column(4)[i].as_py()
                if data is None:
                    values[b.column(1)[i].as_py()] = unpack.decompress(b.column(2)[i].as_py())
                    continue
                with pa.ipc.open_stream(unpack.decompress(data)) as source:
                    for block in source:
                        yield score(block, b.column(3)[i].as_py(), values)

    return both.mapInArrow(lean(run), f"row {row_type}, lang string, trusted boolean, bytes bigint, logp double, {', '.join(f'{c} double' for c in LOCAL)}")


def quality_model(rows: DataFrame, text: str) -> DataFrame:
    """The written table ``lang, gram, logp, logp1, ...`` of a corpus (``row, lang, fold, trusted``): a model for
    each fold, which has not seen the trusted texts of that fold."""
    counts = written(count_grams(rows, text), "counts")
    model = written(train(counts), "model")
    discard(counts)
    return model


def score(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``lang, trusted, bytes, logp`` and LOCAL of every row of ``docs``.

    Shuffled are the n-gram counts, each block's distinct n-grams and their log probabilities, and the blocks
    themselves, compressed, once. What a task holds is bounded by a shard of the model and a few blocks.
    """
    rows = mark_trusted(docs, trusted, id_col, lang_col)
    model = quality_model(rows, text_col)
    n = model.count()
    shards = max(1, math.ceil(n / SHARD_GRAMS), min(shuffle_partitions(docs.sparkSession), math.ceil(n / LEAST_SHARD)))
    found = answers(requests(rows, text_col, shards), model, shards)
    return scored_blocks(packed_blocks(rows, text_col), found, rows.schema["row"].dataType.simpleString(), text_col, shards)


def limits_of(scores: DataFrame, low: float, high: float) -> DataFrame:
    """Per language its trusted texts and their quantiles (no text was seen by the model that scored it):
    ``own, n_trusted, low, high, word_high, dull_low, odd_high``.

    Values are counted in cells of 1/GRID, so that the limits do not depend on the order of rows; a limit is
    the outermost value of its quantile's cell.
    """
    s = scores.filter("trusted AND bytes > 0").select("lang", F.exp(-F.col("logp") / F.col("bytes")).alias("p"), *LOCAL)
    wanted = {"low": ("p", low), "high": ("p", high), "word_high": ("word", high), "dull_low": ("dull", low), "odd_high": ("odd", high)}
    each = s.select("lang", F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).cast("double").alias("x")) for c in ("p", *LOCAL)))).alias("v"))
    each = each.select("lang", "v.what", "v.x").filter("x IS NOT NULL")
    cells = each.groupBy("lang", "what", F.floor(F.col("x") * GRID).alias("cell")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    upto = W.partitionBy("lang", "what").orderBy("cell")  # cells, not texts
    cells = cells.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy("lang", "what")))
    outer = lambda name: F.col("most" if name.endswith("high") else "least")
    reached = lambda x: F.col("upto") >= F.greatest(F.ceil(x * F.col("all")), F.lit(1))
    limit = lambda name, what, x: F.min(F.when((F.col("what") == what) & reached(F.lit(x)), outer(name))).alias(name)
    n = F.max(F.when(F.col("what") == "p", F.col("all"))).alias("n_trusted")
    return cells.groupBy(F.col("lang").alias("own")).agg(n, *(limit(name, what, x) for name, (what, x) in wanted.items()))


def judged(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """``scores`` with ``perplexity, n_trusted, low, high, judged, accepted``; ``limits`` has one row a language."""
    s = scores.withColumn("perplexity", F.when(F.col("bytes") > 0, F.exp(-F.col("logp") / F.col("bytes"))))
    s = s.join(limits, s["lang"] == limits["own"], "left")
    fine = F.col("perplexity").between(F.col("low"), F.col("high")) & (F.col("word") <= F.col("word_high")) & (F.col("dull") >= F.col("dull_low")) & (F.col("odd") <= F.col("odd_high"))
    s = s.withColumn("judged", F.col("low").isNotNull())
    return s.withColumn("accepted", F.coalesce((F.col("bytes") > 0) & (~F.col("judged") | fine), F.lit(False)))


def classify(docs: DataFrame, trusted: DataFrame, low: float = LOW, high: float = HIGH, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Perplexity and verdict of every text: ``id_col, lang, n_bytes, perplexity, low, high, n_trusted, judged,
    accepted``.

    ``trusted`` holds, in its first column, the identifiers of trusted texts. A text is accepted when its
    perplexity per byte lies between its language's ``low`` and ``high`` quantiles of the ``n_trusted`` trusted
    texts: above stands what the language does not look like, below what repeats itself. So must its least
    likely word lie below the ``high`` quantile of the trusted texts' least likely words (a few bad words hardly
    move the mean), and its stretches of STRETCH words between those of theirs. Every text, trusted or not, is
    scored by the model that has seen no trusted text of its fold, so that the limits hold for tables of any
    size. Null and empty texts have no perplexity and are not accepted; texts of any length are scored whole; a
    null language is the language ``und``; where a language has no trusted text, ``judged`` is false, the
    limits are null and every text is accepted; ids may be null (never trusted) or repeat, and texts that tie
    with a limit are accepted; an empty table gives no rows; further columns are ignored, whatever their names.
    """
    s = score(docs.select(id_col, lang_col, text_col), trusted, id_col, lang_col, text_col)
    s = written(s.select(F.col("row").getField(id_col).alias("id"), "lang", "trusted", "bytes", "logp", *LOCAL), "scores")
    out = judged(s, written(limits_of(s, low, high), "limits"))
    return out.select(F.col("id").alias(id_col), F.col("lang").alias("lang"), F.col("bytes").alias("n_bytes"), "perplexity", "low", "high", F.coalesce("n_trusted", F.lit(0).cast("long")).alias("n_trusted"), "judged", "accepted")


def accepted_rows(docs: DataFrame, trusted: DataFrame, low: float = LOW, high: float = HIGH, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`classify` accepts, with all their columns."""
    s = written(score(docs, trusted, id_col, lang_col, text_col), "scores")
    return judged(s, written(limits_of(s, low, high), "limits")).filter("accepted").select("row.*")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic."""
    return labels.filter("quality = 1 AND toxic = 0").select("doc_id")
