"""Near-duplicates: many universal hash minima, banding, verification, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pestle.llm.common import discard, lean, shuffle_partitions, text_of, written
from pestle.llm.components import components

#: 40 bands of 5 minima miss a pair of similarity 0.8 once in 8 million, and meet one of 0.1 once in 2500.
BANDS, ROWS = 40, 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Share of equal minima (of 200) below which a candidate is not compared in full: 7 standard errors below.
SIGNATURE_LEAST = 0.6
#: Nodes of either side that one block comparison inside a family holds, about.
BLOCK = 512
SEED = 20_240_607
M1, M2, M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a text; word hashes are remembered."""

    def __init__(self, size: int, cached: int = 100_000):
        self.size, self.cached, self.known = size, cached, {}

    def words(self, text: str) -> list[bytes]:
        """Maximal stretches of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased."""
        return text.encode("utf-8").lower().split()

    def __call__(self, text: str) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        tokens, known = self.words(text), self.known
        if not tokens:
            return np.empty(0, np.uint64)
        hashes = []
        for w in tokens:
            h = known.get(w)
            if h is None:
                if len(known) >= self.cached:
                    known.clear()
                h = known[w] = xxh3_64_intdigest(w)
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        k = min(self.size, len(h))
        n = len(h) - k + 1
        acc = np.full(n, k, np.uint64)
        for i in range(k):
            acc = mixed(acc * M3 + h[i : i + n])
        return np.unique(acc)


class MinHasher:
    """Minima of ``a * x + b`` over 2**32, one pair (a, b) for each of the ``bands * rows`` functions."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = bands * rows
        self.a = (rng.integers(0, 2**32, n, np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, n, np.uint32)[:, None]
        self.bands, self.rows = bands, rows

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 512):
            v = self.a * x[None, i : i + 512]
            v += self.b
            np.minimum(out, v.min(axis=1), out=out)
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key for each row and band."""
        s = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        acc = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64) * M3, s.shape[:2])
        for i in range(self.rows):
            acc = mixed(acc * M3 + s[:, :, i])
        return acc.astype(np.int64)


def sketch(docs: DataFrame, size: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``id, row, n, digest, minima, low, packed``: set size, digest of the set, minima and their lowest bytes,
    compressed text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from xxhash import xxh3_128_digest

        shingler, hasher, pack = Shingler(size), MinHasher(bands, rows), zstandard.ZstdCompressor(level=1)
        for b in batches:
            n, digest, minima, low, packed = [], [], [], [], []
            for t in b.column(2):
                text = t.as_py()
                s = shingler(text)
                n.append(len(s))
                digest.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                signature = hasher.signature(s) if len(s) else None
                minima.append(None if signature is None else signature.tobytes())
                low.append(None if signature is None else signature.astype(np.uint8).tobytes())
                packed.append(pack.compress(text.encode("utf-8")) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(minima, pa.binary()), pa.array(low, pa.binary()), pa.array(packed, pa.binary())], names=["id", "row", "n", "digest", "minima", "low", "packed"])

    rows_in = docs.select(docs[id_col].alias("id"), F.monotonically_increasing_id().alias("row"), text_of(docs[text_col]).alias("text"))
    return rows_in.mapInArrow(lean(run), f"id {kind}, row bigint, n bigint, digest binary, minima binary, low binary, packed binary")


def band_keys(sketches: DataFrame, bands: int, rows: int) -> DataFrame:
    """``key, node``: the buckets of every sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(bands, rows)
        for b in batches:
            if b.num_rows:
                s = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, -1)
                keys = hasher.keys(s)
                node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], names=["key", "node"])

    return sketches.select("node", "minima").mapInArrow(lean(run), "key bigint, node bigint")


def bucket_pairs(members: DataFrame, families: DataFrame, lows: DataFrame) -> DataFrame:
    """``u, v``: pairs of one bucket whose nodes are of different families and whose minima agree, by their
    lowest bytes, often enough. ``members``: ``key, node, n``; ``lows``: ``node, low``.

    Buckets are dealt in pairs of blocks of about ``2 * BLOCK`` nodes, so a bucket of any size is spread, and
    pairs are compared inside a task: only those become rows that join families of the two blocks, the most alike
    first. What else agrees lies in one family then, where :func:`family_links` compares it in full.
    """
    placed = members.join(families.select("node", F.col("component").alias("c")).hint("merge"), "node", "left").select("key", "node", "n", F.coalesce("c", "node").alias("family"))
    blocks = F.ceil(F.col("n") / (2 * BLOCK)).cast("long")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), blocks))
    # Buckets of one family need no comparison; they are found, and left out, by (bucket, block), never by bucket alone.
    some = placed.groupBy("key", "own", "n").agg(F.min("family").alias("a"), F.max("family").alias("b"))
    mixed = some.groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.first("n").alias("n")).filter("a <> b")
    mixed = mixed.select("key", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("own"))
    placed = placed.join(mixed.hint("merge"), ["key", "own"], "left_semi")
    placed = placed.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = placed.select("key", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", "node", "family").join(lows.hint("merge"), "node")
    dealt = dealt.select("key", "i", "j", "own", "node", "family", "low").repartition(shuffle_partitions(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(own: np.ndarray, node: np.ndarray, family: np.ndarray, low: list[bytes], two: bool) -> tuple[np.ndarray, np.ndarray]:
        m = np.frombuffer(b"".join(low), np.uint8).reshape(len(low), -1)
        us, vs, sames = [], [], []
        step = max(1, 4_000_000 // m.size)
        for at in range(0, len(m), step):
            agree = np.count_nonzero(m[at : at + step, None, :] == m[None, :, :], axis=2)
            hit = (agree >= SIGNATURE_LEAST * m.shape[1]) & (family[at : at + step, None] != family[None, :]) & (node[at : at + step, None] > node[None, :])
            if two:
                hit &= own[at : at + step, None] != own[None, :]
            x, y = np.nonzero(hit)
            us.append(x + at)
            vs.append(y)
            sames.append(agree[x, y])
        return spanning(np.concatenate(us), np.concatenate(vs), np.concatenate(sames), node, family)

    def spanning(u: np.ndarray, v: np.ndarray, same: np.ndarray, node: np.ndarray, family: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all pairs those, most alike first, that join families not joined yet: fewer than there are families."""
        order = np.argsort(-same, kind="stable")
        a, b = np.minimum(family[u], family[v])[order], np.maximum(family[u], family[v])[order]
        _, first = np.unique(np.stack([a, b], 1), axis=0, return_index=True)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        keep = []
        for i in np.sort(first).tolist():
            p, q = top(int(a[i])), top(int(b[i]))
            if p != q:
                root[p] = q
                keep.append(order[i])
        return node[u[keep]], node[v[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table) -> pa.RecordBatch:
            key, i, j, own, node, family = (table.column(c).to_numpy() for c in range(6))
            low = table.column(6).to_pylist()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            found: set[tuple[int, int]] = set()
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)]):
                if b - a > 1:
                    u, v = compare(own[a:b], node[a:b], family[a:b], low[a:b], bool(i[a] != j[a]))
                    found.update(zip(u.tolist(), v.tolist()))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            # The last group of a batch may go on in the next one.
            tail = np.ones(b.num_rows, bool)
            for c in range(3):
                col = b.column(c).to_numpy(zero_copy_only=False)
                tail &= col == col[-1]
            first = b.num_rows - int(np.argmin(tail[::-1])) if not tail.all() else 0
            if first:
                yield groups(pa.Table.from_batches([*held, b.slice(0, first)]))
                held = [b.slice(first)]
            else:
                held.append(b)
        if held:
            yield groups(pa.Table.from_batches(held))

    return dealt.mapInArrow(lean(run), "u bigint, v bigint").distinct()


def verified(pairs: DataFrame, sketches: DataFrame, size: int, percent: int) -> DataFrame:
    """``u, v, link``: the ``pairs`` (``u, v``) whose signatures are alike, and whether they are links.

    Both joins are plain equi-joins, so a hub's rows are split by adaptive execution; rows arrive sorted by
    the second node, whose set is made once for each run of rows.
    """
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("minima").alias(f"m_{x}"), F.col("packed").alias(f"p_{x}"))
    both = pairs.join(side("u").hint("merge"), "u").join(side("v").hint("merge"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shingler, unpack = Shingler(size), zstandard.ZstdDecompressor()
        shingles = lambda p: shingler(unpack.decompress(p).decode("utf-8"))
        last, last_set = None, None
        for b in batches:
            us, vs = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep, link = [], []
            for i, (u, v) in enumerate(zip(us, vs)):
                mu, mv = (np.frombuffer(b.column(c)[i].as_py(), np.uint32) for c in (2, 3))
                if np.count_nonzero(mu == mv) < SIGNATURE_LEAST * len(mu):
                    continue
                if v != last:
                    last, last_set = v, shingles(b.column(5)[i].as_py())
                x = shingles(b.column(4)[i].as_py())
                common = len(np.intersect1d(x, last_set, assume_unique=True))
                keep.append(i)
                link.append(100 * common >= percent * (len(x) + len(last_set) - common))
            yield pa.RecordBatch.from_arrays([pa.array([us[i] for i in keep], pa.int64()), pa.array([vs[i] for i in keep], pa.int64()), pa.array(link, pa.bool_())], names=["u", "v", "link"])

    return both.select("u", "v", "m_u", "m_v", "p_u", "p_v").mapInArrow(lean(run), "u bigint, v bigint, link boolean")


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``."""
    out = np.zeros((len(a), len(b)))  # whole numbers, exact in double precision
    ids = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    keys, code, times = np.unique(ids, return_inverse=True, return_counts=True)
    several = times > 1
    number = np.cumsum(several) - 1
    ok = several[code]
    owner, column = owner[ok], number[code[ok]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(several.sum()), 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((len(a) + len(b), 4096), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def family_links(families: DataFrame, links: DataFrame, sketches: DataFrame, size: int, percent: int) -> DataFrame:
    """The links between different components of one family (``node, component``), by exact comparison.

    Only nodes outside their family's largest component are compared, with all others of the family: both
    sides are dealt into blocks of about ``BLOCK`` nodes, and each pair of blocks is one group, in which
    a matrix product counts all intersections at once. Of the links found there, those that join further
    components are returned.
    """
    placed = families.select("node", F.col("component").alias("family")).join(links.hint("merge"), "node", "left")
    placed = placed.select("node", "family", F.coalesce("component", "node").alias("part"))
    parts = placed.groupBy("family", "part").agg(F.count("*").alias("n"))
    shape = parts.groupBy("family").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.min(F.struct((-F.col("n")).alias("m"), "part")).alias("top"))
    shape = shape.filter("parts > 1").select("family", F.col("top.part").alias("main"), F.ceil(F.col("n") / BLOCK).alias("all"), F.ceil((F.col("n") + F.col("top.m")) / BLOCK).alias("few"))
    placed = written(placed.join(shape.hint("merge"), "family"), "families")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = placed.filter("part <> main").select("family", block("few").alias("i"), every("all").alias("j"), "node", "part", F.lit(True).alias("minor"))
    right = placed.select("family", every("few").alias("i"), block("all").alias("j"), "node", "part", F.lit(False).alias("minor"))
    rows = left.unionByName(right).join(sketches.select("node", "packed").hint("merge"), "node")

    def run(frame):
        import pandas as pd
        import zstandard

        shingler, unpack = Shingler(size), zstandard.ZstdDecompressor()
        sets = [shingler(unpack.decompress(p).decode("utf-8")) for p in frame["packed"]]
        minor = frame["minor"].to_numpy(bool)
        node, part = frame["node"].to_numpy(), frame["part"].to_numpy()
        a, b = np.flatnonzero(minor), np.flatnonzero(~minor)
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        common = common_counts([sets[k] for k in a], [sets[k] for k in b])
        n = np.array([len(s) for s in sets])
        hit = (100 * common >= percent * (n[a][:, None] + n[b][None, :] - common)) & (part[a][:, None] != part[b][None, :])
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(hit)):
            p, q = top(part[a[x]]), top(part[b[y]])
            if p != q:
                root[p] = q
                out.append((node[a[x]], node[b[y]]))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return rows.groupBy("family", "i", "j").applyInPandas(run, "u bigint, v bigint")


def near_dedup(docs: DataFrame, size: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id, kept``.

    Words are maximal stretches of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; a text's set is its distinct
    shingles of ``size`` words, with fewer words the whole sequence as one. Texts with
    ``100 * intersection >= percent * union`` are linked; ``component_id`` is the smallest id reachable, and
    of each component the row that bears it is kept (of repeated ids one row).

    Equal sets become one node. In each bucket of a band, members are compared with one centre. Nodes whose
    signatures are alike form families; where a bucket holds several families, all its pairs across them
    are compared by signature, and the families of those alike become one. Inside a family, links confirmed on full sets give
    components, and only nodes outside the largest are compared with all others, block by block. So no
    pair that shares a bucket goes untested, and no task or row stands for all pairs of a group.

    Null, empty and blank texts have an empty set and are linked with nothing; a null id is larger than any
    other; repeated rows are linked with each other; an empty table gives no rows; further columns are
    ignored.
    """
    all_rows = written(sketch(docs, size, bands, rows, id_col, text_col), "sketches")
    light = all_rows.select("id", "row", "n", "digest")
    classes = written(light.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("node")), "classes")
    nodes = all_rows.select(F.col("row").alias("node"), "minima", "packed")
    sketches = nodes.join(classes.select("node").hint("merge"), "node", "left_semi")

    keys = band_keys(all_rows.select(F.col("row").alias("node"), "minima").join(classes.select("node").hint("merge"), "node", "left_semi"), bands, rows)
    keys = written(keys, "keys")
    buckets = keys.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    members = written(keys.join(buckets.hint("merge"), "key"), "members")
    discard(keys)
    pairs = written(members.filter("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct(), "pairs")
    alike = written(verified(pairs, sketches, size, percent), "alike")
    families = written(components(alike), "families")
    lows = all_rows.select(F.col("row").alias("node"), "low")
    new = bucket_pairs(members.filter("n > 2").select("key", "node", "n"), families, lows)
    new = written(new.join(pairs.hint("merge"), ["u", "v"], "left_anti"), "pairs")
    discard(members, pairs)
    if not new.isEmpty():
        more = written(verified(new, sketches, size, percent), "alike")
        alike = alike.unionByName(more)
        families = written(components(alike), "families")

    links = alike.filter("link").select("u", "v")
    found = written(components(links), "components")
    inner = written(family_links(families, found, sketches, size, percent), "inner")
    if not inner.isEmpty():
        joined = found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(inner)
        found = written(components(joined), "components")

    where = classes.join(found.hint("merge"), "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    full = light.filter("digest IS NOT NULL").join(where.hint("merge"), "digest").select("id", "row", "n", "component")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    firsts = full.groupBy("component").agg(F.min(order).alias("f")).select("component", F.col("f.id").alias("first_id"), F.col("f.row").alias("first_row"))
    linked = full.join(firsts.hint("merge"), "component").select("id", "n", F.col("first_id").alias("component_id"), (F.col("row") == F.col("first_row")).alias("kept"))
    alone = light.filter("digest IS NULL").select("id", "n", F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")
