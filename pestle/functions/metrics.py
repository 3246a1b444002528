"""Similarity metrics as Columns: dense fingerprints are arrays of bigint words, sparse ones maps of counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def total(words: Column) -> Column:
    """Bits set."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.bit_count(w))


def in_common(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))


def dense(metric: str, a: Column, b: Column, nbits: int | None = None, alpha: float = 0.5, beta: float = 0.5) -> Column:
    """``tanimoto, tversky, russel_rao, forbes, simple_matching, dice, overlap, cosine, fvb``.

    ``dice`` and ``overlap`` return distances, without the usual factor of two in the former, as the
    tools whose results they match do.
    """
    na, nb, c = total(a).cast("double"), total(b).cast("double"), in_common(a, b).cast("double")
    if metric == "tanimoto":
        return F.when((na == 0) & (nb == 0), 1.0).otherwise(F.coalesce(F.try_divide(c, na + nb - c), F.lit(0.0)))
    if metric == "tversky":
        return F.when((na == 0) & (nb == 0), 1.0).otherwise(F.coalesce(F.try_divide(c, alpha * (na - c) + beta * (nb - c) + c), F.lit(0.0)))
    if metric == "russel_rao":
        return c / nbits
    if metric == "forbes":
        return F.coalesce(F.try_divide(c, na * nb), F.lit(0.0))
    if metric == "simple_matching":
        return (c + (nbits - na - nb + c)) / nbits
    if metric == "dice":
        return 1 - F.coalesce(F.try_divide(c, na + nb), F.lit(0.0))
    if metric == "overlap":
        return 1 - F.coalesce(F.try_divide(c, F.least(na, nb)), F.lit(0.0))
    if metric == "cosine":
        return F.coalesce(F.try_divide(c, F.sqrt(na * nb)), F.lit(0.0))
    if metric == "fvb":
        p = (na + nb) / (2 * nbits)
        t1 = F.coalesce(F.try_divide(c, na + nb - c), F.lit(1.0))
        z = nbits - na - nb + c
        t0 = F.coalesce(F.try_divide(z, (nbits - na) + (nbits - nb) - z), F.lit(1.0))
        return (2 - p) / 3 * t1 + (1 + p) / 3 * t0
    raise ValueError(metric)


def _sums(a: Column, b: Column):
    pairs = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(x, F.lit(0)).cast("double").alias("x"), F.coalesce(y, F.lit(0)).cast("double").alias("y"))))

    def add(f):
        return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + f(p["x"], p["y"]))

    return add


def sparse(metric: str, a: Column, b: Column) -> Column:
    """``tanimoto, binary, continuous, cosine, dot, common, manhattan, soergel`` over counts."""
    add = _sums(a, b)
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    one_empty = (F.size(a) == 0) | (F.size(b) == 0)
    low, ab = add(lambda x, y: F.least(x, y)), add(lambda x, y: x * y)
    aa, bb = add(lambda x, y: x * x), add(lambda x, y: y * y)
    gap = add(lambda x, y: F.abs(x - y))
    ruled = lambda v: F.when(both_empty, 1.0).when(one_empty, 0.0).otherwise(v)
    if metric == "tanimoto":
        return ruled(low / (add(lambda x, y: x + y) - low))
    if metric == "binary":
        return ruled(F.size(F.array_intersect(F.map_keys(a), F.map_keys(b))) / F.size(F.array_union(F.map_keys(a), F.map_keys(b))))
    if metric == "continuous":
        return F.when(one_empty, 0.0).otherwise(ab / (aa + bb - ab))
    if metric == "cosine":
        return F.coalesce(F.try_divide(ab, F.sqrt(aa * bb)), F.lit(0.0))
    if metric == "dot":
        return ab
    if metric == "common":
        return low
    if metric == "manhattan":
        return ruled(1 / (1 + gap))
    if metric == "soergel":
        return ruled(1 - gap / add(lambda x, y: F.greatest(x, y)))
    raise ValueError(metric)


def optimistic_distance(a: Column, b: Column, alpha: float, beta: float) -> Column:
    """1 less the best of both Tversky similarities and Tanimoto; two empty fingerprints have distance 0."""
    best = F.greatest(dense("tversky", a, b, alpha=alpha, beta=beta), dense("tversky", a, b, alpha=beta, beta=alpha), dense("tanimoto", a, b))
    return F.when((total(a) == 0) & (total(b) == 0), 0.0).otherwise(1 - best)


def composite(similarities: list[Column], weights: list[float] | None = None) -> Column:
    """The weighted mean of component similarities, by default with equal weights."""
    weights = weights or [1.0] * len(similarities)
    out = F.lit(0.0)
    for s, w in zip(similarities, weights, strict=True):
        out = out + s * w
    return out / sum(weights)


def composite_present(parts: list[tuple[Column, Column]]) -> Column:
    """The mean Tanimoto of the components (pairs of dense fingerprints) of which at least one side has a bit."""
    some = [(total(a) > 0) | (total(b) > 0) for a, b in parts]
    sums, n = F.lit(0.0), F.lit(0)
    for (a, b), has in zip(parts, some):
        sums = sums + F.when(has, dense("tanimoto", a, b)).otherwise(0.0)
        n = n + F.when(has, 1).otherwise(0)
    return F.when(n == 0, 1.0).otherwise(F.try_divide(sums, n))


def pooled(parts: list[tuple[Column, Column]], metric: str = "tanimoto") -> Column:
    """All components' bits as one fingerprint."""
    return dense(metric, F.concat(*[a for a, _ in parts]), F.concat(*[b for _, b in parts]))


def property_ratio(a: Column, b: Column) -> Column:
    """Mean over properties of the smaller value over the larger."""
    r = F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(F.coalesce(F.try_divide(F.least(x, y), F.greatest(x, y)), F.lit(0.0))))
    return F.aggregate(r, F.lit(0.0), lambda acc, v: acc + v) / F.size(r)


def pack_signs(vector: Column, size: int, width: int = 32) -> Column:
    """Bit i is set where element i is positive; ``width`` bits to a bigint word."""
    words = []
    for at in range(0, size, width):
        piece = F.slice(vector, at + 1, min(width, size - at))
        bit = F.transform(piece, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(bit, F.lit(0).cast("long"), lambda acc, v: acc.bitwiseOR(v)))
    return F.array(*words)
