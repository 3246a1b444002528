"""Descriptor-table operators: each is a function from DataFrame to DataFrame."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pestle.functions.filter_dsl import expression
from pestle.operators.similarity import saved


def filter_rows(df: DataFrame, text: str, missing_passes: bool = False, others_zero: Sequence[str] = ()) -> DataFrame:
    """Rows that pass the filter language; with ``others_zero`` those columns must be zero too."""
    keep = expression(text, missing_passes)
    for c in others_zero:
        keep = keep & F.coalesce(F.col(c) == 0, F.lit(False))
    return df.filter(keep)


def join_tables(tables: Sequence[DataFrame], key: str, how: str = "left", duplicates: str = "error", fill=None) -> DataFrame:
    """N-way join on an identifier: ``left`` from the first table, ``inner`` or ``full``.

    ``duplicates``: of later tables' repeated keys, ``first`` keeps the row that sorts first and
    ``error`` fails the query. ``fill`` replaces missing values.
    """

    def single(t: DataFrame) -> DataFrame:
        rest = [c for c in t.columns if c != key]
        if duplicates == "first":
            return t.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
        return t.groupBy(key).agg(
            *[F.when(F.count("*") > 1, F.raise_error(F.lit("join_tables: repeated key"))).otherwise(F.first(c)).alias(c) for c in rest]
        )

    first, *others = tables
    out = reduce(lambda a, b: a.join(single(b), key, how), others, first)
    return out if fill is None else out.fillna(fill)


def select_columns(df: DataFrame, names: Sequence[str] = (), pattern: str | None = None, invert: bool = False, pad: str | None = None) -> DataFrame:
    """Columns by name, in the order given, or by pattern; ``pad`` stands in for absent ones."""
    wanted = [*names, *[c for c in df.columns if pattern and re.search(pattern, c) and c not in names]]
    if invert:
        return df.select([c for c in df.columns if c not in wanted])
    if pad is None and (absent := [c for c in wanted if c not in df.columns]):
        raise ValueError(f"no such columns: {absent}")
    return df.select([F.col(c) if c in df.columns else F.lit(pad).alias(c) for c in wanted])


def grep_rows(df: DataFrame, columns: Sequence[str], patterns: Sequence[str], least: int = 1, regex: bool = True) -> DataFrame:
    """Rows of which at least ``least`` patterns match in any of the columns."""
    one = lambda p: reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string").rlike(p) if regex else F.col(c).cast("string").contains(p), F.lit(False)) for c in columns])
    return df.filter(sum((one(p).cast("int") for p in patterns), F.lit(0)) >= least)


def unique_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], keep: int = 1, ignore_case: bool = False, strip_zeros: bool = False) -> DataFrame:
    """The first ``keep`` rows of each key in the given order."""
    value = lambda c: reduce(lambda x, f: f(x), [*([F.lower] if ignore_case else []), *([lambda x: F.regexp_replace(x, "^0+", "")] if strip_zeros else [])], F.col(c))
    w = W.partitionBy(*[value(k) for k in keys]).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= keep).drop("__n")


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, n_missing, n`` in one pass."""
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot(["__n"], list(columns), "column", "n_missing").select("column", "n_missing", F.col("__n").alias("n"))


def rows_with_missing(df: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    return df.filter(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) <= most)


def concatenate(tables: Sequence[DataFrame], labels: Sequence[str] | None = None, label_column: str = "source", allow_missing: bool = False) -> DataFrame:
    """Union by name; headers must agree unless ``allow_missing``."""
    if not allow_missing and any(set(t.columns) != set(tables[0].columns) for t in tables):
        raise ValueError("headers differ")
    labelled = [t.withColumn(label_column, F.lit(x)) for t, x in zip(tables, labels)] if labels else tables
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), labelled)


def select_rows(df: DataFrame, ids: DataFrame, key: str, invert: bool = False) -> DataFrame:
    """Rows whose key is (not) among the identifiers."""
    return df.join(ids.select(key), key, "left_anti" if invert else "left_semi")


def sort_rows(df: DataFrame, keys: Sequence[tuple[str, bool, bool]], tie: Sequence[str], missing_last: bool = True) -> DataFrame:
    """Order by (column, descending, absolute value); missing values last."""
    order = []
    for name, down, absolute in keys:
        c = F.abs(F.col(name)) if absolute else F.col(name)
        order.append(c.desc_nulls_last() if down else (c.asc_nulls_last() if missing_last else c.asc_nulls_first()))
    return df.orderBy(*order, *tie)


def difference(df: DataFrame, a: str, b: str, absolute: bool = False, name: str = "difference") -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.withColumn(name, F.abs(d) if absolute else d)


def column_statistics(df: DataFrame, columns: Sequence[str], percentiles: Sequence[float] = (), by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``column, n, n_missing, min, max, mean, variance, sd`` and percentiles, the former in one aggregation."""
    stats = []
    for c in columns:
        x = F.col(c).cast("double")
        mean = F.avg(x) if weight is None else F.sum(x * F.col(weight)) / F.sum(F.when(x.isNotNull(), F.col(weight)))
        parts = {"n": F.count(x), "n_missing": F.count_if(x.isNull()), "min": F.min(x), "max": F.max(x), "mean": mean, "variance": F.var_samp(x), "sd": F.stddev_samp(x)}
        stats.append(F.struct(F.lit(c).alias("column"), *[v.alias(k) for k, v in parts.items()]).alias(c))
    one = df.groupBy(*by).agg(*stats)
    rows = one.select(*by, F.inline(F.array(*[F.col(c) for c in columns])))
    if not percentiles:
        return rows
    names = [f"p{p * 100:g}".replace(".", "_") for p in percentiles]
    return beside(rows, exact_percentiles(df, columns, percentiles, by), [*by, "column"], "left").withColumnsRenamed({f"p{i}": f"__p{i}" for i in range(len(percentiles))}).withColumnsRenamed({f"__p{i}": n for i, n in enumerate(names)})


def limits(df: DataFrame, columns: Sequence[str], together: bool = False) -> DataFrame:
    """One row with ``lo_c, hi_c, mean_c, sd_c`` of each column; with ``together`` one range for all."""
    aggs = [f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("sd", F.stddev_samp))]
    out = df.agg(*aggs)
    if together:
        lo = F.least(*[F.col(f"lo_{c}") for c in columns]) if len(columns) > 1 else F.col(f"lo_{columns[0]}")
        hi = F.greatest(*[F.col(f"hi_{c}") for c in columns]) if len(columns) > 1 else F.col(f"hi_{columns[0]}")
        out = out.select(lo.alias("lo"), hi.alias("hi"), "*").select(*[x for c in columns for x in (F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}"), f"mean_{c}", f"sd_{c}")])
    return out


def with_limits(df: DataFrame, columns: Sequence[str], together: bool = False) -> DataFrame:
    return df.crossJoin(F.broadcast(limits(df, columns, together)))  # one row


def bucketise(df: DataFrame, columns: Sequence[str], n: int, together: bool = False) -> DataFrame:
    """Bucket numbers ``int(0.5 + (x - min) / dx)`` with ``dx = (max - min) / n``; constant columns stay null."""
    b = lambda c: F.floor(0.5 + F.try_divide(F.col(c) - F.col(f"lo_{c}"), (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / n)).cast("long")
    return with_limits(df, columns, together).select(*[b(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def distribution(df: DataFrame, column: str, width: float, normalise: str | None = None) -> DataFrame:
    """``bucket, n`` of rounded values; ``normalise``: ``area`` or ``peak`` adds ``share``."""
    out = df.filter(F.col(column).isNotNull()).groupBy(F.floor(0.5 + F.col(column) / width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    if normalise:
        top = out.agg((F.sum if normalise == "area" else F.max)("n").alias("__top"))
        out = out.crossJoin(F.broadcast(top)).select("bucket", "n", (F.col("n") / F.col("__top")).alias("share"))
    return out


def overlapping_distribution(df: DataFrame, column: str, step: float, width: float) -> DataFrame:
    """``bucket, n``: bucket i holds the values in ``[i * step, i * step + width)``, so a value is in several.

    Values are counted by their first and last bucket before they are counted in each of them.
    """
    x = F.col(column).cast("double")
    ends = df.filter(x.isNotNull()).groupBy((F.floor((x - width) / step) + 1).cast("long").alias("first"), F.floor(x / step).cast("long").alias("last")).agg(F.count("*").alias("n"))
    every = ends.filter("first <= last").select(F.explode(F.sequence("first", "last")).alias("bucket"), "n")
    return every.groupBy("bucket").agg(F.sum("n").alias("n"))


SCALES = ("01", "11", "uv", "mc", "0255")


def scaled(column: str, kind: str) -> Column:
    x, lo, hi, mean, sd = (F.col(n) for n in (column, f"lo_{column}", f"hi_{column}", f"mean_{column}", f"sd_{column}"))
    unit = F.try_divide(x - lo, hi - lo)
    return {"01": unit, "11": unit * 2 - 1, "uv": F.try_divide(x - mean, sd), "mc": x - mean, "0255": F.floor(unit * 255 + 0.5).cast("long")}[kind]


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The one-row parameters that ``apply_scaling`` and ``undo_scaling`` take; write it to keep it."""
    return limits(df, columns)


def apply_scaling(df: DataFrame, parameters: DataFrame, columns: Sequence[str], kind: str = "01") -> DataFrame:
    joined = df.crossJoin(F.broadcast(parameters))
    return joined.select(*[scaled(c, kind).alias(c) if c in columns else F.col(c) for c in df.columns])


def undo_scaling(df: DataFrame, parameters: DataFrame, columns: Sequence[str], kind: str = "01", truncate: bool = False) -> DataFrame:
    joined = df.crossJoin(F.broadcast(parameters))

    def back(c: str) -> Column:
        x, lo, hi, mean, sd = (F.col(n) for n in (c, f"lo_{c}", f"hi_{c}", f"mean_{c}", f"sd_{c}"))
        y = {"01": x * (hi - lo) + lo, "11": (x + 1) / 2 * (hi - lo) + lo, "uv": x * sd + mean, "mc": x + mean, "0255": x / 255 * (hi - lo) + lo}[kind]
        return F.greatest(lo, F.least(hi, y)) if truncate else y

    return joined.select(*[back(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def drop_outliers(df: DataFrame, columns: Sequence[str], sigmas: float, rejects: bool = False) -> DataFrame:
    """Rows of which no selected value is beyond ``sigmas`` standard deviations of its mean."""
    joined = with_limits(df, columns)
    out = reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col(c) - F.col(f"mean_{c}")) > sigmas * F.col(f"sd_{c}"), F.lit(False)) for c in columns])
    return joined.filter(out if rejects else ~out).select(*df.columns)


def informative_columns(df: DataFrame, columns: Sequence[str], least_distinct: int = 2, most_common_share: float = 1.0, least_variance: float = 0.0) -> list[str]:
    """Columns with enough distinct values, without too common a value, and with enough variance."""
    long = df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], list(columns), "column", "value").filter("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    shape = counts.groupBy("column").agg(F.count("*").alias("distinct"), (F.max("n") / F.sum("n")).alias("share"))
    spread = long.groupBy("column").agg(F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"))
    rows = shape.join(spread, "column").collect()  # one row for each column
    good = {r["column"] for r in rows if r["distinct"] >= least_distinct and r["share"] <= most_common_share and r["variance"] >= least_variance}
    return [c for c in columns if c in good]


def same_sign_columns(df: DataFrame, columns: Sequence[str], positive_only: bool = False) -> list[str]:
    row = df.agg(*[f(F.signum(F.col(c).cast("double"))).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))]).first()
    return [c for c in columns if row[f"lo_{c}"] is not None and row[f"lo_{c}"] == row[f"hi_{c}"] and (row[f"lo_{c}"] > 0 or not positive_only)]


def running_average(df: DataFrame, order: str, value: str, size: int) -> DataFrame:
    """Means of consecutive chunks of ``size`` records, with the mean of all chunks so far.

    Records are numbered by range partition and prefix counts, so that no task sees the whole table;
    only the chunks, ``size`` times fewer, meet in one ordered window.
    """
    numbered = row_numbers(df.select(order, value), [order])
    chunks = numbered.groupBy(F.floor(F.col("__row") / size).alias("chunk")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("__sum")
    )
    # The running sums go over the chunks by ranges too: totals of ranges first, then inside each range.
    per = F.floor(F.col("chunk") / 4096).alias("range")
    ranges = chunks.groupBy(per).agg(F.sum("__sum").alias("__s"), F.sum("n").alias("__n"))
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row per 4096 chunks
    base = ranges.select("range", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__bs"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__bn"))
    w = W.partitionBy("range").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)
    own = chunks.withColumn("range", F.floor(F.col("chunk") / 4096)).join(base, "range")
    return own.select("chunk", "n", "mean", "min", "max", ((F.col("__bs") + F.sum("__sum").over(w)) / (F.col("__bn") + F.sum("n").over(w))).alias("cumulative"))


def row_numbers(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``__row``, counted from 0 in the given order. The range partitions are written down before they are counted,
    so that a lost executor changes neither bounds nor the order of ties."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    part = saved(part.withColumn("__part", F.shiftright("__id", 33)))
    counts = part.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    base = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return part.join(F.broadcast(base), "__part").withColumn("__row", F.col("__base") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__id", "__base")


def hash_split(df: DataFrame, key: str, percent: int, seed: int = 0, name: str = "split") -> DataFrame:
    """``train`` for about ``percent`` of the keys, by a hash that any executor repeats."""
    h = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(100))
    return df.withColumn(name, F.when(h < percent, "train").otherwise("test"))


def stratified_split(df: DataFrame, strata: str, key: str, percent: int, seed: int = 0) -> DataFrame:
    """In each stratum the rows whose hashes come first, ``percent`` of it, are ``train``."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    rank = F.row_number().over(W.partitionBy(strata).orderBy(h, key))
    size = F.count("*").over(W.partitionBy(strata))
    return df.withColumn("split", F.when(rank * 100 <= size * percent, "train").otherwise("test"))


def sample_rows(df: DataFrame, n: int | None = None, fraction: float | None = None, replace: bool = False, seed: int = 0) -> DataFrame:
    if n is not None:
        return df.orderBy(F.rand(seed)).limit(n)
    return df.sample(replace, fraction, seed)


def translate_labels(df: DataFrame, column: str, labels: dict[str, float]) -> DataFrame:
    pairs = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(column, F.try_element_at(pairs, F.col(column)))


def classify_scores(df: DataFrame, score: str, cutoff: float, band: float = 0.0, names: tuple[str, str, str] = ("pos", "neg", "ambiguous")) -> DataFrame:
    s = F.col(score)
    return df.withColumn("class", F.when(s >= cutoff + band, names[0]).when(s <= cutoff - band, names[1]).otherwise(names[2]))


def compare_tables(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], absolute: float = 0.0, ratio: float = 0.0) -> DataFrame:
    """Cells that differ by more than both tolerances, or stand on one side only."""
    long = lambda t, v: t.select(key, *[F.col(c).cast("double") for c in columns]).unpivot([key], list(columns), "column", v)
    both = long(a, "left").join(long(b, "right"), [key, "column"], "full")
    gap = F.abs(F.col("left") - F.col("right"))
    relative = F.try_divide(gap, F.greatest(F.abs("left"), F.abs("right")))
    return both.filter(F.col("left").isNull() != F.col("right").isNull()).unionByName(both.filter((gap > absolute) & (F.coalesce(relative, F.lit(0.0)) > ratio)))


def model_average(tables: Sequence[DataFrame], key: str, column: str, weights: Sequence[float] | None = None) -> DataFrame:
    """``key, n, mean, median`` of the predictions of several tables."""
    weights = weights or [1.0] * len(tables)
    every = reduce(lambda a, b: a.unionByName(b), [t.select(key, F.col(column).cast("double").alias("x"), F.lit(float(w)).alias("w")) for t, w in zip(tables, weights)])
    return every.groupBy(key).agg(F.count("x").alias("n"), (F.sum(F.col("x") * F.col("w")) / F.sum(F.when(F.col("x").isNotNull(), F.col("w")))).alias("mean"), F.percentile("x", F.lit(0.5)).alias("median"))


def mispredicted(observed: DataFrame, predictions: Sequence[DataFrame], key: str, obs: str, pred: str, least: float) -> DataFrame:
    """Items whose mean absolute error over all prediction tables is at least ``least``."""
    every = reduce(lambda a, b: a.unionByName(b), [p.select(key, pred) for p in predictions])
    e = every.join(observed.select(key, obs), key).groupBy(key).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(pred) - F.col(obs))).alias("error"))
    return e.filter(F.col("error") >= least)


def confusion(df: DataFrame, obs: str, pred: str, cutoffs: Sequence[float], obs_cutoff: float) -> DataFrame:
    """Counts and rates at each prediction cutoff, in one pass."""
    yes = F.col(obs) >= obs_cutoff
    rows = [
        F.struct(F.lit(float(c)).alias("cutoff"), *[F.count_if(a & b).alias(k) for k, a, b in (("tp", yes, F.col(pred) >= c), ("fp", ~yes, F.col(pred) >= c), ("fn", yes, F.col(pred) < c), ("tn", ~yes, F.col(pred) < c))])
        for c in cutoffs
    ]
    out = df.agg(*[r.alias(f"r{i}") for i, r in enumerate(rows)]).select(F.inline(F.array(*[F.col(f"r{i}") for i in range(len(rows))])))
    rate = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return out.select("*", rate("tp", "fp").alias("ppv"), rate("tn", "fn").alias("npv"), rate("tp", "fn").alias("sensitivity"), rate("tn", "fp").alias("specificity"))


def rank_table(df: DataFrame, column: str, name: str) -> DataFrame:
    """Each distinct value with the average rank of its ties; only the distinct values are ordered, by ranges."""
    counts = df.groupBy(column).agg(F.count("*").alias("__c"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(counts.repartitionByRange(n, column).withColumn("__part", F.spark_partition_id()))
    totals = placed.groupBy("__part").agg(F.sum("__c").alias("__t"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    base = totals.select("__part", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    w = W.partitionBy("__part").orderBy(column).rowsBetween(W.unboundedPreceding, -1)
    return placed.join(F.broadcast(base), "__part").select(column, (F.col("__base") + F.coalesce(F.sum("__c").over(w), F.lit(0)) + (F.col("__c") + 1) / 2).alias(name))


def mid_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with the average rank of their value's ties."""
    return df.join(rank_table(df, column, name), column)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.select(a, b).dropna()
    ranked = both.join(rank_table(both, a, "__ra"), a).join(rank_table(both, b, "__rb"), b)
    return ranked.agg(F.count("*").alias("n"), F.corr("__ra", "__rb").alias("rho"))


def correlated_pairs(df: DataFrame, columns: Sequence[str], least: float) -> DataFrame:
    """Column pairs with an absolute correlation of at least ``least``, in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))]))).filter(F.abs("r") >= least)


def regression_statistics(df: DataFrame, obs: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, bias, mean absolute and root mean square error, R2 and Q2 of predictions."""
    o, p = F.col(obs).cast("double"), F.col(pred).cast("double")
    e = p - o
    d = df.filter(o.isNotNull() & p.isNotNull())
    out = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rms"), F.corr(o, p).alias("__r"), F.avg(e * e).alias("__mse"), F.var_pop(o).alias("__var"))
    return out.select(*by, "n", "bias", "mae", "rms", (F.col("__r") ** 2).alias("r2"), (1 - F.try_divide(F.col("__mse"), F.col("__var"))).alias("q2"))


def token_counts(df: DataFrame, column: str, separator: str = r"\s+") -> DataFrame:
    """``tokens, n``: how many records have how many tokens."""
    trimmed = F.trim(F.coalesce(F.col(column), F.lit("")))
    size = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, separator)))
    return df.groupBy(size.cast("long").alias("tokens")).agg(F.count("*").alias("n"))


def unbalanced(df: DataFrame, column: str, quote: str = '"') -> DataFrame:
    """Records with an odd number of quotes."""
    c = F.col(column)
    return df.filter((F.length(c) - F.length(F.replace(c, F.lit(quote), F.lit("")))) / len(quote) % 2 == 1)


def svm_lite(df: DataFrame, target: str, columns: Sequence[str], key: str) -> DataFrame:
    """``key, line``: the target and the non-zero values as ``number:value``, numbers from 1."""
    cells = F.array(*[F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0, F.concat(F.lit(f"{i}:"), F.col(c).cast("string"))) for i, c in enumerate(columns, 1)])
    return df.select(key, F.concat_ws(" ", F.col(target).cast("string"), F.array_compact(cells)).alias("line"))


def beside(df: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Each row with the columns of its group, of which ``groups`` has one row; without ``by`` with its only row."""
    if not by:
        return df.crossJoin(F.broadcast(groups))
    other = groups.withColumnsRenamed({c: f"__by_{c}" for c in by})
    return df.join(other, reduce(lambda x, y: x & y, [df[c].eqNullSafe(other[f"__by_{c}"]) for c in by]), how).drop(*[f"__by_{c}" for c in by])


def exact_percentiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = (), width: float = 4e-4) -> DataFrame:
    """``by, column, p0, p1, ...``: exact, as ``percentile`` gives them, without all of a group's values in one task.

    Sketches bracket each percentile within the share ``width`` of the rows; values below are counted, and distinct
    values in the bracket are counted and put in order. Should one lie outside, brackets grow, at last to all values.
    A group without values of a column has no row.
    """
    df = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    which = [(c, i, p) for c in columns for i, p in enumerate(shares)]
    while True:
        whole = width >= 1
        ends = {c: F.array(*[f(c) for _ in shares for f in (F.min, F.max)]) if whole else F.percentile_approx(c, F.array(*[F.lit(x) for p in shares for x in (max(p - width / 2, 0.0), min(p + width / 2, 1.0))]), 10_000) for c in columns}
        sketch = saved(df.groupBy(*by).agg(*[x.alias(f"__ends_{c}") for c, x in ends.items()], *[F.count(c).alias(f"__n_{c}") for c in columns]))
        end = lambda c, k: F.col(f"__ends_{c}")[k]
        both = beside(df, sketch, by)
        value = lambda c, i: F.when(F.col(c) >= end(c, 2 * i), F.col(c))  # noqa: E731  none: below the bracket
        each = [both.filter(F.col(c) <= end(c, 2 * i + 1)).select(*by, F.lit(c).alias("__column"), F.lit(i).alias("__share"), value(c, i).alias("__value"), ((F.col(f"__n_{c}") - 1) * p).alias("__rank")) for c, i, p in which]
        some = reduce(lambda x, y: x.unionByName(y), each)
        counts = some.groupBy(*by, "__column", "__share", "__rank", "__value").agg(F.count("*").alias("__k"))
        upto = counts.withColumn("__upto", F.sum("__k").over(W.partitionBy(*by, "__column", "__share").orderBy(F.asc_nulls_first("__value"))))
        first = [F.min(F.when(F.col("__upto") > f("__rank"), F.struct("__upto", "__value")))["__value"] for f in (F.floor, F.ceil)]
        found = saved(upto.groupBy(*by, "__column", "__share", "__rank").agg(*[x.alias(k) for x, k in zip(first, ("__low", "__high"))]))
        if whole or found.filter("__low IS NULL OR __high IS NULL").isEmpty():
            break
        width *= 50
    over = F.col("__rank") - F.floor("__rank")
    at = F.when(over == 0, F.col("__low")).otherwise((1 - over) * F.col("__low") + over * F.col("__high"))
    return found.groupBy(*by, F.col("__column").alias("column")).agg(*[F.max(F.when(F.col("__share") == i, at)).alias(f"p{i}") for i in range(len(shares))])


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and each column's exact median, null where a group has no value."""
    long = exact_percentiles(df, columns, [0.5], by)
    wide = long.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, F.col("p0"))).alias(c) for c in columns])
    return beside(df.select(*by).distinct(), wide, by, "left").select(*by, *columns) if by else wide


def deviation(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median and median absolute deviation, times 1.4826, of each column (by group)."""
    middle = saved(medians(df, columns, by).withColumnsRenamed({c: f"{c}_median" for c in columns}))
    gaps = beside(df, middle, by).select(*by, *[F.abs(F.col(c) - F.col(f"{c}_median")).alias(c) for c in columns])
    mad = medians(gaps, columns, by).select(*by, *[(F.col(c) * 1.4826).alias(f"{c}_mad") for c in columns])
    return beside(middle, mad, by)


def extremes(df: DataFrame, value: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest value, the smallest key that has each, and how many rows do (by group)."""
    ends = df.groupBy(*by).agg(F.min(F.struct(value, key)).alias("low"), F.min(F.struct((-F.col(value)).alias("neg"), F.col(value).alias("v"), F.col(key).alias("k"))).alias("high"))
    ends = ends.select(*by, F.col("low")[value].alias("min"), F.col("low")[key].alias("min_key"), F.col("high.v").alias("max"), F.col("high.k").alias("max_key"))
    joined = df.join(ends, list(by)) if by else df.crossJoin(F.broadcast(ends))
    names = [*by, "min", "min_key", "max", "max_key"]
    return joined.groupBy(*names).agg(F.count_if(F.col(value) == F.col("min")).alias("n_min"), F.count_if(F.col(value) == F.col("max")).alias("n_max"))


def changes(df: DataFrame, order: Sequence[str], column: str) -> DataFrame:
    """Rows whose ``column`` differs from the row before, in the given order, with that row's value as
    ``previous``; the first row has none and is returned. Rows are compared by their numbers, not in one window."""
    numbered = row_numbers(df, order)
    before = numbered.select((F.col("__row") + 1).alias("__row"), F.col(column).alias("previous"), F.lit(True).alias("__has"))
    both = numbered.join(before, "__row", "left").filter(F.col("__has").isNull() | ~F.col(column).eqNullSafe(F.col("previous")))
    return both.drop("__row", "__has")


def shuffled_columns(df: DataFrame, seed: int, first: Sequence[str] = ()) -> DataFrame:
    """The columns in a random order that the seed fixes, those in ``first`` before all others."""
    import random

    rest = [c for c in df.columns if c not in first]
    random.Random(seed).shuffle(rest)
    return df.select(*first, *rest)


def common_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], invert: bool = False) -> DataFrame:
    """Rows of ``a`` whose keys are (or, inverted, are not) in ``b``; null keys are equal to each other."""
    k = b.select(*(F.col(c).alias(f"__{c}") for c in keys)).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return a.join(k, on, "left_anti" if invert else "left_semi")


def in_stock(inventories: Sequence[DataFrame], key: str, amount: str, least: float, restricted: DataFrame | None = None) -> DataFrame:
    """Keys whose amounts, summed over all inventories, reach ``least``, without those in ``restricted``."""
    out = None
    for i in inventories:
        one = i.select(F.col(key), F.col(amount).alias("amount"))
        out = one if out is None else out.unionByName(one)
    out = out.groupBy(key).agg(F.sum("amount").alias("amount")).filter(F.col("amount") >= least)
    return out if restricted is None else out.join(restricted.select(key), key, "left_anti")


def collate_complements(tables: Sequence[DataFrame], fragment: str, complement: str, count: str) -> DataFrame:
    """``fragment, total, complements array<struct<complement, n>>`` over all tables, complements in order."""
    out = None
    for t in tables:
        one = t.select(F.col(fragment).alias("fragment"), F.col(complement).alias("complement"), F.col(count).cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    pairs = out.groupBy("fragment", "complement").agg(F.sum("n").alias("n"))
    return pairs.groupBy("fragment").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("complement", "n"))).alias("complements"))


def grid_overlap(a: DataFrame, b: DataFrame, axes: Sequence[str], value: str, spacing: float, tolerance: float) -> DataFrame:
    """Grid points of ``a`` with the value at the same point of ``b``, and whether they differ by at most
    ``tolerance``; points are equal when they round to the same multiple of ``spacing``."""
    cell = lambda df: df.select(*(F.round(F.col(c) / spacing).cast("long").alias(f"__{c}") for c in axes), *df.columns)
    right = cell(b).select(*(f"__{c}" for c in axes), F.col(value).alias("other"))
    both = cell(a).join(right, [f"__{c}" for c in axes])
    return both.select(*axes, value, "other", (F.abs(F.col(value) - F.col("other")) <= tolerance).alias("overlaps"))


def transpose(df: DataFrame, key: str) -> DataFrame:
    return df.transpose(key)


def collate_counts(tables: Sequence[DataFrame], key: str, count: str, example: str, least: int = 1) -> DataFrame:
    """Count tables added up, with the smallest example and only keys of enough support."""
    every = reduce(lambda a, b: a.unionByName(b), tables)
    return every.groupBy(key).agg(F.sum(count).alias(count), F.min(example).alias(example)).filter(F.col(count) >= least)
