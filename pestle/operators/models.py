"""Statistics of models and of fingerprint bits against activity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bits_of(df: DataFrame, id_col: str = "id", fp_col: str = "fp", width: int = 32) -> DataFrame:
    """``id, bit`` of every bit set in dense fingerprints."""
    words = df.select(F.col(id_col).alias("id"), F.posexplode(fp_col).alias("w", "word")).filter("word <> 0")
    bit = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("b")
    return words.select("id", "w", "word", bit).filter(F.expr("(shiftrightunsigned(word, b) & 1) = 1")).select("id", (F.col("w") * width + F.col("b")).cast("long").alias("bit"))


def bit_profile(bits: DataFrame, activity: DataFrame, value: str, id_col: str = "id") -> DataFrame:
    """Per bit the number of items with it, the mean activity with and without it, and the difference."""
    act = activity.select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("a")).filter("a IS NOT NULL")
    total = act.agg(F.count("*").alias("n_all"), F.sum("a").alias("sum_all"))
    per = bits.join(act, "id").groupBy("bit").agg(F.count("*").alias("n"), F.sum("a").alias("s"))
    out = per.crossJoin(F.broadcast(total))  # one row
    unset = F.try_divide(F.col("sum_all") - F.col("s"), F.col("n_all") - F.col("n"))
    return out.select("bit", "n", (F.col("s") / F.col("n")).alias("mean_set"), unset.alias("mean_unset"), (F.col("s") / F.col("n") - unset).alias("difference"))


def naive_bayes(bits: DataFrame, classes: DataFrame, label: str, id_col: str = "id", laplace: float = 1.0) -> DataFrame:
    """``bit, label, weight``: log of the Laplace-corrected rate of a bit in a class over its overall rate."""
    known = classes.select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    sizes = known.groupBy("label").agg(F.count("*").alias("n_class"))
    everyone = known.agg(F.count("*").alias("n_all"))
    joined = bits.join(known, "id")
    overall = joined.groupBy("bit").agg(F.count("*").alias("n_bit"))
    per = joined.groupBy("bit", "label").agg(F.count("*").alias("n"))
    grid = overall.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(everyone))  # one row for each class
    rate = F.col("n_bit") / F.col("n_all")
    corrected = (F.coalesce("n", F.lit(0)) + laplace * rate) / (F.col("n_class") + laplace)
    return grid.join(per, ["bit", "label"], "left").select("bit", "label", F.log(corrected / rate).alias("weight"))


def score_naive_bayes(bits: DataFrame, weights: DataFrame) -> DataFrame:
    """``id, label, score``: the sum of the weights of an item's bits for each class."""
    return bits.join(weights, "bit").groupBy("id", "label").agg(F.sum("weight").alias("score"))


def information_content(bits: DataFrame, classes: DataFrame, label: str, id_col: str = "id") -> DataFrame:
    """``bit, n, gain``: the information (in bits) that each fingerprint bit gives about the class."""
    known = classes.select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    sizes = known.groupBy("label").agg(F.count("*").alias("n_class"))
    total = known.agg(F.count("*").alias("n_all"))
    per = bits.join(known, "id").groupBy("bit", "label").agg(F.count("*").alias("k"))
    n = per.groupBy("bit").agg(F.sum("k").alias("n"))
    grid = n.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(total)).join(per, ["bit", "label"], "left").withColumn("k", F.coalesce("k", F.lit(0)))

    def part(count: Column, of: Column) -> Column:
        p = F.try_divide(count.cast("double"), of)
        return F.when(count > 0, -p * F.log2(p)).otherwise(0.0)

    h = lambda a, b: F.sum(part(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b))
    off, n_off = F.col("n_class") - F.col("k"), F.col("n_all") - F.col("n")
    ent = grid.groupBy("bit", "n", "n_all").agg(h("n_class", "n_all").alias("h"), h("k", "n").alias("on"), h(off, n_off).alias("off"))
    gain = F.col("h") - F.col("n") / F.col("n_all") * F.col("on") - (F.col("n_all") - F.col("n")) / F.col("n_all") * F.col("off")
    return ent.select("bit", "n", gain.alias("gain"))


def enrichment(df: DataFrame, score: str, active: str, tie: str, fractions: tuple[float, ...] = (0.01, 0.05, 0.1), alpha: float = 20.0) -> DataFrame:
    """``n, actives, roc, bedroc`` and enrichment factors of a ranking, best score first.

    ROC needs only counts of distinct scores (ties count half); ranks for the rest come from prefix sums over
    the same counts, ties being ordered by ``tie`` inside a score.
    """
    d = df.select(F.col(score).alias("s"), F.col(active).cast("int").alias("a"), F.col(tie).alias("t"))
    level = d.groupBy("s").agg(F.count("*").alias("c"), F.sum("a").alias("p"))
    before = W.orderBy(F.col("s").desc()).rowsBetween(W.unboundedPreceding, -1)
    level = level.withColumn("above", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("above_p", F.coalesce(F.sum("p").over(before), F.lit(0)))
    inside = W.partitionBy("s").orderBy("t")
    ranked = d.join(level, "s").withColumn("rank", F.col("above") + F.row_number().over(inside)).filter("a = 1")
    total = d.agg(F.count("*").alias("n"), F.sum("a").alias("actives"))
    roc = level.agg(F.sum((F.col("c") - F.col("p")) * (F.col("above_p") + F.col("p") / 2)).alias("pairs"))
    joined = ranked.crossJoin(F.broadcast(total))
    sums = joined.agg(F.sum(F.exp(-alpha * F.col("rank") / F.col("n"))).alias("x"), *[F.count_if(F.col("rank") <= F.ceil(F.col("n") * f)).alias(f"top_{i}") for i, f in enumerate(fractions)])
    one = total.crossJoin(roc).crossJoin(sums)
    ra = F.col("actives") / F.col("n")
    rie = F.col("x") / (ra * (1 - math.exp(-alpha)) / (F.exp(alpha / F.col("n")) - 1))
    bedroc = rie * ra * math.sinh(alpha / 2) / (math.cosh(alpha / 2) - F.cosh(alpha / 2 - alpha * ra)) + 1 / (1 - F.exp(alpha * (1 - ra)))
    factors = [F.try_divide(F.col(f"top_{i}") / F.ceil(F.col("n") * f), ra).alias(f"ef_{f:g}".replace(".", "_")) for i, f in enumerate(fractions)]
    return one.select("n", "actives", (F.col("pairs") / (F.col("actives") * (F.col("n") - F.col("actives")))).alias("roc"), bedroc.alias("bedroc"), *factors)


def rank_association(needles: DataFrame, haystack: DataFrame, id_col: str = "id", item: str = "gene", rank: str = "rank", most: int | None = None) -> DataFrame:
    """``needle, neighbour, score``: sum over shared items of the product of signed ranks, over its maximum."""
    cut = lambda t: t if most is None else t.filter(F.abs(F.col(rank)) <= most)
    a = cut(needles).select(F.col(id_col).alias("needle"), F.col(item).alias("i"), F.col(rank).cast("double").alias("x"))
    b = cut(haystack).select(F.col(id_col).alias("neighbour"), F.col(item).alias("i"), F.col(rank).cast("double").alias("y"))
    top = a.groupBy("needle").agg(F.sum(F.col("x") * F.col("x")).alias("top"))
    both = a.join(b, "i").filter("needle <> neighbour").groupBy("needle", "neighbour").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    return both.join(top, "needle").select("needle", "neighbour", (F.col("s") / F.col("top")).alias("score"))


def evidence(neighbours: DataFrame, activity: DataFrame, value: str, id_col: str = "id") -> DataFrame:
    """Per needle its neighbours' count, mean, distance-weighted mean and nearest value."""
    v = neighbours.join(activity.select(F.col(id_col).alias("neighbour"), F.col(value).cast("double").alias("v")), "neighbour")
    w = 1 - F.col("distance")
    return v.groupBy("needle").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.try_divide(F.sum(F.col("v") * w), F.sum(F.when(F.col("v").isNotNull(), w))).alias("weighted"), F.min_by("v", F.struct("distance", "neighbour")).alias("closest"))


def fold_sparse(df: DataFrame, nbits: int, support: int = 1, id_col: str = "id", bits_col: str = "bits") -> DataFrame:
    """Sparse counted fingerprints to dense ones: bits with enough support, modulo ``nbits``, as 32-bit words."""
    long = df.select(F.col(id_col).alias("id"), F.explode(bits_col).alias("bit", "count"))
    kept = long.groupBy("bit").agg(F.count("*").alias("n")).filter(F.col("n") >= support).select("bit")
    small = long.join(kept, "bit").select("id", F.pmod("bit", F.lit(nbits)).alias("b"))
    word = small.groupBy("id", F.floor(F.col("b") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b % 32 AS INT))")).alias("v"))
    packed = word.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))  # at most nbits / 32 entries
    words = F.transform(F.sequence(F.lit(0), F.lit(nbits // 32 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return df.select(F.col(id_col).alias("id")).distinct().join(packed, "id", "left").select("id", F.coalesce(words, F.array_repeat(F.lit(0).cast("long"), nbits // 32)).alias("fp"))


def flatten_counts(bits: Column) -> Column:
    return F.transform_values(bits, lambda k, v: F.lit(1))


def sparse_svm_lite(df: DataFrame, activity: DataFrame, value: str, support: int = 1, id_col: str = "id", bits_col: str = "bits") -> DataFrame:
    """``id, line``: the activity and ``feature:count`` in order; features are bits with support, numbered by bit."""
    long = df.select(F.col(id_col).alias("id"), F.explode(bits_col).alias("bit", "count"))
    kept = long.groupBy("bit").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    number = kept.select("bit", F.row_number().over(W.orderBy("bit")).alias("f"))  # one row for each distinct bit
    cells = long.join(number, "bit").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "count"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["f"].cast("string"), x["count"].cast("string"))), " ")
    return activity.select(F.col(id_col).alias("id"), F.col(value).alias("v")).join(cells, "id").select("id", F.concat_ws(" ", F.col("v").cast("string"), text).alias("line"))
