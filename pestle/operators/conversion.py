"""Fingerprints from descriptor columns and back, collections, and kernel scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pestle.functions.metrics import pack_signs
from pestle.operators.similarity import block_product, tanimoto_distances

#: Columns that a fingerprint may be spread into; more need a higher support.
MOST_COLUMNS = 5000


def columns_to_bits(columns: Sequence[str], width: int = 32) -> Column:
    """A dense fingerprint: bit i is set where column i is positive; missing is 0."""
    return pack_signs(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]), len(columns), width)


def columns_to_counts(columns: Sequence[str], limits: dict[str, tuple[float, float]], n: int = 10, replicates: int = 1) -> Column:
    """A sparse fingerprint: of column i the bits ``i * replicates ...``, each counted as often as the number of the
    value's bucket, of ``n`` between the column's limits (outside: the nearest). Bucket 0 and missing give no bits."""
    parts = []
    for i, c in enumerate(columns):
        low, high = limits[c]
        bucket = F.least(F.greatest(F.floor((F.col(c).cast("double") - low) * n / (high - low)), F.lit(0)), F.lit(n - 1)).cast("long")
        bits = F.array(*[F.struct(F.lit(i * replicates + r).cast("long").alias("key"), bucket.alias("value")) for r in range(replicates)])
        parts.append(F.filter(bits, lambda b: b["value"] > 0))
    return F.map_from_entries(F.concat(*parts))


def supported_bits(df: DataFrame, bits: str, support: int, most: int | None = None) -> list[int]:
    """Bits of at least ``support`` rows, the most frequent first; ``most`` is a limit that the caller asks for."""
    n = df.select(F.explode(F.map_keys(bits)).alias("bit")).groupBy("bit").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    found = n.orderBy(F.desc("n"), "bit").limit((most or MOST_COLUMNS) + 1).collect()
    if most is None and len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} bits have that support")
    return [r["bit"] for r in found[:most]]


def bits_to_columns(df: DataFrame, fingerprints: dict[str, str], support: int = 1, most: int | None = None, presence: bool = False, id_col: str = "id") -> DataFrame:
    """One column for each supported bit of each sparse fingerprint (``prefix -> column``), named prefix and bit.

    The columns are found by one aggregation; then each row looks its own up, without a pivot.
    """
    out = []
    for prefix, column in fingerprints.items():
        for b in supported_bits(df, column, support, most):
            value = F.coalesce(F.try_element_at(F.col(column), F.lit(b).cast("long")).cast("long"), F.lit(0).cast("long"))
            out.append((F.when(value > 0, 1).otherwise(0).cast("long") if presence else value).alias(f"{prefix}{b}"))
    return df.select(id_col, *out)


def add_descriptors(df: DataFrame, descriptors: DataFrame, columns: Sequence[str], id_col: str = "id", name: str = "descriptors") -> DataFrame:
    """Fingerprints with their descriptors as an array; ids without descriptors are left out."""
    d = descriptors.select(F.col(id_col).alias("__id"), F.array(*[F.col(c).cast("double") for c in columns]).alias(name))
    return df.join(d, df[id_col] == d["__id"]).drop("__id")


def parse_svm_lite(line: Column) -> Column:
    """``target, bits map<bigint, double>, name`` of a line ``target bit:value ... # name``."""
    body = F.split(F.trim(F.substring_index(line, "#", 1)), r"\s+")
    pairs = F.transform(F.filter(F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0))), lambda p: p.rlike(r"^\d+:\S+$")), lambda p: F.struct(F.substring_index(p, ":", 1).cast("long").alias("key"), F.substring_index(p, ":", -1).try_cast("double").alias("value")))
    name = F.when(F.contains(line, F.lit("#")), F.trim(F.substring_index(line, "#", -1)))
    return F.struct(body[0].try_cast("double").alias("target"), F.map_from_entries(pairs).alias("bits"), name.alias("name"))


def collection_fingerprint(df: DataFrame, least_share: float = 0.0, bits_col: str = "bits") -> DataFrame:
    """``bit, n, total, share``: rows of the whole collection that have a bit, summed counts, and share of rows."""
    rows = df.agg(F.count("*").alias("rows"))
    n = df.select(F.explode(bits_col).alias("bit", "count")).groupBy("bit").agg(F.count("*").alias("n"), F.sum("count").alias("total"))
    return n.crossJoin(F.broadcast(rows)).select("bit", "n", "total", (F.col("n") / F.col("rows")).alias("share")).filter(F.col("share") >= least_share)  # one row is broadcast


def similarity_to_members(df: DataFrame, members: DataFrame, id_col: str = "id", fp_col: str = "fp") -> DataFrame:
    """``id, member, similarity`` of every row to every member: the fingerprint of a row against a collection."""

    def run(a, fa, b, fb):
        d = 1 - tanimoto_distances(fa, fb)
        return pa.table({"id": np.repeat(a, len(b)), "member": np.tile(b, len(a)), "similarity": d.ravel()})

    return block_product(df, members, run, "id long, member long, similarity double", id_col, fp_col)


def kernel_score(df: DataFrame, support: DataFrame, weight: str, threshold: float = 0.0, id_col: str = "id", fp_col: str = "fp") -> DataFrame:
    """``id, score``: the weighted sum of a row's similarities to all support vectors, less the threshold.

    Blocks of rows meet blocks of support vectors; each gives one partial sum a row.
    """

    def run(a, fa, b, fb, w):
        return pa.table({"id": a, "part": (1 - tanimoto_distances(fa, fb)) @ w})

    parts = block_product(df, support, run, "id long, part double", id_col, fp_col, weight)
    return parts.groupBy("id").agg((F.sum("part") - threshold).alias("score"))
