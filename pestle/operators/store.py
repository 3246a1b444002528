"""Key-value stores as tables with ``key`` and ``value``: loads, look-ups, merges and comparisons are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = ("keep", "overwrite", "append", "append_different")


def load(store: DataFrame, new: DataFrame, policy: str = "keep", separator: str = ":") -> DataFrame:
    """The store with ``new`` (one row a key) loaded: what becomes of keys that exist is the policy's."""
    if policy not in POLICIES:
        raise ValueError(policy)
    both = store.select("key", F.col("value").alias("old")).join(new.select("key", F.col("value").alias("new")), "key", "full")
    joined = F.concat_ws(separator, "old", "new")
    clash = {
        "keep": F.col("old"),
        "overwrite": F.col("new"),
        "append": joined,
        "append_different": F.when(F.array_contains(F.split("old", separator), F.col("new")), F.col("old")).otherwise(joined),
    }[policy]
    return both.select("key", F.when(F.col("old").isNull(), F.col("new")).when(F.col("new").isNull(), F.col("old")).otherwise(clash).alias("value"))


def fetch(store: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys with their values, and the keys that are missing."""
    return keys.join(store, "key"), keys.join(store.select("key"), "key", "left_anti")


def exists(store: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(store.select("key").distinct().withColumn("__in", F.lit(True)), "key", "left").select(*keys.columns, F.coalesce("__in", F.lit(False)).alias("exists"))


def delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("key"), "key", "left_anti")


def listing(store: DataFrame, pattern: str | None = None) -> DataFrame:
    return store if pattern is None else store.filter(F.col("key").rlike(pattern))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """``key, state``: ``differs``, ``missing`` (only in ``a``) or ``new`` (only in ``b``); equal keys are left out."""
    both = a.select("key", F.struct("value").alias("x")).join(b.select("key", F.struct("value").alias("y")), "key", "full")
    state = F.when(F.col("x").isNull(), "new").when(F.col("y").isNull(), "missing").when(~F.col("x").eqNullSafe(F.col("y")), "differs")
    return both.select("key", state.alias("state")).filter("state IS NOT NULL")


def merge(stores: list[DataFrame], policy: str = "keep", separator: str = ":") -> DataFrame:
    out = stores[0]
    for s in stores[1:]:
        out = load(out, s, policy, separator)
    return out
