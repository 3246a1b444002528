"""Tagged records: joins, sorting, statistics, selection and projection of ``tags array<struct<tag, value>>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pestle.operators.tables import filter_rows
from pestle.sources.files import tag


def record(**tags: Column) -> Column:
    """Tags in the order given; null values are left out."""
    items = F.array(*[F.struct(F.lit(name).alias("tag"), value.cast("string").alias("value")) for name, value in tags.items()])
    return F.filter(items, lambda t: t["value"].isNotNull())


def without_tags(tags: Column, names: Column) -> Column:
    return F.filter(tags, lambda t: ~F.array_contains(names, t["tag"]))


def join_records(files: Sequence[DataFrame], key: str, how: str = "inner", distinct_tags: bool = True) -> DataFrame:
    """Records of all files with equal ``key`` tags as one: the first file's tags, then what the others add.

    ``how``: ``inner`` (in every file) or ``left`` (all of the first). With ``distinct_tags`` a tag that is there
    already is not added again. A key must be unique in all files but the first.
    """
    out = files[0].select(tag(key).alias("key"), "tags")
    for other in files[1:]:
        right = other.select(tag(key).alias("other"), F.filter("tags", lambda t: t["tag"] != key).alias("more"))
        more = without_tags(F.col("more"), F.transform("tags", lambda t: t["tag"])) if distinct_tags else F.col("more")
        joined = out.join(right, out["key"] == right["other"], how)
        out = joined.select("key", F.when(F.col("more").isNull(), F.col("tags")).otherwise(F.concat("tags", more)).alias("tags"))
    return out.select("tags")


def sort_keys(keys: Sequence[tuple[str, bool, bool]], token: int | None = None, separator: str = " ") -> list[Column]:
    """Sort columns of (tag, numeric, descending); ``token`` picks a token of each value. Missing tags come last."""
    out = []
    for name, numeric, descending in keys:
        value = tag(name) if token is None else F.try_element_at(F.split(tag(name), separator), F.lit(token))
        value = value.try_cast("double") if numeric else value
        out.append(value.desc_nulls_last() if descending else value.asc_nulls_last())
    return out


def sort_records(df: DataFrame, keys: Sequence[tuple[str, bool, bool]], token: int | None = None) -> DataFrame:
    return df.orderBy(*sort_keys(keys, token))


def record_statistics(df: DataFrame) -> DataFrame:
    """Per tag: records that have it, occurrences, and minimum, maximum and mean of the values that are numbers."""
    each = df.select(F.explode(F.transform("tags", lambda t: F.struct(t["tag"].alias("tag"), t["value"].try_cast("double").alias("x")))).alias("t"))
    once = df.select(F.explode(F.array_distinct(F.transform("tags", lambda t: t["tag"]))).alias("tag")).groupBy("tag").agg(F.count("*").alias("records"))
    stats = each.groupBy(F.col("t.tag").alias("tag")).agg(F.count("*").alias("occurrences"), F.min("t.x").alias("min"), F.max("t.x").alias("max"), F.avg("t.x").alias("mean"))
    return once.join(stats, "tag")


def fetch_records(df: DataFrame, ids: DataFrame, key: str, invert: bool = False) -> DataFrame:
    """Records whose ``key`` tag is (or, inverted, is not) in the first column of ``ids``."""
    wanted = ids.select(F.col(ids.columns[0]).cast("string").alias("wanted"))
    return df.join(wanted, tag(key) == wanted["wanted"], "left_anti" if invert else "left_semi")


def to_smiles(df: DataFrame, smiles: str = "$SMI", name: str = "PCN", others: Sequence[str] = ()) -> DataFrame:
    """``smiles, name`` and further tags; records without a structure are left out."""
    return df.select(tag(smiles).alias("smiles"), tag(name).alias("name"), *(tag(t).alias(t) for t in others)).filter("smiles IS NOT NULL")


def filter_records(df: DataFrame, text: str, names: Sequence[str], missing_passes: bool = False) -> DataFrame:
    """Records for which the filter ``text`` over the tags ``names`` holds."""
    wide = df.select(F.struct(*df.columns).alias("record"), *(tag(n).alias(n) for n in names))
    return filter_rows(wide, text, missing_passes).select("record.*")


def to_store(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value`` of the records that have both tags; of a repeated key the smallest value."""
    return df.select(tag(key).alias("key"), tag(value).alias("value")).dropna().groupBy("key").agg(F.min("value").alias("value"))


def from_store(df: DataFrame, store: DataFrame, key: str, name: str, missing: str | None = None) -> DataFrame:
    """Records with the store's value of their ``key`` tag as a further tag ``name``, or ``missing`` if given."""
    s = store.select(F.col("key").alias("stored"), F.coalesce("value", F.lit(missing)).alias("found"))
    joined = df.join(s, tag(key) == s["stored"], "left").withColumn("found", F.coalesce("found", F.lit(missing)))
    added = F.array(F.struct(F.lit(name).alias("tag"), F.col("found").alias("value")))
    return joined.select(*[c for c in df.columns if c != "tags"], F.when(F.col("found").isNull(), F.col("tags")).otherwise(F.concat("tags", added)).alias("tags"))
