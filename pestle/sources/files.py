"""Readers and writers of record files. Record delimiters go to Spark's text source, so that large files are
split between tasks, and fields are taken apart by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_smiles(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """``smiles, id, rest`` of lines ``smiles id rest``; blank lines are left out."""
    t = spark.read.text(path).filter("trim(value) <> ''")
    parts = F.split(F.trim("value"), r"\s+", 3)
    out = t.select(parts[0].alias("smiles"), F.try_element_at(parts, F.lit(2)).alias("id"), F.try_element_at(parts, F.lit(3)).alias("rest"))
    return out.offset(skip) if skip else out


def write_smiles(df: DataFrame, path: str, smiles: str = "smiles", id_col: str = "id") -> None:
    df.select(F.concat_ws(" ", smiles, F.col(id_col).cast("string")).alias("value")).write.text(path)


def read_descriptors(spark: SparkSession, path: str, schema: str | None = None, separator: str = " ", missing: str = ".") -> DataFrame:
    """A table with a header; ``missing`` is null. Without a schema the first column is text, others doubles."""
    reader = spark.read.option("header", True).option("sep", separator).option("nullValue", missing)
    if schema:
        return reader.schema(schema).csv(path)
    raw = reader.csv(path)
    return raw.select(raw.columns[0], *[F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns[1:]])


def write_descriptors(df: DataFrame, path: str, separator: str = " ", missing: str = ".") -> None:
    df.write.option("header", True).option("sep", separator).option("nullValue", missing).csv(path)


def read_tdt(spark: SparkSession, path: str) -> DataFrame:
    """``tags array<struct<tag, value>>`` of records ``TAG<value>`` that end with a line ``|``."""
    t = spark.read.option("lineSep", "|\n").text(path)
    lines = F.filter(F.split("value", "\n"), lambda x: x.rlike("^[^<]+<.*>$"))
    item = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^([^<]+)<", 1).alias("tag"), F.regexp_extract(x, "^[^<]+<(.*)>$", 1).alias("value")))
    return t.select(item.alias("tags")).filter(F.size("tags") > 0)


def tag(name: str, at: int = 1) -> Column:
    """The ``at``-th value of a tag, or null."""
    return F.try_element_at(F.filter("tags", lambda t: t["tag"] == name), F.lit(at))["value"]


def with_tag(name: str, value: Column) -> Column:
    """The tags with one more at the end."""
    return F.concat("tags", F.array(F.struct(F.lit(name).alias("tag"), value.cast("string").alias("value"))))


def write_tdt(df: DataFrame, path: str) -> None:
    text = F.array_join(F.transform("tags", lambda t: F.concat(t["tag"], F.lit("<"), t["value"], F.lit(">\n"))), "")
    df.select(text.alias("value")).write.option("lineSep", "|\n").text(path)


def invalid_tdt(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not ``TAG<value>``, with the record's first line."""
    t = spark.read.option("lineSep", "|\n").text(path)
    lines = F.split(F.trim("value"), "\n")
    return t.select(lines[0].alias("record"), F.explode(lines).alias("line")).filter(~F.col("line").rlike("^[^<]+<.*>$") & (F.col("line") != ""))


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """``title, ctab, tags map<string,string>`` of records that end with ``$$$$``."""
    t = spark.read.option("lineSep", "$$$$\n").text(path).withColumn("value", F.regexp_replace("value", "\r\n", "\n")).filter("trim(value) <> ''")
    names = F.regexp_extract_all("value", F.lit(r"(?m)^> *[^<\n]*<([^>]+)>.*$"), F.lit(1))
    values = F.regexp_extract_all("value", F.lit(r"(?m)^> *[^<\n]*<[^>]+>.*\n((?:(?!> ).+\n?)*)"), F.lit(1))
    pairs = F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda p: F.struct(p["n"].alias("key"), F.rtrim(F.regexp_replace(p["v"], r"\n+$", "")).alias("value")))
    first = F.aggregate(pairs, F.expr("cast(array() as array<struct<key:string,value:string>>)"), lambda acc, p: F.when(F.exists(acc, lambda q: q["key"] == p["key"]), acc).otherwise(F.concat(acc, F.array(p))))
    return t.select(F.trim(F.substring_index("value", "\n", 1)).alias("title"), F.regexp_extract("value", r"(?s)^(.*?M  END)", 1).alias("ctab"), F.map_from_entries(first).alias("tags"))


def split_files(df: DataFrame, path: str, records: int, format: str = "parquet") -> None:
    """Output files of at most ``records`` rows."""
    df.write.option("maxRecordsPerFile", records).format(format).save(path)
