"""Exact deduplication by a stateful stream over content digests, bytes checked on every hit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pestle.llm.common import shared_dir, steady, text_of, written

#: Fixed value: the characters that do not count, ``[\x20\x09-\x0D]``.
IGNORED = " \t\n\x0b\x0c\r"
#: Settings of the stream: state on disk, and no space set aside in advance by each partition's store.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Groups of at least 1/HOT_SHARE of all rows (so at most HOT_SHARE of them) are salted in joins.
HOT_SHARE = 1000
SALTS = 64


def normalised(col):
    return F.translate(text_of(col), IGNORED, "")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """digest, stable identifier, length and content locator of every row; no text."""
    return docs.select(
        F.sha2(normalised(text_col).cast("binary"), 256).alias("digest"),
        F.col(id_col).alias("id"),
        F.length(text_of(text_col)).cast("long").alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
        F.input_file_name().alias("file"),
    )


def stateful_groups(stream: DataFrame) -> DataFrame:
    """The streaming aggregate: per digest the row that stays, its locator and the group's size.

    ``stream`` has the columns of :func:`digest_rows`. State is kept per digest, without expiry.
    Of equal texts the longest original stays, then the smallest identifier, then the first row read.
    """
    return stream.groupBy("digest").agg(
        F.min(F.struct((-F.col("n_chars")).alias("neg"), "id", "row", "file")).alias("keeper"),
        F.count("*").alias("size"),
    )


def run_stream(spark: SparkSession, rows_path: str, schema, state_dir: str, max_bytes_per_batch: int = 4 << 30) -> DataFrame:
    """Stream the digest rows below ``rows_path`` through RocksDB state and return the state.

    ``state_dir`` keeps offsets and state: a later call with it continues where the last one ended.
    Returns ``digest, keep_id, keep_row, file, size``.
    """
    old = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes_per_batch).parquet(rows_path)
        q = stateful_groups(stream).writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(state_dir)
    keeper, size = state.schema["value"].dataType.names[:2]
    value = F.col("value")
    return state.select(
        F.col("key.digest").alias("digest"),
        value[keeper]["id"].alias("keep_id"),
        value[keeper]["row"].alias("keep_row"),
        value[keeper]["file"].alias("file"),
        value[size].alias("size"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their UTF-8 bytes without ``IGNORED`` characters are; null counts as empty.
    Every row that the state calls a copy is compared byte by byte with the row that stays; should two
    different texts ever share a digest, the query fails rather than dropping one. Rows that repeat an
    identifier are rows of their own, of which one stays. An empty table gives no rows; further columns
    are ignored. Very long texts are rows like others. ``docs`` is read three times; if it is more than
    read, selected and filtered, it is written down first, so that locators mean the same rows each time.

    Digests are streamed from a written table, so no text enters the state. Texts are moved once, and
    only those whose digest prefix (of 2**20) belongs to a group of two or more. Digests that hold at
    least 1/HOT_SHARE of all rows, at most HOT_SHARE of them, are broadcast and salted.
    """
    spark = docs.sparkSession
    base = shared_dir(spark)
    docs = steady(docs.select(id_col, text_col))
    rows = digest_rows(docs, id_col, text_col)
    rows.write.parquet(f"{base}/digests")
    rows = spark.read.schema(rows.schema).parquet(f"{base}/digests")
    if rows.isEmpty():
        groups = spark.createDataFrame([], f"digest string, keep_id {rows.schema['id'].dataType.simpleString()}, keep_row long, file string, size long")
    else:
        groups = written(run_stream(spark, f"{base}/digests", rows.schema, f"{base}/state"), "groups")
    multi = groups.filter("size > 1")
    single = groups.filter("size = 1").select(F.col("keep_id").alias("id"), "keep_id", F.col("size"), F.lit(True).alias("kept"), "digest")

    least = F.broadcast(groups.agg((F.sum("size") / HOT_SHARE).alias("least")))
    hot = groups.join(least, F.col("size") >= F.greatest(F.col("least"), F.lit(2))).select("digest", F.lit(True).alias("hot"))
    prefix = F.conv(F.substring("digest", 1, 5), 16, 10).cast("int")
    prefixes = multi.select(prefix.alias("prefix")).distinct()  # at most 2**20 rows

    texts = docs.select(
        F.sha2(normalised(text_col).cast("binary"), 256).alias("digest"),
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        normalised(text_col).alias("norm"),
    )
    texts = texts.join(F.broadcast(prefixes), prefix == F.col("prefix"), "left_semi")
    salted = texts.join(F.broadcast(hot), "digest", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id", "row"), F.lit(SALTS)).cast("int")).otherwise(0)
    )
    spread = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    heads = multi.join(F.broadcast(hot), "digest", "left").select("digest", "keep_id", "keep_row", "size", spread)
    members = salted.join(heads.hint("merge"), ["digest", "salt"])
    firsts = texts.join(multi.select("digest", "keep_row").hint("merge"), "digest").filter("row = keep_row")
    firsts = firsts.join(F.broadcast(hot), "digest", "left").select("digest", F.col("norm").alias("keep_norm"), spread)
    same = F.when(F.col("norm") == F.col("keep_norm"), True).otherwise(F.raise_error(F.lit("texts that share a SHA-256 digest differ, or the table changed while it was read")).cast("boolean"))
    checked = members.join(firsts.hint("merge"), ["digest", "salt"], "left").filter(same)
    several = checked.select("id", "keep_id", "size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")
    return single.unionByName(several).select(
        F.col("id").alias(id_col), "keep_id", F.col("size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256")
    )
