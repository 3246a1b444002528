"""Sharding by bytes: global prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pestle.llm.common import shuffle_partitions, text_of, written

OVERHEAD = 8


def shard_by_bytes(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` contiguous shards of nearly equal bytes.

    Rows are ordered by (id, size, checksum, read order). They are range-partitioned once, with only
    id, size and checksum; each partition's total gives the prefix sum that its rows start from, and a
    row goes to the shard in whose stretch of ``total / shards`` bytes its middle byte falls. No task
    sees more than one range partition, and only one row per partition and per shard is broadcast.

    Returns ``id_col, size, text_crc32, shard, slot, start`` (``start``: bytes before the row).

    Null text has 0 bytes and the checksum of the empty text; a null id sorts first; repeated rows each
    get a slot; an empty table gives no rows; any further columns of ``df`` are ignored.
    """
    text = text_of(text_col)
    light = df.select(
        F.col(id_col).alias("__id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("__size"),
        F.crc32(text.cast("binary")).alias("__crc"),
        F.monotonically_increasing_id().alias("__tie"),
    )
    order = ["__id", "__size", "__crc", "__tie"]
    n = shuffle_partitions(df.sparkSession)
    # Written down because the sampled range bounds may differ when the shuffle is computed again.
    placed = written(light.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "placed")

    totals = placed.groupBy("__part").agg(F.sum("__size").alias("__bytes"), F.count("*").alias("__rows"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row per range partition
    everything = W.orderBy("__part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    bases = totals.select(
        "__part",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__base"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__row0"),
        F.sum("__bytes").over(everything).alias("__total"),
    )
    local = W.partitionBy("__part").orderBy(*order)
    rows = placed.join(F.broadcast(bases), "__part").select(
        *order,
        (F.col("__base") + F.sum("__size").over(local.rowsBetween(W.unboundedPreceding, 0)) - F.col("__size")).alias("__start"),
        (F.col("__row0") + F.row_number().over(local) - 1).alias("__row"),
        "__total",
    )
    rows = rows.withColumn("__shard", F.expr(f"CAST(least({shards - 1}, ((2 * __start + __size) * {shards}) div (2 * __total)) AS INT)"))
    firsts = rows.groupBy("__shard").agg(F.min("__row").alias("__first"))
    return rows.join(F.broadcast(firsts), "__shard").select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.col("__shard").alias("shard"),
        (F.col("__row") - F.col("__first")).cast("long").alias("slot"),
        F.col("__start").alias("start"),
    )
