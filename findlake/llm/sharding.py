"""Contiguous shards of near-equal bytes from global prefix sums.

Every partition of the document order contributes one total; the running sum
of these totals gives each partition its global offset, and a running sum
inside the partition gives each row its own. The byte range is cut at equal
targets, so a shard is a contiguous run of the order and misses its target by
less than one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findlake.llm.common import stored


def assign_shards(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1); ``shard`` is that
    of the document's middle byte; ``slot`` counts rows of a shard from 0 in
    key order. Null keys come first; rows of one key are ordered by checksum
    and size, so equal rows are interchangeable. An empty table gives no rows.
    """
    narrow = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
        F.monotonically_increasing_id().alias("row"))
    order = ["key", "crc", "size", "row"]
    parts = stored(narrow.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "shards")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row per partition, so these windows stay small whatever the table holds.
    offsets = totals.select(
        F.col("pid").alias("opid"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (parts.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(inside))
              .join(F.broadcast(offsets), F.col("pid") == F.col("opid"))
              .withColumn("start", F.col("byte0") + F.col("upto") - F.col("size"))
              .withColumn("shard", F.expr(f"cast(((2 * start + size) * {n_shards}) div (2 * total) as int)"))
              .withColumn("at", F.col("row0") + F.col("nth") - 1))
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first")).withColumnRenamed("shard", "of")
    return (placed.join(F.broadcast(firsts), F.col("shard") == F.col("of"))
            .select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("at") - F.col("first")).alias("slot")))
