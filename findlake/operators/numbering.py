"""Exact row numbering within groups without sending a group to one task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` moves a whole group into one
task; a folder with a third of all items would do exactly that. Instead:

1. range-partition by ``(g, o)`` and sort within partitions (a hot group is
   split across several range partitions);
2. number rows inside each partition (``monotonically_increasing_id`` keeps
   the partition index in its upper bits and the row position in the lower);
3. count rows per (group, partition) - an aggregation with at most one row per
   group and spanned partition - and turn the counts into offsets with a
   window per group over those few rows;
4. row number = offset + position - first position of the group in the partition + 1.

The order must be total (end with a unique column). The numbered rows are
stored (``session.staged``: shared storage, in columns) before they are used
twice, so a lost executor cannot make the two uses disagree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findlake.session import staged

_POS_BITS = 33


def sequential_number(df: DataFrame, group_cols: list[str], order_cols: list[str],
                      out_col: str = "row_no", num_partitions: int | None = None) -> DataFrame:
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, *order_cols]
    numbered = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_id", F.monotonically_increasing_id())
              .withColumn("_part", F.shiftright("_id", _POS_BITS))
              .withColumn("_pos", F.col("_id") - F.shiftleft("_part", _POS_BITS)))
    # Both uses below must see the same range partitions. Re-running the range
    # exchange can sample different bounds (shuffle read order varies), so the
    # numbered rows are cut from their lineage into the shared folder.
    numbered = staged(numbered, "numbered")
    spans = numbered.groupBy(*group_cols, "_part").agg(F.count(F.lit(1)).alias("_cnt"),
                                                      F.min("_pos").alias("_first"))
    before = (Window.partitionBy(*group_cols).orderBy("_part")
              .rowsBetween(Window.unboundedPreceding, -1)) if group_cols else \
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(*group_cols, "_part", "_first",
                           F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_offset"))
    return (numbered.join(offsets, [*group_cols, "_part"], "inner")
            .withColumn(out_col, (F.col("_offset") + F.col("_pos") - F.col("_first") + 1).cast("bigint"))
            .drop("_id", "_part", "_pos", "_first", "_offset"))
