"""Skew-safe top-n per group.

A plain ``row_number() OVER (PARTITION BY g ORDER BY o) <= n`` sends every
row of a group to one task. A query such as ``pdf`` can match a third of a
catalog, so the group is reduced as a two-level tree instead:

1. every map task tags its rows with ``salt = pmod(map partition index, S)``
   and Spark plans a *partial* ``WindowGroupLimit`` before the shuffle, so a
   map task sends at most ``n`` rows per group; partitioning by ``(g, salt)``
   spreads a hot group over ``S`` tasks, each merging about ``P / S`` map
   outputs (``P`` map partitions) instead of all ``P``;
2. partition by ``g`` and keep ``n``: at most ``S * n`` rows per group reach
   the last task, independent of the data size.

The salt only decides *where* rows are merged, never *which* rows win, so the
result is exact whatever the partition index is (also on task retries). The
order must be total (end it with a unique column) so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default_salt_buckets(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def top_n_per_group(df: DataFrame, group_cols: list[str], order: list[Column], n: int,
                    salt_buckets: int | None = None, rank_col: str = "rank") -> DataFrame:
    """Rows ranked ``1..n`` within each group by ``order`` (row_number semantics)."""
    buckets = default_salt_buckets(df) if salt_buckets is None else salt_buckets
    staged = df
    if buckets > 1:
        salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(buckets)))
        w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
        staged = (salted.withColumn("_rn", F.row_number().over(w1))
                  .where(F.col("_rn") <= n).drop("_rn", "_salt"))
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return staged.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= n)
