"""Catalog and index tables on shared storage (Parquet), and the file-content sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.operators.index import word_postings


# Folder name for paths without a drive (an empty partition value would be read back as NULL).
_NO_DRIVE = "none"


def write_catalog(catalog: DataFrame, path: str, mode: str = "overwrite",
                  num_files: int | None = None) -> None:
    """Write the catalog partitioned by drive, sorted by ``name_lc`` inside each file.

    Rows are hash-partitioned on the unique ``path_key``: equally sized
    files even when one drive holds a third of all items, and no sampling
    pass (range partitioning would run the whole upstream build twice). Inside
    each file rows are sorted by ``name_lc``, so row-group min/max statistics
    let pushed-down ``In`` / ``StringStartsWith`` filters skip most row
    groups; ``drive`` folders prune whole drives. A folder's items lie in as
    many files as there are items, at most: where the names of folders are too
    many for a dictionary, Bloom filters on ``parent_key`` let a listing skip
    the other row groups (``operators.listing.list_directory``).
    """
    named = catalog.withColumn("drive", F.when(F.col("drive") == "", F.lit(_NO_DRIVE)).otherwise(F.col("drive")))
    # Without a number of files, adaptive execution sizes them from the measured shuffle: small parts are joined and
    # large ones split, so what a task sorts does not grow with the catalog.
    dealt = named.repartition(num_files, "path_key") if num_files else named.hint("rebalance", "path_key")
    writer = dealt.sortWithinPartitions("drive", "name_lc", "ordinal").write.mode(mode).partitionBy("drive")
    if "parent_key" in catalog.columns:
        writer = (writer.option("parquet.bloom.filter.enabled#parent_key", "true")
                  .option("parquet.bloom.filter.adaptive.enabled", "true"))
    writer.parquet(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored.withColumn("drive", F.when(F.col("drive") == _NO_DRIVE, F.lit("")).otherwise(F.col("drive")))


def write_word_postings(catalog: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Word postings clustered by word (range partitioned: a hot word spans several files)."""
    (word_postings(catalog).repartitionByRange("word", "ordinal").sortWithinPartitions("word", "ordinal")
     .write.mode(mode).parquet(path))


def write_created_files(file_plan: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sink of a file-creation plan: one ``(path, content)`` row per file; the batch's last write of a path stays."""
    done = file_plan.where(F.col("status").isin("created", "overwritten")).withColumn("_key", F.lower("path"))
    # Rows of a nested request share its change_id; their place in it (``pos``) decides.
    order = F.struct("change_id", "pos") if "pos" in file_plan.columns else F.struct("change_id")
    (done.groupBy("_key").agg(F.min_by("path", order).alias("path"), F.max_by("content", order).alias("content"))
     .select("path", "content").write.mode(mode).parquet(path))
