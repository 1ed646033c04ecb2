"""Counts and catalog statistics (all partial + final aggregations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.operators.catalog import scope_to_roots
from findlake.operators.index import word_postings


def items_per_root(catalog: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, items``: items below each root; nested roots count an item twice; empty roots show 0."""
    per_root = scope_to_roots(catalog, roots).groupBy("root").agg(F.count(F.lit(1)).alias("items"))
    return (roots.select("root").join(per_root, "root", "left")
            .select("root", F.coalesce("items", F.lit(0)).cast("bigint").alias("items")))


def total_items(catalog: DataFrame) -> DataFrame:
    """``total_items``: distinct lower-cased paths."""
    return catalog.agg(F.count_distinct("path_key").cast("bigint").alias("total_items"))


def catalog_statistics(catalog: DataFrame) -> DataFrame:
    """One row: ``items, files, folders, distinct_names, distinct_words``.

    Names and words are stacked into one column and counted in a single
    aggregation (Spark expands the two distinct counts), so no one-row
    results have to be joined together.
    """
    names = catalog.select(F.lit("name").alias("kind"), F.col("name_lc").alias("value"), "is_dir")
    words = word_postings(catalog).select(F.lit("word").alias("kind"), F.col("word").alias("value"),
                                          F.lit(None).cast("boolean").alias("is_dir"))
    stacked = names.unionByName(words)
    is_name = F.col("kind") == "name"
    return stacked.agg(
        F.count_if(is_name).cast("bigint").alias("items"),
        F.count_if(is_name & ~F.col("is_dir")).cast("bigint").alias("files"),
        F.count_if(is_name & F.col("is_dir")).cast("bigint").alias("folders"),
        F.count_distinct(F.when(is_name, F.col("value"))).cast("bigint").alias("distinct_names"),
        F.count_distinct(F.when(~is_name, F.col("value"))).cast("bigint").alias("distinct_words"))
