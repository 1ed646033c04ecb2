"""Name indexes as tables: exact, word postings and prefix postings.

The reference keeps these as in-memory maps and a prefix tree. Here they are
ordinary DataFrames that can be written once (``sources.tables``) and joined
by later searches: postings, one row per key and item, so that no key's items
have to fit into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.functions import text as X
from findlake.operators.prefixes import prefix_counts


def exact_index(catalog: DataFrame) -> DataFrame:
    """``name_lc, ordinal, path``: the items of each lower-cased name, one row per item.

    The catalog stores ``name_lc``, so these postings are a projection of it
    and Parquet filters on the name are pushed down.
    """
    return catalog.select("name_lc", "ordinal", "path")


def word_postings(catalog: DataFrame) -> DataFrame:
    """``word, ordinal, path``: one row per indexed word of each item (words longer than 2)."""
    cat = catalog if "tokens" in catalog.columns else catalog.withColumn("tokens", X.tokenise_name("name_lc"))
    return cat.select(F.explode(F.array_distinct("tokens")).alias("word"), "ordinal", "path")


def word_index(catalog: DataFrame) -> DataFrame:
    """``word, ordinal, path``: the items of each indexed word, one row per word and item (stored by
    ``sources.tables.write_word_postings``)."""
    return word_postings(catalog)


def word_counts(catalog: DataFrame) -> DataFrame:
    """``word, doc_freq``: document frequency per indexed word (partial aggregation)."""
    return word_postings(catalog).groupBy("word").agg(F.count(F.lit(1)).alias("doc_freq"))


def prefix_postings(catalog: DataFrame) -> DataFrame:
    """``prefix, ordinal, path``: every prefix of each lower-cased name, to its whole length.

    Rows grow with the summed name length, which file systems bound per name.
    """
    return (catalog.where(F.length("name_lc") > 0)
            .select("ordinal", "path", "name_lc", F.explode(F.sequence(F.lit(1), F.length("name_lc"))).alias("len"))
            .select(F.expr("substring(name_lc, 1, len)").alias("prefix"), "ordinal", "path"))


def prefix_index(catalog: DataFrame) -> DataFrame:
    """``prefix, n_items, first_ordinal`` for every prefix (from sorted distinct names, ``operators.prefixes``)."""
    return prefix_counts(catalog)


def gram_index(catalog: DataFrame, n: int = 3) -> DataFrame:
    """``gram, df``: number of names containing each ``n``-gram (distinct per name).

    Built once and stored next to the catalog, it lets the large-batch
    substring search pick each query's rarest trigram without re-counting the
    catalog for every batch.
    """
    grams = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("name_lc") - n + 1, F.lit(1))),
        lambda i: F.substring(F.col("name_lc"), i, n)))
    return (catalog.where(F.length("name_lc") >= n)
            .select(F.explode(grams).alias("gram"))
            .groupBy("gram").agg(F.count(F.lit(1)).alias("df")))
