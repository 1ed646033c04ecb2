"""The multi-strategy search (flagship) as one lazy plan.

Plan shape
----------
1. ``hits``: every (item, query) pair with a substring or word hit. Small
   batches: one catalog pass with the batch broadcast (``hits_scan``); large
   batches: equi-joins only (``hits_indexed``). Both give the same pairs.
2. Each hit is routed to up to three *streams*:
   ``m`` exact or word hit (ordered by score desc, ordinal),
   ``p`` prefix hit (ordered by ordinal: the reference keeps the first 2k),
   ``c`` substring hit (ordered by score desc, ordinal).
3. A skew-safe top-``2k`` per (query, stream): a partial ``WindowGroupLimit``
   runs before the shuffle, and a salted first level spreads a hot query over
   many tasks. After it each query has at most ``6k`` rows.
4. On that bounded remainder: ``n`` = distinct items of streams m and p.
   If stream m was cut it holds ``2k >= k`` items, so ``n < k`` is decided
   exactly; when ``n < k`` the c rows join in. The best ``k`` by score win.

Top-k is decomposable over unions - top(A u B) = top(top(A) u top(B)) - which
is why cutting each stream before the shuffle loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findlake.functions import paths as P
from findlake.operators import search as S
from findlake.operators.topn import top_n_per_group

RESULT_COLUMNS = ["query_id", "rank", "path", "name", "item_type", "parent", "score"]


def candidate_hits(catalog: DataFrame, queries: DataFrame, plan: str = "auto",
                   scan_max_queries: int = S.SCAN_PLAN_MAX_QUERIES,
                   gram_freq: DataFrame | None = None) -> DataFrame:
    """Prepared queries joined with the catalog by the chosen physical form.

    ``auto`` counts the batch (a size check on a small input) and picks the
    broadcast scan up to ``scan_max_queries`` queries, equi-joins beyond.
    """
    qn = S.prepare_queries(queries)
    if plan == "auto":
        plan = "scan" if qn.count() <= scan_max_queries else "indexed"
    if plan == "scan":
        return S.hits_scan(catalog, qn)
    if plan == "indexed":
        return S.hits_indexed(catalog, qn, gram_freq)
    raise ValueError(f"unknown plan {plan!r}")


def search_streams(hits: DataFrame, k: int) -> DataFrame:
    """Top ``2k`` of each stream per query (the only step that sees all hits)."""
    stream = F.explode(F.filter(
        F.array(F.when(F.col("is_exact") | F.col("is_word"), F.lit("m")),
                F.when(F.col("is_prefix"), F.lit("p")),
                F.when(F.col("is_contains"), F.lit("c"))),
        lambda s: s.isNotNull()))
    routed = hits.select("query_id", "ordinal", "path", "name", "parent", "is_dir", "score",
                         stream.alias("stream"))
    order_key = F.when(F.col("stream") == "p", F.lit(0)).otherwise(-F.col("score"))
    return top_n_per_group(routed, ["query_id", "stream"], [order_key, F.col("ordinal"), F.col("path")], 2 * k,
                           rank_col="stream_rank")


def finish(streams: DataFrame, k: int) -> DataFrame:
    """Fallback decision and final top-k on the bounded per-query remainder."""
    per_query = Window.partitionBy("query_id")
    members = F.size(F.collect_set(F.when(F.col("stream") != "c", F.col("path"))).over(per_query))
    kept = (streams.withColumn("n_members", members)
            .where((F.col("stream") != "c") | (F.col("n_members") < k))
            .select("query_id", "ordinal", "path", "name", "parent", "is_dir", "score")
            .dropDuplicates(["query_id", "path"]))
    ranked = kept.withColumn("rank", F.row_number().over(
        per_query.orderBy(F.desc("score"), F.asc("ordinal"), F.asc("path"))))
    return (ranked.where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("bigint").alias("rank"), "path", "name",
                    P.item_type("is_dir").alias("item_type"), "parent", "score", "ordinal"))


def multi_strategy_search(catalog: DataFrame, queries: DataFrame, k: int = S.DEFAULT_RESULTS,
                          plan: str = "auto", gram_freq: DataFrame | None = None) -> DataFrame:
    """Best ``k`` items per query: ``query_id, rank, path, name, item_type, parent, score, ordinal``.

    ``gram_freq`` is an optional stored ``index.gram_index`` used by the
    large-batch (equi-join) form.
    """
    hits = candidate_hits(catalog, queries, plan, gram_freq=gram_freq)
    return finish(search_streams(hits, k), k)


def autocomplete(catalog: DataFrame, queries: DataFrame, n: int = S.DEFAULT_RESULTS) -> DataFrame:
    """Prefix lookup on its own: first ``n`` items by arrival whose name starts with the query."""
    qn = S.prepare_queries(queries)
    return (S.prefix_match(catalog, qn, n)
            .select("query_id", F.col("prefix_rank").cast("bigint").alias("rank"), "ordinal", "path"))


def display_page(results: DataFrame, limit: int = S.DISPLAY_LIMIT) -> DataFrame:
    """Rows shown for each query: ``#, name, type label, location`` for the first ``limit``."""
    return (results.where(F.col("rank") <= limit)
            .select("query_id", F.col("rank").alias("row_no"), "name",
                    F.when(F.col("item_type") == "folder", P.FOLDER_LABEL).otherwise(P.FILE_LABEL)
                    .alias("item_label"),
                    F.col("parent").alias("location")))


def result_counts(results: DataFrame, queries: DataFrame, limit: int = S.DISPLAY_LIMIT) -> DataFrame:
    """Hits per query and hits beyond the displayed page; no-hit queries show 0."""
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return (queries.select(F.col("query_id").cast("bigint").alias("query_id"))
            .join(counts, "query_id", "left")
            .select("query_id", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
                    F.greatest(F.lit(0), F.coalesce("hits", F.lit(0)) - limit).cast("bigint")
                    .alias("more_hits")))


def pick_by_number(results: DataFrame, picks: DataFrame, limit: int = S.DISPLAY_LIMIT) -> DataFrame:
    """Item number ``n`` of a query's results; ``n`` must be within ``min(hits, limit)``.

    With exactly one hit that hit is picked whatever ``n`` is. Out-of-range
    picks drop out.
    """
    # Results hold at most k rows per query, so a per-query window is bounded
    # and the result set is read once.
    counted = results.withColumn("_hits", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    p = picks.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("n").cast("bigint").alias("n"))
    want = F.when(F.col("_hits") == 1, F.lit(1)).otherwise(F.col("n"))
    return (counted.join(p, "query_id", "inner")
            .where((F.col("rank") == want) & (want >= 1) & (want <= F.least(F.col("_hits"), F.lit(limit))))
            .select("query_id", "n", "rank", "path", "name", "item_type"))
