"""Search building blocks: query preparation, the four match strategies, scoring.

Semantics (fixed by the reference):

* a query is lower-cased and stripped; a blank query has no hits;
* candidates are exact-name hits, the first ``2k`` prefix hits in arrival
  (``ordinal``) order, and word hits (any query word equals an indexed word);
  only when a query has fewer than ``k`` candidates are all substring hits
  added;
* the score is 100 / 80 / 50 / 0 for equal / starts-with / contains / other,
  plus ``max(0, 30 - length(name))``, plus 10 when the parent's own name
  contains documents, desktop or downloads;
* results are ordered by score descending, ties by ``ordinal`` (the reference
  leaves ties unordered).

Size rules: the query batch is the only side ever broadcast, and only after
its row count has been checked (``checked_broadcast``). Tables derived from it
are bounded by construction (``n_queries * 2k`` rows at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.functions import paths as P
from findlake.functions import text as X
from findlake.operators.catalog import broadcast_within
from findlake.session import staged
from findlake.operators.topn import top_n_per_group

# --- fixed values that must match the reference's behaviour -------------------
EXACT_POINTS = 100
PREFIX_POINTS = 80
CONTAINS_POINTS = 50
SHORT_NAME_BONUS = 30      # max(0, 30 - length(name))
COMMON_FOLDER_POINTS = 10
DEFAULT_RESULTS = 20       # default k of a search and of an autocomplete lookup
DISPLAY_LIMIT = 20         # rows shown per result page
# -----------------------------------------------------------------------------

# Largest query batch that is broadcast; larger batches use shuffle joins.
MAX_BROADCAST_QUERIES = 100_000
# Largest batch whose query strings become literal scan filters.
PUSHDOWN_LITERALS = 64
# Batch size where the search switches from one broadcast scan to equi-joins.
# Measured on the sf0.1 catalog (local[8], 20 / 100 / 400 queries): the scan
# costs ~1.2 s + 4-6 ms per query, the equi-join form a flat ~6-7 s (it
# explodes every name into grams), so they cross near 1,000 queries. Both
# grow linearly with the catalog, so the crossover holds at larger scales.
SCAN_PLAN_MAX_QUERIES = 1_000

# What the candidate sets and the ranking need of a hit.
MEMBER_COLUMNS = ["query_id", "ordinal", "path", "is_exact", "is_prefix", "is_word", "score"]
HIT_COLUMNS = ["ordinal", "path", "name", "name_lc", "parent", "parent_name", "is_dir", "tokens"]


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_QUERIES) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only when its row count is within ``max_rows``.

    Counting costs one pass over a small input (a query batch); it proves the
    size bound instead of trusting statistics.
    """
    n = df.count()
    return (F.broadcast(df), True) if n <= max_rows else (df, False)


def prepare_queries(queries: DataFrame) -> DataFrame:
    """``query_id, raw`` -> ``query_id BIGINT, raw, q, q_words``; blank queries dropped."""
    return (queries
            .where(~X.is_blank("raw"))
            .select(F.col("query_id").cast("bigint").alias("query_id"), "raw",
                    X.normalise_query("raw").alias("q"))
            .withColumn("q_words", X.tokenise_query("q"))
            # The query is its own single word: a word hit is then a substring hit too.
            .withColumn("single_word", (F.size("q_words") == 1) & (F.element_at("q_words", 1) == F.col("q"))))


def searchable(catalog: DataFrame) -> DataFrame:
    """Catalog columns a search reads (column pruning reaches the Parquet scan)."""
    cat = catalog if "tokens" in catalog.columns else catalog.withColumn(
        "tokens", X.tokenise_name("name_lc"))
    return cat.select(*HIT_COLUMNS)


def item_points(name_lc="name_lc", parent_name="parent_name") -> Column:
    """Query-independent part of the score: short-name and common-folder bonuses."""
    name_lc, parent_name = (F.col(c) if isinstance(c, str) else c for c in (name_lc, parent_name))
    short = F.greatest(F.lit(0), F.lit(SHORT_NAME_BONUS) - F.length(name_lc))
    common = F.when(P.in_common_folder(parent_name), COMMON_FOLDER_POINTS).otherwise(0)
    return short + common


def relevance_score(name_lc="name_lc", q="q", parent_name="parent_name") -> Column:
    """Integer score of (item, query); see the module docstring."""
    name_lc, q, parent_name = (F.col(c) if isinstance(c, str) else c
                               for c in (name_lc, q, parent_name))
    return (match_points(name_lc, q) + item_points(name_lc, parent_name)).cast("bigint")


def match_points(name_lc, q) -> Column:
    return (F.when(name_lc == q, EXACT_POINTS)
            .when(name_lc.startswith(q), PREFIX_POINTS)
            .when(name_lc.contains(q), CONTAINS_POINTS)
            .otherwise(0))


def word_hit() -> Column:
    """Any query word equals an indexed word of the name."""
    return F.when(F.col("single_word"), F.array_contains("tokens", F.col("q"))) \
        .otherwise(F.arrays_overlap("tokens", "q_words"))


def with_match_flags(pairs: DataFrame) -> DataFrame:
    """Add ``is_exact, is_prefix, is_word, is_contains, score`` to (item, query) pairs."""
    points = F.col("_item_points") if "_item_points" in pairs.columns else item_points()
    return (pairs
            .withColumn("is_exact", F.col("name_lc") == F.col("q"))
            .withColumn("is_prefix", F.col("name_lc").startswith(F.col("q")))
            .withColumn("is_contains", F.col("name_lc").contains(F.col("q")))
            .withColumn("is_word", word_hit())
            .withColumn("score", (match_points(F.col("name_lc"), F.col("q")) + points).cast("bigint"))
            .drop("_item_points"))


# ---------------------------------------------------------------------------
# Candidate pairs: every (item, query) with a substring or a word hit.
# ---------------------------------------------------------------------------

def hits_scan(cat: DataFrame, qn: DataFrame) -> DataFrame:
    """All (item, query) pairs with a substring or word hit, one pass over the catalog.

    The prepared batch ``qn`` must be small (checked by the caller) and is
    broadcast; the catalog streams through a ``BroadcastNestedLoopJoin`` and is
    read once, with no shuffle. Exact and prefix hits are subsets of substring
    hits, so this one condition finds every candidate of every strategy.
    """
    # Name words are substrings of the name, so for a query that is its own
    # single word the substring test already covers the word test.
    cond = F.col("name_lc").contains(F.col("q")) | (~F.col("single_word") & F.arrays_overlap("tokens", "q_words"))
    items = searchable(cat).withColumn("_item_points", item_points())
    return with_match_flags(items.join(F.broadcast(qn), cond, "inner"))


def _grams(col: Column, n: Column) -> Column:
    """Distinct substrings of length ``n`` of ``col`` (empty when shorter)."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(col) - n + 1, F.lit(1))),
                                        lambda i: F.substring(col, i, n)))


def probe_grams(cat: DataFrame, qn: DataFrame, gram_freq: DataFrame | None = None) -> DataFrame:
    """``query_id, gram``: the catalog's rarest 3-gram of each query (the query itself if shorter).

    ``gram_freq(gram, df)`` is the stored ``index.gram_index`` of the catalog.
    Without it the frequencies of the batch's grams are counted here: one
    aggregation over the catalog (partial, map-side), restricted to grams
    that occur in some query, so the table is bounded by the batch.
    """
    q3 = (qn.select("query_id", "q", F.explode(_grams(F.col("q"), F.lit(3))).alias("gram"))
          .where(F.length("q") >= 3))
    wanted = q3.select("gram").distinct()
    if gram_freq is not None:
        freq = gram_freq.select("gram", "df").join(wanted, "gram", "left_semi")
    else:
        freq = (searchable(cat)
                .select(F.explode(_grams(F.col("name_lc"), F.lit(3))).alias("gram"))
                .join(wanted, "gram", "left_semi")
                .groupBy("gram").agg(F.count(F.lit(1)).alias("df")))
    rarest = (q3.join(freq, "gram", "left")
              .groupBy("query_id")
              .agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram")))
    short = qn.where(F.length("q") < 3).select("query_id", F.col("q").alias("gram"))
    return rarest.unionByName(short)


def _substring_equi(items: DataFrame, cat: DataFrame, qn: DataFrame,
                    gram_freq: DataFrame | None = None) -> DataFrame:
    """Pairs where ``name_lc`` contains ``q``, found by equi-joining on one probe gram per query.

    Probe lengths are ``min(length(q), 3)``, so the lengths table has at most
    three rows and is broadcast by construction.
    """
    probes = probe_grams(cat, qn, gram_freq).join(qn, "query_id")
    lengths = probes.select(F.length("gram").alias("n")).distinct()
    item_grams = (items.join(F.broadcast(lengths), F.col("n") <= F.length("name_lc"))
                  .select(*items.columns, F.explode(_grams(F.col("name_lc"), F.col("n"))).alias("gram")))
    # One probe per query: broadcast after a count, so the exploded catalog
    # grams are joined map-side instead of being shuffled.
    probes, _ = checked_broadcast(probes)
    return (item_grams.join(probes, "gram", "inner").drop("gram")
            .where(F.col("name_lc").contains(F.col("q"))))


def hits_indexed(cat: DataFrame, qn: DataFrame, gram_freq: DataFrame | None = None) -> DataFrame:
    """Same pairs as ``hits_scan`` with equi-joins only, for batches too large to broadcast.

    * substring: each query probes with one gram (its rarest 3-gram, or the
      whole query when shorter than 3); catalog names are exploded into
      their distinct grams of the probe lengths and equi-joined, then
      ``contains`` verifies the candidate;
    * word: exploded name words equi-joined with exploded query words, kept
      only when not already a substring hit, so the two parts are disjoint.

    Hot grams and words are split by AQE's skew-join handling.
    """
    items = searchable(cat)
    by_substring = _substring_equi(items, cat, qn, gram_freq)
    words, _ = checked_broadcast(qn.select("query_id", F.explode("q_words").alias("word")).distinct())
    item_words = items.select(*HIT_COLUMNS, F.explode(F.array_distinct("tokens")).alias("word"))
    by_word = (item_words.join(words, "word", "inner").drop("word")
               .dropDuplicates(["query_id", "path"])
               .join(qn, "query_id")
               .where(~F.col("name_lc").contains(F.col("q"))))
    return with_match_flags(by_substring.unionByName(by_word))


# ---------------------------------------------------------------------------
# Individual strategies (each usable on its own).
# ---------------------------------------------------------------------------

def _literal_filter(qs: DataFrame, pred, max_literals: int = PUSHDOWN_LITERALS) -> Column:
    """OR of literal predicates over a tiny batch's query strings, or TRUE.

    Literal ``=`` / ``startswith`` on the stored ``name_lc`` reach the Parquet
    scan as ``In`` / ``StringStartsWith`` filters; catalog files are sorted by
    ``name_lc``, so row-group statistics skip most of the data. Only batches
    of at most ``max_literals`` queries (a counted bound) are turned into
    literals; the join above still decides the exact pairs.
    """
    if qs.count() > max_literals:
        return F.lit(True)
    values = sorted({r.q for r in qs.select("q").distinct().collect()})
    if not values:
        return F.lit(False)
    cond = None
    for v in values:
        c = pred(F.lit(v))
        cond = c if cond is None else (cond | c)
    return cond


def exact_match(cat: DataFrame, qn: DataFrame) -> DataFrame:
    """Strategy 1: lower-cased name equals the query (equi-join on ``name_lc``).

    Tiny batches also push ``name_lc IN (...)`` into the scan.
    """
    items = searchable(cat).where(_literal_filter(qn, lambda q: F.col("name_lc") == q))
    return (items.join(qn, F.col("name_lc") == F.col("q"), "inner")
            .select("query_id", "ordinal", "path"))


def prefix_pairs(cat: DataFrame, qn: DataFrame, max_broadcast: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """(query, item) pairs where the name starts with a non-empty query.

    Small batches: ``startswith`` against the broadcast batch. Large batches:
    each name is cut at every distinct query length (at most the longest
    query's length, a bounded broadcast table) and equi-joined on the cut.
    """
    qs = qn.where(F.col("q") != "")
    items = searchable(cat)
    batch, small = checked_broadcast(qs, max_broadcast)
    if small:
        items = items.where(_literal_filter(qs, lambda q: F.col("name_lc").startswith(q)))
        return (items.join(batch, F.col("name_lc").startswith(F.col("q")), "inner")
                .select("query_id", "ordinal", "path"))
    lengths = qs.select(F.length("q").alias("n")).distinct()
    cut = (items.join(F.broadcast(lengths), F.col("n") <= F.length("name_lc"))
           .select("ordinal", "path", F.expr("substring(name_lc, 1, n)").alias("q")))
    return cut.join(qs.select("query_id", "q"), "q", "inner").select("query_id", "ordinal", "path")


def prefix_match(cat: DataFrame, qn: DataFrame, n: int) -> DataFrame:
    """Strategy 2: the first ``n`` items (by arrival) whose name starts with the query.

    An empty prefix finds nothing. The cut is a skew-safe top-n by ordinal.
    """
    return top_n_per_group(prefix_pairs(cat, qn), ["query_id"], [F.col("ordinal"), F.col("path")], n,
                           rank_col="prefix_rank")


def word_match(cat: DataFrame, qn: DataFrame) -> DataFrame:
    """Strategy 3: any query word equals an indexed word of the name (OR over words)."""
    words = qn.select("query_id", F.explode("q_words").alias("word")).distinct()
    item_words = searchable(cat).select("ordinal", "path", F.explode(F.array_distinct("tokens")).alias("word"))
    return (item_words.join(words, "word", "inner")
            .select("query_id", "ordinal", "path")
            .dropDuplicates(["query_id", "path"]))


def substring_match(cat: DataFrame, qn: DataFrame, max_broadcast: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """Strategy 4: the query occurs anywhere in the lower-cased name.

    Small batches: ``contains`` against the broadcast batch (one catalog
    pass). Large batches: gram-blocked equi-join (see ``hits_indexed``).
    """
    batch, small = checked_broadcast(qn, max_broadcast)
    if small:
        return (searchable(cat).join(batch, F.col("name_lc").contains(F.col("q")), "inner")
                .select("query_id", "ordinal", "path"))
    return _substring_equi(searchable(cat), cat, qn).select("query_id", "ordinal", "path")


# ---------------------------------------------------------------------------
# Candidate sets.
# ---------------------------------------------------------------------------

def with_membership(hits: DataFrame, k: int) -> DataFrame:
    """Flag strategy 1-3 members: exact, word, or among the first ``2k`` prefix hits.

    The prefix cut is a skew-safe top-n with at most ``n_queries * 2k`` rows.
    It is stored and measured before the hits meet it, and broadcast within a
    bound: the hits are neither shuffled nor sorted unless the query batch is very large.
    """
    first_prefix = (top_n_per_group(hits.where("is_prefix").select("query_id", "ordinal", "path"),
                                    ["query_id"], [F.col("ordinal"), F.col("path")], 2 * k)
                    .select("query_id", "path", F.lit(True).alias("in_prefix_cut")))
    return (hits.join(broadcast_within(first_prefix, "prefix-cut"), ["query_id", "path"], "left")
            .withColumn("is_member", F.col("is_exact") | F.col("is_word")
                        | F.coalesce(F.col("in_prefix_cut"), F.lit(False)))
            .drop("in_prefix_cut"))


def member_counts(members: DataFrame) -> DataFrame:
    """``query_id, n_members`` (partial aggregation; one row per query)."""
    return (members.where("is_member").groupBy("query_id")
            .agg(F.count(F.lit(1)).alias("n_members")))


def union_strategies(hits: DataFrame, k: int) -> DataFrame:
    """Set union of the hits of strategies 1-3 (prefix cut at ``2k``); the hits are found once and stored."""
    return with_membership(staged(hits, "hits"), k).where("is_member")


def fallback_union(hits: DataFrame, k: int) -> DataFrame:
    """Strategies 1-3, plus every substring hit for queries with fewer than ``k`` of them.

    The hits are found once and stored: the prefix cut, the counts and the result read the stored pairs.
    The counts are one row per query, broadcast like the cut.
    """
    members = with_membership(staged(hits, "hits"), k)
    counts = broadcast_within(member_counts(members), "member-counts")
    return (members.join(counts, "query_id", "left")
            .withColumn("n_members", F.coalesce("n_members", F.lit(0)))
            .where(F.col("is_member") | (F.col("n_members") < k)))


def rank_results(candidates: DataFrame, bucket_bits: int = 16) -> DataFrame:
    """Exact rank of every candidate by ``score DESC, ordinal ASC``, without a per-query window over its hits.

    rank = (#candidates of the query with a higher score or, at the same score, in a lower block of ordinals)
         + (#in lower ordinal buckets of the block) + (row number inside the bucket).
    Buckets hold ``2^bucket_bits`` ordinals, blocks ``2^bucket_bits`` buckets. The
    counts are aggregations (combined map-side): one window sees a query's
    blocks, one a block's buckets, one a bucket's rows, so no query, however
    hot, lands in one task. The candidates are stored once and read twice.
    """
    c = (staged(candidates, "candidates").withColumn("_bucket", F.shiftright("ordinal", bucket_bits))
         .withColumn("_block", F.shiftright("_bucket", bucket_bits)))
    group = ["query_id", "score", "_block"]
    per_bucket = c.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    per_block = per_bucket.groupBy(*group).agg(F.sum("_n").alias("_n"))
    below = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = per_block.select(*group, below(Window.partitionBy("query_id").orderBy(F.desc("score"), "_block")).alias("_above"))
    offsets = (per_bucket.select(*group, "_bucket", below(Window.partitionBy(*group).orderBy("_bucket")).alias("_offset"))
               .join(blocks, group))
    inner = Window.partitionBy(*group, "_bucket").orderBy("ordinal", "path")
    return (c.join(offsets, [*group, "_bucket"], "inner")
            .withColumn("rank", (F.col("_above") + F.col("_offset") + F.row_number().over(inner)).cast("bigint"))
            .drop("_bucket", "_block", "_above", "_offset"))
