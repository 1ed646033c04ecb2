"""Search through stored indexes: equi-joins of a query batch with sorted postings.

``write_index`` numbers the items in arrival order (``item``: ordinal, then
path) and writes, next to the items themselves, tables clustered by what a
search looks up:

* ``names``  (head, name_lc, item, ...): sorted by name; ``head`` is a name's
  first three characters, so a prefix query meets one run of names;
* ``words``  (word, item, ...): one row per indexed word of an item;
* ``grams``  (gram, bucket): one row per distinct three characters of the names
  in a bucket of ``2^BUCKET_BITS`` items; a name's end is padded, so that every
  character starts a gram. Names that arrive together share most grams, which
  are one row there before anything is shuffled;
* ``heads`` and ``gram_counts``: the distinct heads and grams with their
  numbers of rows; a query of one or two characters stands for those that
  start with it.

Nothing here compares every item with every query. A batch of few queries
becomes literals, which the scans filter by; a larger one is joined, broadcast
while its bytes are bounded and shuffled beyond. Substrings intersect
the postings of a query's rarest grams; only the buckets that hold all of
them are looked up among the items, in their blocks, and their names verified.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findlake.functions import paths as P
from findlake.operators import search as S
from findlake.operators.catalog import MAX_BROADCAST_KEY_BYTES
from findlake.operators.numbering import sequential_number
from findlake.operators.topn import top_n_per_group
from findlake.session import staged

GRAM = 3
#: Rarest grams of a query whose postings are intersected before names are verified.
RAREST = 3
#: Items in a block (a folder of the items table) are 2 to this power.
BLOCK_BITS = 20
#: Items in a bucket (what a gram's postings name) are 2 to this power; a bucket lies in one block.
BUCKET_BITS = 8
#: Keys, and blocks, that become literal filters of a scan.
MAX_LITERALS = 512
_PAD = "\u0000" * (GRAM - 1)
_TABLES = ("items", "names", "words", "grams", "heads", "gram_counts")

_ITEMS = ("item bigint, ordinal bigint, path string, name string, name_lc string, parent string, parent_name string, "
          "is_dir boolean, tokens array<string>, points int, block bigint")


@dataclass(frozen=True)
class SearchIndex:
    """The tables of one index."""

    items: DataFrame
    names: DataFrame
    words: DataFrame
    grams: DataFrame
    heads: DataFrame
    gram_counts: DataFrame
    blocks: int


def _grams(text: Column, count: Column) -> Column:
    return F.when(count > 0, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, GRAM))))


def _bucket() -> Column:
    return F.shiftright("item", min(BUCKET_BITS, BLOCK_BITS)).alias("bucket")


def write_index(catalog: DataFrame, path: str) -> SearchIndex:
    """Write the index of ``catalog`` below ``path`` (a new folder) and open it."""
    spark, base = catalog.sparkSession, S.searchable(catalog).withColumn("points", S.item_points())
    numbered = sequential_number(base, [], ["ordinal", "path"], "item")
    (numbered.withColumn("block", F.shiftright("item", BLOCK_BITS)).sortWithinPartitions("block", "item")
     .write.partitionBy("block").parquet(f"{path}/items"))
    items = spark.read.schema(_ITEMS).parquet(f"{path}/items")
    carried = ["item", "ordinal", "path", "name_lc", "points"]

    def sorted_by(df: DataFrame, key: str, name: str, place: str = "item") -> None:
        # A key of many rows spreads over files: the item (or bucket) is part of the range.
        df.repartitionByRange(key, place).sortWithinPartitions(key, place).write.parquet(f"{path}/{name}")

    sorted_by(items.select(F.substring("name_lc", 1, GRAM).alias("head"), *carried), "name_lc", "names")
    sorted_by(items.select(F.explode(F.array_distinct("tokens")).alias("word"), *carried), "word", "words")
    padded = F.concat("name_lc", F.lit(_PAD))
    # Items are read in order, so the grams of a bucket meet in the task that reads it.
    sorted_by(items.select(F.explode(_grams(padded, F.length("name_lc"))).alias("gram"), _bucket()).distinct(),
              "gram", "grams", "bucket")
    for source, key, name in (("names", "head", "heads"), ("grams", "gram", "gram_counts")):
        (spark.read.parquet(f"{path}/{source}").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
         .write.parquet(f"{path}/{name}"))
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    # Its folders are blocks, of which an index of no items has none to infer a schema from.
    tables = [spark.read.schema(_ITEMS).parquet(f"{path}/items"), *[spark.read.parquet(f"{path}/{t}") for t in _TABLES[1:]]]
    return SearchIndex(*tables, blocks=tables[0].select("block").distinct().count())


# --- A batch meets postings ---

@dataclass(frozen=True)
class Batch:
    """Prepared queries, and their rows on the driver while they are at most ``MAX_LITERALS`` (else None)."""

    df: DataFrame
    rows: tuple | None

    @staticmethod
    def of(qn: DataFrame) -> Batch:
        rows = qn.limit(MAX_LITERALS + 1).collect()
        return Batch(qn, tuple(rows)) if len(rows) <= MAX_LITERALS else Batch(staged(qn, "batch"), None)


def _few(postings: DataFrame, key: str, wanted: dict[str, list], short: list, text: str | None, schema: str) -> DataFrame:
    """``postings`` and the queries that want them, for a few queries: literals, which the scan filters by.

    ``wanted`` gives the queries of a key, ``short`` those of every key (or ``text``) that starts with them.
    """
    kind = f"array<struct<{schema}>>"
    listed = lambda rows: F.array(*[F.struct(*[F.lit(x) for x in r]) for r in rows]).cast(kind)
    found = F.col(key).isin(list(wanted)) if wanted else F.lit(False)
    for r in short:
        found = found | F.col(text).startswith(r[1])
    asked = listed(short)
    if wanted:
        own = F.create_map(*[x for k, rows in wanted.items() for x in (F.lit(k), listed(rows))])[F.col(key)]
        asked = F.concat(F.coalesce(own, listed([])), asked)
    met = postings.where(found).withColumn("asked", F.explode(asked)).select("*", "asked.*").drop("asked")
    return met.where((F.length("q") >= GRAM) | F.col(text).startswith(F.col("q"))) if short else met


def _many(postings: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """``postings`` joined with a large batch's ``probes``, which are broadcast while their bytes are bounded."""
    size = probes.agg(F.sum(sum((F.octet_length(F.col(c).cast("string")) + 8 for c in probes.columns), F.lit(16)))).first()[0]
    return postings.join(F.broadcast(probes) if (size or 0) <= MAX_BROADCAST_KEY_BYTES else probes, key)


def _starting(queries: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(query_id, q, key): all keys that start with a query shorter than a key, by equality with the keys' cuts."""
    cuts = keys.select(key, F.explode(F.array(*[F.substring(key, 1, n) for n in range(1, GRAM)])).alias("cut")).distinct()
    short = queries.where(F.length("q").between(1, GRAM - 1)).select("query_id", "q")
    return short.join(cuts, F.col("q") == F.col("cut")).select("query_id", "q", key)


def _scored(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", (S.match_points(F.col("name_lc"), F.col("q")) + F.col("points")).cast("bigint"))


def _grouped(pairs) -> dict[str, list]:
    out: dict[str, list] = {}
    for key, row in pairs:
        out.setdefault(key, []).append(row)
    return out


_HIT = ["query_id", "q", "item", "ordinal", "path", "name_lc", "points"]
_ASKED = "query_id: bigint, q: string"


def prefix_hits(index: SearchIndex, batch: Batch) -> DataFrame:
    """(query_id, q, item, ordinal, path, name_lc, points) of names that start with a non-empty query."""
    if batch.rows is not None:
        wanted = _grouped((r.q[:GRAM], (r.query_id, r.q)) for r in batch.rows if len(r.q) >= GRAM)
        short = [(r.query_id, r.q) for r in batch.rows if 0 < len(r.q) < GRAM]
        met = _few(index.names, "head", wanted, short, "name_lc", _ASKED)
    else:
        long = batch.df.where(F.length("q") >= GRAM).select("query_id", "q", F.substring("q", 1, GRAM).alias("head"))
        met = _many(index.names, long.unionByName(_starting(batch.df, index.heads, "head")), "head")
    return met.where(F.col("name_lc").startswith(F.col("q"))).select(*_HIT)


def word_postings_hits(index: SearchIndex, batch: Batch) -> DataFrame:
    """The same columns, once per query, item and word that they share."""
    if batch.rows is not None:
        wanted = _grouped((w, (r.query_id, r.q)) for r in batch.rows for w in dict.fromkeys(r.q_words))
        return _few(index.words, "word", wanted, [], None, _ASKED).select(*_HIT)
    return _many(index.words, batch.df.select("query_id", "q", F.explode("q_words").alias("word")), "word").select(*_HIT)


def word_hits(index: SearchIndex, batch: Batch) -> DataFrame:
    """The same columns, once per query and item of which any word equals any of the query's."""
    return word_postings_hits(index, batch).dropDuplicates(["query_id", "item"])


def _probes(index: SearchIndex, qn: DataFrame) -> DataFrame:
    """(query_id, q, gram, need): the grams whose postings hold a query's substring hits, ``need`` of them each.

    Queries of three characters or more give their rarest grams, all of which
    an item must have; one with a gram that no name has gives none.
    """
    own = _grams(F.col("q"), F.length("q") - GRAM + 1)
    asked = (qn.where(F.length("q") >= GRAM).select("query_id", "q", own.alias("all"))
             .select("query_id", "q", F.size("all").alias("asked"), F.explode("all").alias("gram")))
    # A batch's grams, with their counts: a few rows per query.
    per = Window.partitionBy("query_id")
    rare = (_many(index.gram_counts, asked, "gram").withColumn("found", F.count(F.lit(1)).over(per))
            .withColumn("nth", F.row_number().over(per.orderBy("n", "gram")))
            .where((F.col("found") == F.col("asked")) & (F.col("nth") <= RAREST))
            .select("query_id", "q", "gram", F.least(F.col("asked"), F.lit(RAREST)).alias("need")))
    return rare.unionByName(_starting(qn, index.gram_counts, "gram").withColumn("need", F.lit(1)))


def _gram_hits(index: SearchIndex, batch: Batch) -> DataFrame:
    """(query_id, q, bucket, need) of the postings of each query's probes."""
    if batch.rows is None:
        return _many(index.grams, staged(_probes(index, batch.df), "gram-probes"), "gram")
    own = [(r, sorted({r.q[i:i + GRAM] for i in range(len(r.q) - GRAM + 1)})) for r in batch.rows]
    every = sorted({g for _, grams in own for g in grams})
    counts = dict(index.gram_counts.where(F.col("gram").isin(every)).collect()) if every else {}
    wanted = []
    for r, grams in own:
        if grams and all(g in counts for g in grams):
            rare = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
            wanted += [(g, (r.query_id, r.q, len(rare))) for g in rare]
    short = [(r.query_id, r.q, 1) for r in batch.rows if 0 < len(r.q) < GRAM]
    return _few(index.grams, "gram", _grouped(wanted), short, "gram", _ASKED + ", need: int")


def _items_in(index: SearchIndex, hits: DataFrame, block: Column) -> DataFrame:
    """The items of the blocks that ``hits``, a stored table, name; all of them if these are many."""
    if index.blocks > 1:
        blocks = [r[0] for r in hits.select(block).distinct().limit(MAX_LITERALS + 1).collect()]
        if len(blocks) <= MAX_LITERALS:
            return index.items.where(F.col("block").isin(blocks) if blocks else F.lit(False))
    return index.items


def items_of(index: SearchIndex, hits: DataFrame, *columns: str) -> DataFrame:
    """``hits`` (with ``item``) and ``columns`` of their items. With several blocks, only those that hold them are read."""
    if index.blocks > 1:
        hits = staged(hits, "hit-items")
    items = _items_in(index, hits, F.shiftright("item", BLOCK_BITS))
    return hits.join(items.select("item", *columns), "item")


def substring_hits(index: SearchIndex, batch: Batch) -> DataFrame:
    """The same columns for names that contain the query: postings intersected, then verified.

    The buckets that hold all probes of a query are found first; their items pass
    once, and each name is compared with the queries of its bucket alone.
    """
    found = (_gram_hits(index, batch).groupBy("query_id", "q", "bucket")
             .agg(F.count(F.lit(1)).alias("have"), F.max("need").alias("need")).where("have >= need"))
    if batch.rows is None:
        found = staged(found.select("query_id", "q", "bucket"), "hit-buckets")
        size = F.octet_length("q") + 32
    else:  # at most MAX_LITERALS queries a bucket
        found = staged(found.groupBy("bucket").agg(F.collect_list(F.struct("query_id", "q")).alias("asked")), "hit-buckets")
        size = F.aggregate("asked", F.lit(32), lambda n, a: n + F.octet_length(a["q"]) + 32)
    bits = min(BUCKET_BITS, BLOCK_BITS)
    items = (_items_in(index, found, F.shiftright("bucket", BLOCK_BITS - bits))
             .select("item", "ordinal", "path", "name_lc", "points", _bucket()))
    small = (found.agg(F.sum(size)).first()[0] or 0) <= MAX_BROADCAST_KEY_BYTES
    met = items.join(F.broadcast(found) if small else found, "bucket")
    if batch.rows is None:
        return met.where(F.col("name_lc").contains(F.col("q"))).select(*_HIT)
    hit = F.explode(F.filter("asked", lambda a: F.col("name_lc").contains(a["q"])))
    return met.withColumn("asked", hit).select("*", "asked.*").select(*_HIT)


def all_hits(index: SearchIndex, batch: Batch) -> DataFrame:
    """Every (item, query) pair with a substring or word hit and its flags, as ``search.hits_scan`` gives them; stored once."""
    words = word_hits(index, batch).select("query_id", "item", F.lit(True).alias("by_word"))
    subs = substring_hits(index, batch).select("query_id", "item")
    pairs = staged(subs.join(words, ["query_id", "item"], "full_outer"), "hits")
    rows = items_of(index, pairs, *S.HIT_COLUMNS, "points").join(
        batch.df.select("query_id", "raw", "q", "q_words", "single_word"), "query_id")
    return staged(S.with_match_flags(rows.withColumnRenamed("points", "_item_points")).withColumn(
        "is_word", F.coalesce("by_word", F.lit(False))).drop("by_word", "item"), "hits")


# --- The multi-strategy search ---

def _top(hits: DataFrame, stream: str, n: int) -> DataFrame:
    """The first ``n`` rows of a stream per query: prefix hits by arrival, others by score, then arrival."""
    order = [F.col("item")] if stream == "p" else [F.desc("score"), F.col("item")]
    best = top_n_per_group(hits.select("query_id", "item", "score"), ["query_id"], order, n, rank_col="nth").drop("nth")
    return best.withColumn("stream", F.lit(stream))


def _word_members(index: SearchIndex, batch: Batch, n: int) -> DataFrame:
    """At least the best ``n`` word hits of each query, once or more each.

    An item has one row per word that it shares with a query, all of one
    score; so ``n`` times a few queries' most words hold ``n`` items.
    """
    if batch.rows is None:
        return _top(_scored(word_hits(index, batch)), "m", n)
    words = max((len(r.q_words) for r in batch.rows), default=1)
    return _top(_scored(word_postings_hits(index, batch)), "m", n * max(1, words))


def search(index: SearchIndex, queries: DataFrame, k: int = S.DEFAULT_RESULTS) -> DataFrame:
    """Best ``k`` items per query: ``query_id, rank, path, name, item_type, parent, score, ordinal``.

    Exact and word hits (m) and prefix hits (p) come from their postings; the
    queries that have fewer than ``k`` of them, and only these, look up their
    substring hits (c). Each stream keeps its first ``2k`` per query or more, which
    decides both the number of members and the best ``k`` (see ``plans.search``).
    """
    batch = Batch.of(S.prepare_queries(queries))
    prefix = _scored(prefix_hits(index, batch))
    exact = prefix.where(F.col("name_lc") == F.col("q"))
    streams = staged(_word_members(index, batch, 2 * k).unionByName(_top(exact, "m", 2 * k))
                     .unionByName(_top(prefix, "p", 2 * k)), "streams")
    counts = streams.groupBy("query_id").agg(F.count_distinct("item").alias("n")).where(F.col("n") >= k)
    if batch.rows is not None:
        enough = {r.query_id for r in counts.select("query_id").collect()}
        few = Batch(batch.df, tuple(r for r in batch.rows if r.query_id not in enough))
        fallback = bool(few.rows)
    else:
        few = Batch(staged(batch.df.join(counts, "query_id", "left_anti"), "fallback"), None)
        fallback = bool(few.df.limit(1).count())
    rows = streams
    if fallback:
        rows = rows.unionByName(_top(_scored(substring_hits(index, few)), "c", 2 * k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("item"))
    ranked = (rows.select("query_id", "item", "score").distinct()
              .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    return items_of(index, ranked, "ordinal", "path", "name", "parent", "is_dir").select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "path", "name", P.item_type("is_dir").alias("item_type"),
        "parent", "score", "ordinal")


def first_by_arrival(hits: DataFrame, n: int, rank: str = "prefix_rank") -> DataFrame:
    """The first ``n`` hits of each query in arrival order."""
    return top_n_per_group(hits, ["query_id"], [F.col("item")], n, rank_col=rank)
