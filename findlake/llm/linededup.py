"""Line dedup over a corpus, in DataFrame functions only: range-partitioned line hashes, streamed in order.

Every line becomes a row (hash of its key, document, position). The rows are
range-partitioned by hash and document and sorted by position inside, so the
lines of one key lie next to each other, first occurrence first; a stream over
each sorted range numbers the documents of every key. A key that a third of
all lines share spreads over many ranges: only the first and the last key of a
range can reach into another, and one small row for each of these carries the
number over. The result is a run-length keep bitmap for each document; texts
never travel with the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.llm.common import stored

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "".join(map(chr, range(65, 91)))


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(
        F.translate(bare, _UPPER, _UPPER.lower()))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def line_places(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 1) -> DataFrame:
    """One row per line whose key has ``min_chars`` code points or more: two hashes of the key, id, text hash, position.

    The hashes together have 128 bits, which stand for the key.
    """
    lines = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("t"), F.posexplode(_lines(text)).alias("pos", "line"))
    keyed = lines.select("id", "t", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= max(1, min_chars))
    return keyed.select(F.xxhash64("k").alias("h"), F.xxhash64(F.lit(1), "k").alias("g"), "id", "t", "pos")


def streamed(places: DataFrame) -> DataFrame:
    """``places`` plus ``nth`` (the number of its document among those of its key, from 1), ``first`` (whether the line
    is its key's first in that document) and ``n_docs`` (documents of the key), all counted in the whole table."""
    ranges = (stored(places, "line-places").repartitionByRange("h", "g", "id", "t")
              .sortWithinPartitions("h", "g", "id", "t", "pos").withColumn("pid", F.spark_partition_id()))
    here = Window.partitionBy("pid", "h", "g").orderBy("id", "t", "pos")
    before = F.lag(F.struct(F.struct("id", "t").alias("doc"), "pos")).over(here)
    runs = ranges.withColumn("before", before).withColumn(
        "first", F.col("before").isNull() | ~F.col("before.doc").eqNullSafe(F.struct("id", "t")))
    runs = (runs.withColumn("nth", F.sum(F.col("first").cast("long")).over(
                here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .withColumn("n_docs", F.max("nth").over(Window.partitionBy("pid", "h", "g")))
            # Rows that agree in id and text: each line counts once.
            .where(F.col("first") | (F.col("before.pos") != F.col("pos"))).drop("before"))
    runs = stored(runs, "line-runs")
    # Keys that reach over the edge of a range: at most two rows a range, so the table may be broadcast.
    ends = runs.groupBy("pid").agg(F.min(F.struct("h", "g")).alias("lo"), F.max(F.struct("h", "g")).alias("hi"))
    cut = (ends.select("pid", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("k"))
           .groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k.h", "k.g"))
    parts = runs.join(F.broadcast(cut), ["h", "g"]).groupBy("pid", "h", "g").agg(F.max("nth").alias("n"))
    key = Window.partitionBy("h", "g")
    parts = stored(parts.select("pid", "h", "g", F.sum("n").over(key).alias("all_docs"), F.coalesce(
        F.sum("n").over(key.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier")),
        "line-edges")
    return (runs.join(F.broadcast(parts), ["pid", "h", "g"], "left")
            .select("id", "t", "pos", "first", (F.col("nth") + F.coalesce("earlier", F.lit(0))).alias("nth"),
                    F.coalesce("all_docs", "n_docs").alias("n_docs")))


def dropped_lines(docs: DataFrame, min_docs: int, keep_first: bool, key: str = "doc_id", text: str = "text",
                  min_chars: int = 1) -> DataFrame:
    """One row per document that loses lines: id, t (its text's hash) and ``gone``, the positions lost in order."""
    seen = streamed(line_places(docs, key, text, min_chars)).where(F.col("n_docs") >= min_docs)
    if keep_first:
        seen = seen.where(~(F.col("first") & (F.col("nth") == 1)))
    return stored(seen.groupBy("id", "t").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "line-drops")


def _with_runs(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``df`` plus n_lines, n_dropped and ``keep_runs`` from its ``n`` and ``gone``."""
    ends = F.concat(F.array(F.lit(-1)), F.coalesce("gone", F.array().cast("array<int>")), F.array(F.col("n")))
    df = df.withColumn("ends", ends)
    runs = F.zip_with(F.slice("ends", F.lit(1), F.size("ends") - 1), F.slice("ends", F.lit(2), F.size("ends") - 1),
                      lambda x, y: F.struct((x + 1).alias("first"), (y - x - 1).alias("n")))
    return df.select(*keep, F.col("n").cast("long").alias("n_lines"), (F.size("ends") - 2).cast("long").alias("n_dropped"),
                     F.filter(runs, lambda r: r["n"] > 0).alias("keep_runs"))


def _to_drops(df: DataFrame, drops: DataFrame) -> DataFrame:
    """Left join by document; a merge join at every size, since the drops grow with the documents."""
    lost = drops.hint("merge").select(F.col("id").alias("drop_id"), F.col("t").alias("drop_t"), "gone")
    return df.join(lost, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("t") == F.col("drop_t")), "left")


def line_bitmaps(docs: DataFrame, min_docs: int = 1, keep_first: bool = True, key: str = "doc_id", text: str = "text",
                 min_chars: int = 1) -> DataFrame:
    """One row per document: key, text_hash, n_lines, n_dropped, keep_runs (first line and number of lines of each run kept).

    Lines whose key occurs in ``min_docs`` documents or more go, but for the
    key's first occurrence (by id, nulls first, then text hash, then position)
    if ``keep_first``. Keys below ``min_chars`` code points stay. A null or empty
    text is one empty line. Rows that agree in key and text count as one
    document and share their bitmap; an empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    drops = dropped_lines(docs, min_docs, keep_first, key, text, min_chars)
    sized = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("t"), F.size(_lines(text)).alias("n"))
    return _with_runs(_to_drops(sized, drops), ["id", "t"]).select(
        F.col("id").alias(key), F.col("t").alias("text_hash"), "n_lines", "n_dropped", "keep_runs")


def kept_texts(docs: DataFrame, min_docs: int = 1, keep_first: bool = True, key: str = "doc_id", text: str = "text",
               min_chars: int = 1) -> DataFrame:
    """``line_bitmaps`` and each document's text without the dropped lines, as column ``kept``."""
    drops = dropped_lines(docs, min_docs, keep_first, key, text, min_chars)
    split = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    lines = _to_drops(split, drops).withColumn("lines", _lines("text")).withColumn("n", F.size("lines"))
    runs = _with_runs(lines, ["id", "t", "lines"])
    kept = F.flatten(F.transform("keep_runs", lambda r: F.slice(F.col("lines"), r["first"] + 1, r["n"])))
    return runs.select(F.col("id").alias(key), F.col("t").alias("text_hash"), "n_lines", "n_dropped", "keep_runs",
                       F.array_join(kept, "\n").alias("kept"))
