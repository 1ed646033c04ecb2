"""Helpers shared by the operators: shared tables, row keys, ranks without large groups, bounded filters."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findlake import checkpoint_dir

#: White space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/findlake-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back.

    This cuts the lineage and fixes rows whose order or partition is not
    deterministic; lost executors cannot take the table with them.
    """
    path = shared_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of ``keys``."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, all with as many underscores before them as it takes to be no columns of ``df``."""
    taken, names = {c.lower() for c in df.columns}, list(names)
    while taken & {n.lower() for n in names}:
        names = [f"_{n}" for n in names]
    return names


def ranked_within(df: DataFrame, group: list[str], order: list[str], rank: str, name: str) -> DataFrame:
    """``df`` plus ``rank``: the row's 0-based place within its group, ordered by ``order``.

    Rows are range-partitioned by group and order, so that a group of any size
    spreads over partitions; a row's place is its place among its group's rows
    in its own partition plus the counts of the partitions before. Rows that
    tie in ``order`` get distinct places in no fixed order. ``group`` may be
    empty; its columns may be null. Columns starting with ``_r_`` are internal.
    """
    by = [*group, *order]
    parts = (df.withColumn("_r_row", F.monotonically_increasing_id())
             .repartitionByRange(*by, "_r_row").sortWithinPartitions(*by, "_r_row")
             .withColumn("_r_pid", F.spark_partition_id()))
    parts = stored(parts, name)
    counts = parts.groupBy("_r_pid", *group).agg(F.count("*").alias("_r_n"))
    before = Window.partitionBy(*group).orderBy("_r_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_r_pid", *group, F.coalesce(F.sum("_r_n").over(before), F.lit(0)).alias("_r_off"))
    offsets = offsets.select(F.col("_r_pid").alias("_r_p"), *[F.col(g).alias(f"_r_g{i}") for i, g in enumerate(group)],
                             "_r_off")
    cond = F.col("_r_pid") == F.col("_r_p")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_r_g{i}"))
    here = Window.partitionBy("_r_pid", *group).orderBy(*order, "_r_row")
    local = parts.withColumn("_r_here", F.row_number().over(here) - 1)
    return (local.join(offsets, cond)
            .withColumn(rank, (F.col("_r_here") + F.col("_r_off")).cast("long"))
            .select(*df.columns, rank))


#: Bits of a membership filter; its words make 2 MB, whatever the number of keys.
FILTER_BITS = 1 << 24


def member_filter(keys: DataFrame, column: str) -> DataFrame:
    """A bitmap over ``column`` (64-bit hashes) of ``keys`` as at most ``FILTER_BITS / 64`` rows (word, bits)."""
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS))
    return (keys.where(F.col(column).isNotNull())
            .select(F.shiftright(bit, 6).alias("_f_word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
            .groupBy("_f_word").agg(F.bit_or("b").alias("_f_bits")))


def split_by_filter(df: DataFrame, key, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in the filter, rows whose key is not): never a false negative.

    The bitmap's size has a fixed bound, so it is broadcast and the rows of
    ``df`` stay where they are; an exact join need only see the first part.
    """
    keyed = df.withColumn("_f_key", key)
    word = F.shiftright(F.pmod(F.col("_f_key"), F.lit(FILTER_BITS)), 6)
    marked = keyed.join(F.broadcast(bitmap), word == F.col("_f_word"), "left")
    hit = F.coalesce(F.expr("(_f_bits & shiftleft(1L, cast(_f_key & 63 as int))) != 0"), F.lit(False))
    marked = marked.withColumn("_f_hit", hit)
    return (marked.where("_f_hit").select(*df.columns, "_f_key"), marked.where("not _f_hit").select(*df.columns))


#: Most bytes in an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_BYTES``: both sides hold whole batches, some in several copies."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(str(spark.conf.get(setting, str(64 << 20))).rstrip("bB"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def tidy(run):
    """``run`` (batches to batches) that leaves no unused memory with its worker.

    Spark keeps Python workers for later tasks, also those of later queries;
    what the allocators hold back would count against the executor until then.
    """
    def task(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)
    return task


#: A worker takes a batch's texts in slices of about this many bytes, whatever Spark's batch size.
SLICE_BYTES = 8 << 20


def slices(batch, column: str, most: int = SLICE_BYTES):
    """``batch`` (Arrow) in row slices whose ``column`` holds about ``most`` bytes (one row at least)."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, done + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def utf8(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null: empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
