"""The growing catalog as a log of runs under a snapshot manifest.

A *run* is a Parquet table of items (``ordinal, depth, path_key, path, is_dir,
fresh``), one row per path, never changed once written. A *manifest* is one
row that names the live runs and carries the running figures: the exact number
of distinct paths, a HyperLogLog sketch of them, rows listed and set aside, the
deepest path and the range of ordinals. Both parts of a catalog's order, the
listing's ordinal and the depth, stay apart in the store; ``read_items``
joins them into one number when the deepest path is known.

* Snapshots: manifests are written to two slots in turn, so that the slot of
  the last version is never the one being replaced. A reader takes the highest
  version it finds, and a run belongs to the catalog only once a manifest
  names it. A job lost at any place leaves the last snapshot as it was.
* Compaction: as soon as a level holds ``fanout`` runs they are merged into one
  run of the next level, so the live runs number less than
  ``fanout * log(batches)`` and a row is rewritten once per level.
* Only the DataFrame API touches storage. Runs that no manifest names any more
  stay until the folder's owner removes them (readers may still use them).
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.operators.catalog import dedup_first_wins, matching, spread_ordinals, stride_for, with_item_columns
from findlake.operators.catalog import CATALOG_COLUMNS

RUN_SCHEMA = "ordinal BIGINT, depth INT, path_key STRING, path STRING, is_dir BOOLEAN, fresh BOOLEAN"
ORDER = ("ordinal", "depth", "path")
# Sketches of 2^12 registers: a relative standard error of 1.04 / sqrt(2^12), 1.6 %.
SKETCH_LG_K = 12
SKETCH_ERROR = 1.04 / math.sqrt(1 << SKETCH_LG_K)
_MANIFEST = ("version BIGINT, batch_id BIGINT, runs ARRAY<STRUCT<name: STRING, level: INT, n_rows: BIGINT>>, "
             "total_items BIGINT, listed BIGINT, set_aside BIGINT, deepest INT, low BIGINT, high BIGINT, sketch BINARY")


@dataclass(frozen=True)
class Run:
    name: str
    level: int
    n_rows: int


@dataclass(frozen=True)
class Snapshot:
    """One version of the store. ``total_items`` is exact; ``listed`` counts all listing rows, bad ones included."""
    version: int = 0
    batch_id: int = -1
    runs: list[Run] = field(default_factory=list)
    total_items: int = 0
    listed: int = 0
    set_aside: int = 0
    deepest: int = 0
    low: int = 0
    high: int = 0
    sketch: bytes | None = None


def _slot(root: str, version: int) -> str:
    return f"{root}/manifest/slot={version % 2}"


def _write_manifest(spark: SparkSession, root: str, snap: Snapshot, mode: str) -> None:
    row = (snap.version, snap.batch_id, [(r.name, r.level, r.n_rows) for r in snap.runs], snap.total_items, snap.listed,
           snap.set_aside, snap.deepest, snap.low, snap.high, None if snap.sketch is None else bytearray(snap.sketch))
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode(mode).parquet(_slot(root, snap.version))


def create(spark: SparkSession, root: str) -> None:
    """An empty store; one that is there already stays as it is."""
    for version in (-2, -1):
        _write_manifest(spark, root, Snapshot(version=version), "ignore")


def snapshot(spark: SparkSession, root: str) -> Snapshot:
    """The last complete version (a slot that is being replaced is passed over: the other one is whole)."""
    rows = (spark.read.schema(_MANIFEST).option("ignoreMissingFiles", "true").parquet(f"{root}/manifest")
            .orderBy(F.desc("version")).limit(1).drop("slot").collect())
    r = rows[0].asDict()
    return Snapshot(**{**r, "runs": [Run(*run) for run in r["runs"]],
                       "sketch": None if r["sketch"] is None else bytes(r["sketch"])})


def _read_runs(spark: SparkSession, root: str, runs: list[Run]) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], RUN_SCHEMA)
    return spark.read.schema(RUN_SCHEMA).parquet(*[f"{root}/runs/{r.name}" for r in runs])


def _write_run(rows: DataFrame, root: str, name: str) -> DataFrame:
    (rows.select("ordinal", "depth", "path_key", "path", "is_dir", "fresh").write.parquet(f"{root}/runs/{name}"))
    return rows.sparkSession.read.schema(RUN_SCHEMA).parquet(f"{root}/runs/{name}")


def commit_batch(spark: SparkSession, root: str, batch_id: int, items: DataFrame, *, listed: int, set_aside: int,
                 deepest: int, low: int, high: int, fanout: int = 8) -> Snapshot:
    """Add ``items(ordinal, depth, path_key, path, is_dir)``, one row per path, as batch ``batch_id``.

    A batch that the snapshot holds already changes nothing (a replay after a
    failure). Only rows that come before the stored row of their path are
    written; ``fresh`` marks paths that the store did not have, so the total
    grows by their number without looking at the rest of the catalog again.
    The stored keys meet the batch's keys in one join, which broadcasts a small
    batch; ``items`` should be a stored table, since it is read more than once.
    """
    old = snapshot(spark, root)
    if batch_id <= old.batch_id:
        return old
    if old.runs:
        stored = _read_runs(spark, root, old.runs).select("path_key", *ORDER)
        known = (matching(stored, items, "path_key").groupBy("path_key")
                 .agg(F.min(F.struct(*ORDER)).alias("_known")))
        marked = items.join(known, "path_key", "left").withColumn("fresh", F.col("_known").isNull())
        rows = marked.where(F.col("fresh") | (F.struct(*ORDER) < F.col("_known")))
    else:
        rows = items.withColumn("fresh", F.lit(True))
    name = f"level=0-batch={batch_id}-{uuid.uuid4().hex}"
    figures = _write_run(rows, root, name).agg(
        F.count("*").alias("n"), F.count_if("fresh").alias("fresh"),
        F.hll_sketch_agg("path_key", SKETCH_LG_K).alias("sketch")).first()
    sketch = old.sketch
    if figures["n"]:
        sketch = bytes(figures["sketch"])
        if old.sketch is not None:
            both = spark.createDataFrame([(bytearray(old.sketch), bytearray(sketch))], "a BINARY, b BINARY")
            sketch = bytes(both.select(F.hll_union("a", "b")).first()[0])
    new = replace(old, version=old.version + 1, batch_id=batch_id, sketch=sketch,
                  runs=old.runs + ([Run(name, 0, figures["n"])] if figures["n"] else []),
                  total_items=old.total_items + figures["fresh"], listed=old.listed + listed,
                  set_aside=old.set_aside + set_aside, deepest=max(old.deepest, deepest),
                  low=min(old.low, low), high=max(old.high, high))
    _write_manifest(spark, root, new, "overwrite")
    return compact(spark, root, fanout)


def compact(spark: SparkSession, root: str, fanout: int = 8) -> Snapshot:
    """Merge each level that holds ``fanout`` runs or more into one run of the next; rows and figures stay the same."""
    snap = snapshot(spark, root)
    level = 0
    while any(r.level >= level for r in snap.runs):
        full = [r for r in snap.runs if r.level == level]
        if len(full) >= fanout:
            name = f"level={level + 1}-{uuid.uuid4().hex}"
            merged = dedup_first_wins(_read_runs(spark, root, full), order=ORDER)
            n_rows = _write_run(merged, root, name).count()
            snap = replace(snap, version=snap.version + 1,
                           runs=[r for r in snap.runs if r.level != level] + [Run(name, level + 1, n_rows)])
            _write_manifest(spark, root, snap, "overwrite")
        level += 1
    return snap


def read_items(spark: SparkSession, root: str) -> DataFrame:
    """The catalog of the last snapshot: each path's first row over all runs, with the ordinals of a batch build."""
    snap = snapshot(spark, root)
    first = dedup_first_wins(_read_runs(spark, root, snap.runs).drop("fresh"), order=ORDER)
    items = spread_ordinals(first, stride_for(snap.deepest), snap.low, snap.high)
    return with_item_columns(items.select("ordinal", "path", "is_dir")).select(*CATALOG_COLUMNS)


def running_total(spark: SparkSession, root: str) -> DataFrame:
    """``total_items`` as kept with the snapshot (exact; no run is read)."""
    return spark.createDataFrame([(snapshot(spark, root).total_items,)], "total_items BIGINT")


def approximate_total(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``approx_items``: distinct paths over several stores, from their sketches alone (relative standard error
    ``SKETCH_ERROR``; paths that stores share count once)."""
    sketches = [(bytearray(s),) for s in (snapshot(spark, r).sketch for r in roots) if s is not None]
    merged = spark.createDataFrame(sketches, "sketch BINARY").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("bigint").alias("approx_items"))
