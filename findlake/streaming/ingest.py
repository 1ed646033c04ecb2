"""Incremental catalog ingest with Structured Streaming.

Listing rows (``ordinal, path, is_dir``) arrive as files in a folder. Each
micro-batch is turned into catalog rows and appended, skipping rows that the
catalog already has earlier; ``read_ingested`` merges the batches. Two forms:

* ``ingest_with_state``: ``dropDuplicates(['path_key'])`` in the stream. Paths
  carry no event time, so no watermark can bound the state: fine for bounded
  inputs, not for endless ones.
* ``ingest_foreach_batch`` (default): a stateless stream whose ``foreachBatch``
  commits each batch to a store of runs (``streaming.store``): the store is the
  state. Rows that cannot become items go to a second sink, ``set_aside``, one
  folder per batch with mode overwrite; a batch that the store's snapshot
  holds already is passed over, so a replay after a failure changes nothing.
  Batches are merged into larger runs as they come, and the exact number of
  items and a mergeable sketch of them are kept with every snapshot.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from findlake.functions import paths as P
from findlake.functions import text as X
from findlake.operators.catalog import (dedup_first_wins, implied_items, listing_bounds, normalise_listing,
                                        normalised_paths, set_aside_listing, skip_system_dirs, sound_listing, with_item_columns)
from findlake.session import staged
from findlake.sources.fixtures import fixture_listing
from findlake.streaming import store as ST

LISTING_SCHEMA = "ordinal BIGINT, path STRING, is_dir BOOLEAN"


def ingest_with_state(spark: SparkSession, source_dir: str) -> DataFrame:
    """Streaming DataFrame of new catalog rows, de-duplicated by ``path_key`` in state.

    Only the listed rows are ingested (folder expansion is an aggregation and
    belongs to the ``foreachBatch`` form); which copy of a duplicate survives
    is the first one to arrive.
    """
    stream = sound_listing(spark.readStream.schema(LISTING_SCHEMA).parquet(source_dir))
    items = skip_system_dirs(with_item_columns(normalise_listing(stream)))
    return items.dropDuplicates(["path_key"])


def ingest_batch(batch: DataFrame, batch_id: int, catalog_dir: str, fanout: int = 8) -> ST.Snapshot:
    """Commit one batch of listing rows: sound rows to the store, the others to ``set_aside`` with a reason.

    ``batch`` is read twice (bad rows; normalised paths); its normalised rows and
    its items are stored before they are used again.
    """
    spark = batch.sparkSession
    # A replay may follow a failure between the two sinks: the bad rows of the batch are written over.
    (set_aside_listing(batch).write.mode("overwrite").parquet(f"{catalog_dir}/set_aside/batch={batch_id}"))
    set_aside = spark.read.schema(LISTING_SCHEMA).parquet(f"{catalog_dir}/set_aside/batch={batch_id}").count()
    # Paths are normalised once; bounds, items and folders read the stored rows.
    read = normalised_paths(batch)
    sound = sound_listing(read, normalised=True)
    deepest, low, high = listing_bounds(sound, normalised=True)
    kept = implied_items(sound, normalised=True).where(~P.under_system_dir("path")).withColumn("path_key", X.case_fold("path"))
    items = staged(dedup_first_wins(kept, order=ST.ORDER), "ingest-batch")
    return ST.commit_batch(spark, catalog_dir, batch_id, items, listed=read.count(), set_aside=set_aside,
                           deepest=deepest, low=low, high=high, fanout=fanout)


def ingest_foreach_batch(spark: SparkSession, source_dir: str, catalog_dir: str, checkpoint: str,
                         files_per_batch: int = 1, fanout: int = 8) -> None:
    """Run the stream until the source folder is drained (``availableNow``)."""
    ST.create(spark, catalog_dir)
    stream = (spark.readStream.schema(LISTING_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
              .parquet(source_dir))
    query = (stream.writeStream.foreachBatch(lambda batch, batch_id: ingest_batch(batch, batch_id, catalog_dir, fanout))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def read_ingested(spark: SparkSession, catalog_dir: str) -> DataFrame:
    """The catalog of all batches: the rows that one batch build of the whole listing gives."""
    return ST.read_items(spark, catalog_dir)


def read_set_aside(spark: SparkSession, catalog_dir: str) -> DataFrame:
    """``ordinal, path, is_dir, reason, batch`` of the listing rows that became no items."""
    return spark.read.schema(LISTING_SCHEMA + ", reason STRING, batch BIGINT").parquet(f"{catalog_dir}/set_aside")


def ingest_fixture(spark: SparkSession, sf_dir: str, base_dir: str, n_files: int = 4,
                   batch_files: int | None = None) -> DataFrame:
    """Stream the fixture listing (split into ``n_files`` arrivals) into a catalog; return the catalog.

    An arrival is one micro-batch of ``batch_files`` files (as many as the session runs tasks at once unless given),
    so that every core has a part of it.
    """
    import uuid
    run = os.path.join(base_dir, uuid.uuid4().hex)
    source = os.path.join(run, "listing")
    batch_files = batch_files or max(1, spark.sparkContext.defaultParallelism)
    (fixture_listing(spark, sf_dir).repartition(n_files * batch_files, "ordinal")
     .write.mode("overwrite").parquet(source))
    catalog_dir = os.path.join(run, "catalog")
    ingest_foreach_batch(spark, source, catalog_dir, os.path.join(run, "checkpoint"), files_per_batch=batch_files)
    return read_ingested(spark, catalog_dir)
