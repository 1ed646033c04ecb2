"""Counts for every prefix of every name, from the sorted distinct names.

In sorted order the names that share a prefix stand next to each other, so a
prefix of length d ends where a name shares fewer than d characters with the
one before it. One pass over sorted names with a stack of open prefixes (one
per length, so never more than the longest name) yields each prefix once, with
its counts complete. Only the distinct names are shuffled: once to count them,
once into ranges.

A range can cut a run of equal prefixes only at its ends. The prefixes of its
first and last name are therefore marked, at most two names' lengths per range,
and only these are summed over the ranges; all others are final where they
were found.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.session import staged

_OUT = "prefix STRING, n_items BIGINT, first_ordinal BIGINT, at_edge BOOLEAN"
_OUT_NAMES = ["prefix", "n_items", "first_ordinal", "at_edge"]
# Rows that a task gathers before it hands them to Spark.
_FLUSH_ROWS = 1 << 16


def _shared(a: str, b: str) -> int:
    """Number of leading characters that two names share."""
    end = min(len(a), len(b))
    return next((i for i in range(end) if a[i] != b[i]), end)


def _closed_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(name_lc, n_items, first_ordinal)`` of one range -> its prefixes, each once."""
    name, edge = None, 0            # edge: characters that the name shares with the first one of the range
    counts: list[int] = []          # counts[d], firsts[d]: of the open prefix with d + 1 characters
    firsts: list[int] = []
    out: list[tuple] = []

    def close(keep: int, last: bool = False) -> None:
        while len(counts) > keep:
            n, first, d = counts.pop(), firsts.pop(), len(counts) + 1
            if counts:
                counts[-1] += n
                firsts[-1] = min(firsts[-1], first)
            out.append((name[:d], n, first, last or d <= edge))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=_OUT_NAMES)
        out.clear()
        return batch

    for batch in batches:
        for new, n, first in zip(*(c.to_pylist() for c in batch.columns)):
            keep = 0 if name is None else _shared(name, new)
            close(keep)
            edge = len(new) if name is None else min(edge, keep)
            grown = len(new) - keep
            counts.extend([0] * grown)
            firsts.extend([first] * grown)
            name = new
            counts[-1] += n
            firsts[-1] = min(firsts[-1], first)
            if len(out) >= _FLUSH_ROWS:
                yield flush()
    if name is not None:
        close(0, last=True)
        yield flush()


def prefix_counts(catalog: DataFrame, num_ranges: int | None = None) -> DataFrame:
    """``prefix, n_items, first_ordinal`` for every prefix of the lower-cased names, to their whole length.

    Names are counted first, so copies of a name (a third of all items may
    share one) are one row from there on. Blank and null names have no prefix.
    """
    names = (catalog.where(F.length("name_lc") > 0).groupBy("name_lc")
             .agg(F.count(F.lit(1)).alias("n_items"), F.min("ordinal").alias("first_ordinal")))
    ranges = names.repartitionByRange(num_ranges, "name_lc") if num_ranges else names.repartitionByRange("name_lc")
    found = staged(ranges.sortWithinPartitions("name_lc").mapInArrow(_closed_prefixes, _OUT), "prefixes")
    cut = (found.where("at_edge").groupBy("prefix")
           .agg(F.sum("n_items").alias("n_items"), F.min("first_ordinal").alias("first_ordinal")))
    return found.where("not at_edge").drop("at_edge").unionByName(cut)
