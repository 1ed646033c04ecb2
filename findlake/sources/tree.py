"""Listing real directory trees.

``list_tree`` walks a folder that driver and executors both see (a mounted
file system) and loses nothing: hidden names, empty files and empty folders
are listed. It is a Python data source: the driver looks at the upper folders
only, until there are enough of them to share out, and each task walks the
subtrees of its share.

``list_files`` takes any file system that Spark reads, through ``binaryFile``
(``content`` is pruned, so no file is read). That source returns files only and
skips empty ones and names starting with '.' or '_'.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TREE_SCHEMA = "path STRING, is_dir BOOLEAN, error STRING"
# Folders at which the driver stops to look further down; each is one task's subtree.
DEFAULT_SPLITS = 256


def _text(path: str) -> str:
    """A path as valid text: bytes that are no UTF-8 become ``\\xNN``."""
    return os.fsencode(path).decode("utf-8", "backslashreplace")


def _entries(folder: str) -> tuple[list[tuple], list[str]]:
    """Rows of a folder's own entries, and the folders among them to go into (links are listed, not followed).

    A folder or entry that cannot be read gives one row with the error's name.
    """
    rows, below = [], []
    try:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    is_dir = entry.is_dir()
                    rows.append((_text(entry.path), is_dir, None))
                    if is_dir and not entry.is_symlink():
                        below.append(entry.path)
                except OSError as failed:
                    rows.append((_text(entry.path), None, type(failed).__name__))
    except OSError as failed:
        rows.append((_text(folder), True, type(failed).__name__))
    return rows, below


def _walk(folder: str) -> Iterator[tuple]:
    """Rows of everything below a folder; holds the folders still to visit, not the rows."""
    waiting = [folder]
    while waiting:
        rows, below = _entries(waiting.pop())
        yield from rows
        waiting.extend(below)


class _Share(InputPartition):
    """A folder with all below it, or (``deep`` false) its own entries alone."""

    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))
        self.folder, self.deep = folder, deep


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, splits: int):
        self.root, self.splits = root, splits

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no folder {self.root!r}")
        shallow, whole = [], deque([self.root])
        while whole and len(whole) < self.splits and len(shallow) < 4 * self.splits:
            folder = whole.popleft()
            shallow.append(_Share(folder, False))
            whole.extend(_entries(folder)[1])
        return shallow + [_Share(folder, True) for folder in whole]

    def read(self, share: _Share) -> Iterator[tuple]:
        return _walk(share.folder) if share.deep else iter(_entries(share.folder)[0])


class TreeSource(DataSource):
    """``spark.read.format("findlake_tree").option("root", folder).load()``: ``path, is_dir, error``."""

    @classmethod
    def name(cls) -> str:
        return "findlake_tree"

    def schema(self) -> str:
        return TREE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["root"], int(self.options.get("splits", DEFAULT_SPLITS)))


def _tree(spark: SparkSession, root: str, splits: int) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format(TreeSource.name()).option("root", root).option("splits", splits).load()


def _arrival(path: Column) -> Column:
    """Arrival order is not defined by a parallel listing, so ``ordinal`` is derived from the path itself: the rank of
    the path in sorted order would need a global sort, while a 55-bit hash is stable and needs none. Two paths with
    one hash tie in arrival order; items are told apart by path."""
    return F.pmod(F.xxhash64(path), F.lit(2 ** 55))


def list_tree(spark: SparkSession, root: str, splits: int = DEFAULT_SPLITS) -> DataFrame:
    """``ordinal, path, is_dir`` for everything below the folder ``root``; a missing root is an error."""
    return (_tree(spark, root, splits).where(F.col("error").isNull())
            .select(_arrival(F.col("path")).alias("ordinal"), "path", "is_dir"))


def unreadable(spark: SparkSession, root: str, splits: int = DEFAULT_SPLITS) -> DataFrame:
    """``path, is_dir, error``: the folders below ``root`` that could not be opened and the entries without a kind."""
    return _tree(spark, root, splits).where(F.col("error").isNotNull())


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``ordinal, path, is_dir`` for the files below ``root`` that ``binaryFile`` finds (paths without ``file:``)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path"))
    clean = F.regexp_replace("path", "^file:", "")
    return files.select(_arrival(clean).alias("ordinal"), clean.alias("path"), F.lit(False).alias("is_dir"))
