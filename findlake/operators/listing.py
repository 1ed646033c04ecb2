"""Folder listing: direct children of a folder, with filters and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions import paths as P
from findlake.operators.numbering import sequential_number

CONTENT_TYPES = ("folders", "files", "everything")


def location_key(location: Column) -> Column:
    """The ``parent_key`` of a location's children: '/'-only, lower case, 'c:' and 'c:/' alike."""
    loc = F.lower(F.regexp_replace(location, r"\\", "/"))
    return (F.when(loc.rlike("^[a-z]:/*$"), F.concat(F.substring(loc, 1, 2), F.lit("/")))
            .when(loc.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(loc, "/+$", "")))


def _with_parent_key(catalog: DataFrame) -> DataFrame:
    return catalog if "parent_key" in catalog.columns else catalog.withColumn("parent_key", F.lower("parent"))


def list_directory(catalog: DataFrame, location: str) -> DataFrame:
    """Direct children (not recursive) of ``location``, matched case-insensitively.

    A filter on the stored ``parent_key`` column, pushed to the scan: no
    shuffle, and only the partitions of the location's drive are read.
    """
    drive = location[0].upper() if len(location) > 1 and location[1] == ":" else None
    children = _with_parent_key(catalog).where(F.col("parent_key") == location_key(F.lit(location)))
    return children.where(F.col("drive") == drive) if drive else children


def hide_dotfiles(items: DataFrame) -> DataFrame:
    """Drop names starting with '.' (listing only; search keeps them)."""
    return items.where(~F.col("name").startswith("."))


def content_type_filter(items: DataFrame, content: str = "everything") -> DataFrame:
    """``folders`` only, ``files`` only, or ``everything``."""
    if content == "folders":
        return items.where("is_dir")
    if content == "files":
        return items.where(~F.col("is_dir"))
    if content == "everything":
        return items
    raise ValueError(f"content must be one of {CONTENT_TYPES}")


def number_listing(items: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """``row_no`` by name then ordinal (restarting per group), and the type label.

    Numbering is exact and distributed (``sequential_number``), so one huge
    folder is split across tasks instead of being windowed in one.
    """
    numbered = sequential_number(items, list(group_cols or []), ["name", "ordinal"])
    return numbered.withColumn("item_label", P.item_label("is_dir"))


def folder_listing(catalog: DataFrame, locations: DataFrame, content: str = "everything") -> DataFrame:
    """List many folders in one job: ``location, row_no, name, item_label, path``.

    ``locations(location)`` is joined on the lower-cased parent (an equi-join;
    the planner broadcasts it when small), then each folder's children are
    numbered by name. Children of one folder are one directory's entries.
    """
    locs = locations.select("location", location_key(F.col("location")).alias("parent_key"))
    children = _with_parent_key(catalog).join(locs, "parent_key", "inner")
    shown = content_type_filter(hide_dotfiles(children), content)
    return (number_listing(shown, ["location"])
            .select("location", "row_no", "name", "item_label", "path"))
