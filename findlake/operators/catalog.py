"""Catalog construction: listing -> items with derived columns, one row per path.

Scale notes
-----------
* Folder expansion and duplicate removal are *aggregations* (``groupBy`` with
  ``min``), not windows: partial aggregation combines rows map-side, so a hot
  folder such as ``C:/Users`` (an ancestor of a third of all rows) or a path
  copied millions of times never lands in one task as raw rows.
* Skipping system folders is a row filter and runs before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions import paths as P
from findlake.functions import text as X
from findlake.operators.numbering import sequential_number
from findlake.session import staged

CATALOG_COLUMNS = ["ordinal", "path", "path_key", "name", "name_lc", "parent", "parent_name",
                   "suffix", "is_dir", "drive"]


# Ordinals of a catalog leave this many places per listed row: a file takes the last, the folders above it the places
# of their depths. Deeper trees use a larger power of ten (``stride_for``).
ORDINAL_STRIDE = 100
# The place of a listed row among the folders that its path implies: after all of them.
LISTED_DEPTH = 2 ** 31 - 1

_FAULTS = ("null_ordinal", "null_path", "blank_path", "unparsable_path", "relative_path", "no_name")


def _path(normalised: bool) -> Column:
    return F.col("path") if normalised else P.normalise_path("path")


def normalised_paths(listing: DataFrame) -> DataFrame:
    """``ordinal, path, is_dir`` with normalised paths, stored: the steps that follow read them instead of cutting each
    path anew. They take them as ``normalised``."""
    return staged(listing.select("ordinal", P.normalise_path("path").alias("path"), "is_dir"), "listing")


def listing_fault(normalised: bool = False) -> Column:
    """Why a listing row cannot become an item (one of ``_FAULTS``), or null for a sound row.

    The first part of a path is its drive or walk root; a path without one, or
    with a '.' or '..' part, is relative to something that the listing does not say.
    """
    path = _path(normalised)
    return (F.when(F.col("ordinal").isNull(), F.lit("null_ordinal"))
            .when(F.col("path").isNull(), F.lit("null_path"))
            .when(F.trim("path") == "", F.lit("blank_path"))
            .when(F.instr("path", "\0") > 0, F.lit("unparsable_path"))
            .when(~path.contains("/") | path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.lit("relative_path"))
            .when(P.name_of(path) == "", F.lit("no_name")))


def sound_listing(listing: DataFrame, normalised: bool = False) -> DataFrame:
    """The listing rows that become items."""
    return listing.where(listing_fault(normalised).isNull())


def set_aside_listing(listing: DataFrame) -> DataFrame:
    """The other listing rows, with their ``reason``; both parts together are the listing."""
    return listing.withColumn("reason", listing_fault()).where(F.col("reason").isNotNull())


def stride_for(deepest: int) -> int:
    """A power of ten above the number of parts of the deepest path, 100 at least."""
    return max(ORDINAL_STRIDE, 10 ** len(str(deepest + 1)))


def listing_bounds(listing: DataFrame, normalised: bool = False) -> tuple[int, int, int]:
    """Parts of the deepest path, smallest and largest ordinal (one aggregation; zeros without rows)."""
    row = listing.agg(F.max(F.size(F.split(_path(normalised), "/"))),
                      F.min("ordinal").cast("bigint"), F.max("ordinal").cast("bigint")).first()
    return row[0] or 0, row[1] or 0, row[2] or 0


def fits(stride: int, low: int, high: int) -> bool:
    """Whether all ordinals between ``low`` and ``high`` times ``stride`` are 64-bit numbers."""
    return -2 ** 63 <= low * stride and (high + 1) * stride < 2 ** 63


def dense_ordinals(rows: DataFrame) -> DataFrame:
    """``rows`` with each ordinal replaced by its rank among the distinct ordinals, from 0 (same order, equal ones
    stay equal)."""
    ranks = sequential_number(rows.select("ordinal").distinct(), [], ["ordinal"], "_rank")
    return (rows.join(ranks, "ordinal").withColumn("ordinal", F.col("_rank") - 1).select(*rows.columns))


def spread_ordinals(items: DataFrame, stride: int, low: int, high: int) -> DataFrame:
    """``(ordinal, depth)`` joined into one ``ordinal`` of the same order; ``low`` and ``high`` bound the ordinals."""
    if not fits(stride, low, high):
        items = dense_ordinals(items)
    return items.withColumn("ordinal", F.col("ordinal") * stride + F.least(F.col("depth"), F.lit(stride - 1))).drop("depth")


def normalise_listing(listing: DataFrame, stride: int = ORDINAL_STRIDE, normalised: bool = False) -> DataFrame:
    """``ordinal, path, is_dir`` with '/'-only paths (see D3 in the survey).

    Ordinals are spread by ``stride``, which leaves room for the folders that
    the paths imply; ``build_catalog`` first makes sure that they fit 64 bits.
    Equal ordinals stay equal; ties are broken by path wherever order matters,
    and items are identified by path.
    """
    return listing.select((F.col("ordinal").cast("bigint") * stride + (stride - 1)).alias("ordinal"),
                          _path(normalised).alias("path"),
                          F.col("is_dir").cast("boolean").alias("is_dir"))


def implied_items(listing: DataFrame, normalised: bool = False) -> DataFrame:
    """``ordinal, depth, path, is_dir`` of sound listing rows and of the folders above them, before de-duplication.

    As ``normalise_listing`` and ``expand_ancestors``, with the ordinal of the
    listing and the depth kept apart, so no deepest path has to be known.
    """
    listed = listing.select(F.col("ordinal").cast("bigint").alias("ordinal"), F.lit(LISTED_DEPTH).alias("depth"),
                            _path(normalised).alias("path"), F.col("is_dir").cast("boolean").alias("is_dir"))
    folders = _folders_above(listed).select(F.col("min_ordinal").alias("ordinal"), "depth", "path",
                                            F.lit(True).alias("is_dir"))
    return listed.unionByName(folders)


def expand_ancestors(listing: DataFrame, stride: int = ORDINAL_STRIDE) -> DataFrame:
    """Add the folder rows implied by the paths of a listing.

    Folders are items too. For every path with parts ``p1/.../pn`` the folders
    ``p1/p2``, ..., ``p1/.../p(n-1)`` are emitted; ``p1`` (a drive or walk
    root) is never an item. A folder's ordinal is ``stride * key + depth``
    where ``key = min(ordinal below it) div stride`` and ``depth`` is its part
    count, so a parent sorts before its children and before its first file.
    Rows are first reduced to distinct parent folders and only those are
    exploded; both aggregations are partial (map-side), so a common folder
    costs one row per map partition in the shuffle, not one per item below it.
    """
    folders = _folders_above(listing).select(
        (F.col("min_ordinal") - F.pmod("min_ordinal", F.lit(stride)) + F.col("depth")).cast("bigint").alias("ordinal"),
        "path", F.lit(True).alias("is_dir"))
    return listing.select("ordinal", "path", "is_dir").unionByName(folders)


def _folders_above(listing: DataFrame) -> DataFrame:
    """``path, min_ordinal, depth`` of every folder above the paths of ``listing(ordinal, path)``."""
    parts = F.split("path", "/")
    # Collapse rows to their distinct parent folders first (partial aggregation
    # map-side), so only distinct folders - not every file - are exploded.
    parents = (listing.select("ordinal", parts.alias("parts"))
               .where(F.size("parts") > 2)
               .select("ordinal", F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/").alias("parent"))
               .groupBy("parent").agg(F.min("ordinal").alias("ordinal")))
    ancestors = (parents.select("ordinal", F.split("parent", "/").alias("parts"))
                 .select("ordinal", "parts", F.explode(F.sequence(F.lit(2), F.size("parts"))).alias("depth"))
                 .select("ordinal", "depth",
                         F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("path")))
    return ancestors.groupBy("path").agg(F.min("ordinal").alias("min_ordinal"), F.min("depth").alias("depth"))


def with_item_columns(items: DataFrame) -> DataFrame:
    """Derive ``path_key, name, name_lc, parent, parent_name, suffix, drive``."""
    name = P.name_of("path")
    parent = P.parent_of("path")
    return (items
            .withColumn("path_key", X.case_fold("path"))
            .withColumn("name", name)
            .withColumn("name_lc", X.case_fold("name"))
            .withColumn("parent", parent)
            .withColumn("parent_name", P.parent_name_of_path("path"))
            .withColumn("suffix", P.suffix_of("name"))
            .withColumn("drive", P.drive_of("path"))
            .select(*CATALOG_COLUMNS, *[c for c in items.columns if c not in CATALOG_COLUMNS]))


def skip_system_dirs(items: DataFrame, parent_col: str = "parent") -> DataFrame:
    """Drop items whose lower-cased parent path contains a system-folder substring."""
    return items.where(~P.in_system_dir(parent_col))


def dedup_first_wins(items: DataFrame, key: str = "path_key",
                     order: tuple[str, ...] = ("ordinal", "path")) -> DataFrame:
    """One row per ``key``; the row with the smallest ``order`` wins.

    ``min(struct(order..., rest...))`` is an aggregate, so duplicates collapse
    map-side before the shuffle (``dropDuplicates`` would keep an arbitrary
    row, a window would move every copy of a hot key into one task).
    """
    rest = [c for c in items.columns if c != key and c not in order]
    winner = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])).alias("w")
    return (items.groupBy(key).agg(winner)
            .select(F.col(key), *[F.col("w." + c).alias(c) for c in (*order, *rest)])
            .select(*items.columns))


def build_catalog(listing: DataFrame, stride: int | None = None) -> DataFrame:
    """Listing -> catalog: normalise, add folders, skip, de-duplicate, derive columns.

    Rows that cannot become items are left out (``set_aside_listing`` returns
    them). Only ``ordinal, path, is_dir`` travel through the de-duplication
    shuffle; the derived columns are computed once, for the surviving rows.
    Without a ``stride`` the deepest path and the range of ordinals are looked
    up first; ordinals too large to be spread are replaced by their ranks.
    """
    listing = sound_listing(normalised_paths(listing), normalised=True)
    if not stride:
        deepest, low, high = listing_bounds(listing, normalised=True)
        stride = stride_for(deepest)
        if not fits(stride, low, high):
            listing = dense_ordinals(listing)
    items = expand_ancestors(normalise_listing(listing, stride, normalised=True), stride)
    kept = items.where(~P.under_system_dir("path")).withColumn("path_key", X.case_fold("path"))
    return with_item_columns(dedup_first_wins(kept).select("ordinal", "path", "is_dir")).select(*CATALOG_COLUMNS)


def with_tokens(catalog: DataFrame) -> DataFrame:
    """Add the indexed words of each name as ``tokens ARRAY<STRING>``, and the lower-cased parent as ``parent_key``."""
    return catalog.withColumn("tokens", X.tokenise_name("name_lc")).withColumn("parent_key", F.lower("parent"))


def already_indexed(new_items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of ``new_items`` whose lower-cased path is not in the catalog yet."""
    keys = catalog.select("path_key")
    return new_items.join(keys, "path_key", "left_anti")


def scope_to_roots(catalog: DataFrame, roots: DataFrame) -> DataFrame:
    """Items strictly below each root; an item below two roots appears twice.

    An equi-join: each item's proper ancestor keys (as many as its path has
    parts) meet ``roots(root, root_key)``; only matching items keep their row.
    The planner broadcasts the roots when they are small. The root itself is
    not an item of its own walk.
    """
    r = roots.select("root", F.regexp_replace(F.lower("root_key"), "/+$", "").alias("root_prefix"))
    parts = F.split("path_key", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                        lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))
    anc = catalog.where(F.size(parts) > 1).withColumn("root_prefix", F.explode(above))
    return anc.join(r, "root_prefix", "inner").drop("root_prefix")


def available_drives(catalog: DataFrame) -> DataFrame:
    """Drive letters C..Z present in the catalog, with their root paths (reads the ``drive`` column alone)."""
    return (catalog.where(F.col("drive").between("C", "Z")).select(F.col("drive").alias("letter")).distinct()
            .select("letter", P.drive_path("letter").alias("root")))


def valid_roots(roots: DataFrame, catalog: DataFrame) -> DataFrame:
    """Roots that name an existing folder (or the root of a drive present in the catalog)."""
    r = roots.withColumn("root_norm", F.when(F.lower("root_key").rlike("^[a-z]:/?$"),
                                             F.concat(F.substring(F.lower("root_key"), 1, 2), F.lit("/")))
                         .otherwise(F.regexp_replace(F.lower("root_key"), "/+$", "")))
    folders = matching(catalog.where("is_dir").select(F.col("path_key").alias("root_norm")), r, "root_norm")
    drives = available_drives(catalog).select(F.lower("root").alias("root_norm"))
    return r.join(folders.unionByName(drives), "root_norm", "left_semi").drop("root_norm")


def indexed_items(catalog: DataFrame, roots: DataFrame) -> DataFrame:
    """The items that a search index holds: those strictly below at least one root that exists."""
    # An item is below a root if its folder is that root or below it: only distinct folders are exploded and joined.
    parts = F.split("path_key", "/")
    folder = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "/"))
    folders = catalog.select(folder.alias("folder_key")).where(F.col("folder_key").isNotNull()).distinct()
    keys = F.split("folder_key", "/")
    own = F.transform(F.sequence(F.lit(1), F.size(keys)), lambda d: F.array_join(F.slice(keys, F.lit(1), d), "/"))
    prefixes = valid_roots(roots, catalog).select(F.regexp_replace(F.lower("root_key"), "/+$", "").alias("root_prefix"))
    inside = (folders.withColumn("root_prefix", F.explode(own)).join(prefixes, "root_prefix", "left_semi")
              .select("folder_key").distinct())
    return (catalog.withColumn("folder_key", folder)
            .join(broadcast_within(inside, "indexed-folders"), "folder_key", "left_semi").select(*catalog.columns))


# Most bytes of distinct keys that are broadcast against the catalog.
MAX_BROADCAST_KEY_BYTES = 32 << 20


def broadcast_within(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, stored once, and broadcast while the bytes of their columns are within the bound."""
    kept = staged(rows, name)
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in kept.columns), F.lit(8))
    size = kept.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(kept) if size <= MAX_BROADCAST_KEY_BYTES else kept


def are_few(requests: DataFrame, key: str) -> bool:
    """Whether the distinct, non-null keys of ``requests`` may be broadcast.

    They are counted exactly (which shuffles them) only where a sketch does not
    put them far beyond the bound: a batch as large as the catalog is not shuffled for its size alone.
    """
    keys = requests.select(key).where(F.col(key).isNotNull())
    width = F.octet_length(key) + 16
    size, n, distinct = keys.agg(F.sum(width), F.count(F.lit(1)), F.approx_count_distinct(key)).first()
    if not n or size <= MAX_BROADCAST_KEY_BYTES:
        return True
    if size * distinct > 2 * MAX_BROADCAST_KEY_BYTES * n:
        return False
    return keys.distinct().agg(F.sum(width)).first()[0] <= MAX_BROADCAST_KEY_BYTES


def matching(catalog_side: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """The rows of ``catalog_side`` whose ``key`` occurs in ``requests``; at most one per distinct key if it is unique.

    The distinct request keys are measured in bytes. Within the bound they are
    broadcast and the catalog streams past them unshuffled; beyond it both
    sides are shuffled.
    """
    keys = requests.select(key).where(F.col(key).isNotNull()).distinct()
    return catalog_side.join(F.broadcast(keys) if are_few(requests, key) else keys, key, "inner")
