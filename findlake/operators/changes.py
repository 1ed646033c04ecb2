"""Change sets as bulk table jobs: rename, undo, create; statuses instead of messages.

The reference changes one item at a time on a live disk. Here a batch of
requests is planned against one catalog snapshot, applied to produce a new
catalog, and undone by applying the inverse plan. Creations take effect one
after another; renames see the snapshot, and order decides between rivals.

Size rules: the catalog meets a batch's keys, broadcast within a bound in
bytes, before anything is joined, so a small batch never shuffles it. Rival
rows are resolved with ``min(change_id)`` aggregations in rounds, not windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions import paths as P
from findlake.functions import text as X
from findlake.operators.catalog import (CATALOG_COLUMNS, MAX_BROADCAST_KEY_BYTES, are_few, broadcast_within, matching,
                                       with_item_columns)
from findlake.session import staged

CREATE_STATUSES = ("created", "kept", "overwritten", "conflict", "missing", "invalid_name")
RENAME_STATUSES = ("unchanged", "invalid_name", "exists", "missing", "ok")


def _join_path(parent, name) -> Column:
    parent = F.col(parent) if isinstance(parent, str) else parent
    name = F.col(name) if isinstance(name, str) else name
    return P.normalise_path(F.concat(parent, F.lit("/"), name))


def _lookup(requests: DataFrame, catalog_side: DataFrame, key: str) -> DataFrame:
    """``requests LEFT JOIN catalog_side USING (key)``, without shuffling the catalog for a small batch.

    The catalog first meets the batch's distinct keys, broadcast when their
    bytes allow it (``catalog.matching``); only its few matches are joined to
    the requests. A larger batch is joined directly, each side shuffled once.
    ``catalog_side`` must be unique on ``key``.
    """
    if not are_few(requests, key):
        return requests.join(catalog_side, key, "left")
    keys = requests.select(key).where(F.col(key).isNotNull()).distinct()
    return requests.join(catalog_side.join(F.broadcast(keys), key), key, "left")


def _first_come(rows: DataFrame) -> DataFrame:
    """``change_id, tgt_key`` of the rows that succeed when rows (change_id, src_key, tgt_key) are carried out in order
    of ``change_id``, each unless its source or its target was used by an earlier success.

    Rows without a rival succeed at once: the keys that several rows name are
    counted, and only rows with such a key are looked at again. Among these, in each round every
    row that is first among the undecided of both its source and its target
    succeeds, and its rivals leave: the same outcome as one after another, in
    as many rounds as the longest chain of rivals.
    """
    named = rows.select("change_id", "src_key", "tgt_key")
    rows = named.where(F.col("src_key").isNotNull() & F.col("tgt_key").isNotNull())

    def several(key: str) -> DataFrame:
        found = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
        return broadcast_within(found.select(key, F.lit(True).alias(f"several_{key}")), "rival-keys")

    marked = rows.join(several("src_key"), "src_key", "left").join(several("tgt_key"), "tgt_key", "left")
    alone = F.col("several_src_key").isNull() & F.col("several_tgt_key").isNull()
    marked = staged(marked.select("change_id", "src_key", "tgt_key", alone.alias("alone")), "rivals")
    done = marked.where("alone").select("change_id")
    rivals = marked.where("not alone").select("change_id", "src_key", "tgt_key")
    left = rivals
    while left.limit(1).count():
        first_src = left.groupBy("src_key").agg(F.min("change_id").alias("first_src"))
        first_tgt = left.groupBy("tgt_key").agg(F.min("change_id").alias("first_tgt"))
        round_ = staged(left.join(first_src, "src_key").join(first_tgt, "tgt_key")
                        .withColumn("wins", (F.col("change_id") == F.col("first_src"))
                                    & (F.col("change_id") == F.col("first_tgt"))), "rivals")
        wins = round_.where("wins")
        done = done.unionByName(wins.select("change_id"))
        left = staged(round_.where("not wins").select("change_id", "src_key", "tgt_key")
                      .join(wins.select("src_key"), "src_key", "left_anti")
                      .join(wins.select("tgt_key"), "tgt_key", "left_anti"), "rivals")
    through = marked.where("alone").select("change_id", "tgt_key").where(F.col("change_id").isNotNull())
    return through.unionByName(rivals.join(done, "change_id", "left_semi").select("change_id", "tgt_key"))


def rename_plan(catalog: DataFrame, renames: DataFrame) -> DataFrame:
    """Check ``renames(change_id, path, new_name)`` against the catalog.

    First matching status: ``unchanged`` (same name, exact case),
    ``invalid_name`` (unsafe, or contains a separator: that would be a move),
    ``exists`` (target taken, ignoring case, in the snapshot or by an earlier
    ok row of the batch), ``missing`` (source absent, or already renamed by an
    earlier ok row), else ``ok``.
    Output: ``change_id, path, new_name, new_path, ordinal, is_dir, status``.
    """
    # Both keys follow from the request alone (the catalog's parent differs in case at most), so that one pass over
    # the catalog finds the items of all sources and targets.
    req = staged(renames.select(F.col("change_id").cast("bigint").alias("change_id"),
                                P.normalise_path("path").alias("path"), "new_name")
                 .withColumn("src_key", F.lower("path"))
                 .withColumn("tgt_key", F.lower(_join_path(P.parent_of("path"), "new_name"))), "rename-requests")
    asked = req.select(F.explode(F.array("src_key", "tgt_key")).alias("path_key"))
    found = staged(matching(catalog.select("path_key", "ordinal", "is_dir", "parent"), asked, "path_key"), "rename-items")
    items = found.select(F.col("path_key").alias("src_key"), "ordinal", "is_dir", F.col("parent").alias("item_parent"))
    taken = found.select(F.col("path_key").alias("tgt_key"), F.lit(True).alias("_taken"))
    req = (req.join(items, "src_key", "left").join(taken, "tgt_key", "left")
           .withColumn("new_path", _join_path(F.coalesce("item_parent", P.parent_of("path")), "new_name")))
    bad_name = (~X.is_safe_name("new_name")) | F.col("new_name").rlike(r"[/\\]")
    status = (F.when(F.col("new_name") == P.name_of("path"), F.lit("unchanged"))
              .when(bad_name, F.lit("invalid_name"))
              .when(F.col("_taken").isNotNull(), F.lit("exists"))
              .when(F.col("ordinal").isNull(), F.lit("missing"))
              .otherwise(F.lit("pending")))
    # One row per request; several branches below read it.
    planned = staged(req.withColumn("status", status), "rename-plan")
    pending = planned.where(F.col("status") == "pending")
    ok = staged(_first_come(pending), "renamed")
    claimed = ok.select("tgt_key", F.col("change_id").alias("_by"))
    final = (F.when(F.col("_by") == F.col("change_id"), F.lit("ok"))
             .when(F.col("_by") < F.col("change_id"), F.lit("exists")).otherwise(F.lit("missing")))
    # A row without a source also finds its target taken by an earlier row first.
    open_ = F.col("status").isin("pending", "missing")
    decided = planned.where(open_).join(claimed, "tgt_key", "left").withColumn("status", final)
    columns = ["change_id", "path", "new_name", "new_path", "ordinal", "is_dir", "status"]
    return planned.where(~open_).select(*columns).unionByName(decided.select(*columns))


def target_exists(catalog: DataFrame, renames: DataFrame) -> DataFrame:
    """Rename requests whose target path is already taken (case-insensitive)."""
    req = renames.withColumn("tgt_key", F.lower(_join_path(P.parent_of(P.normalise_path("path")), "new_name")))
    keys = catalog.select(F.col("path_key").alias("tgt_key"))
    # A batch beyond the bound meets the catalog once, in the semi-join itself.
    taken = keys
    if are_few(req, "tgt_key"):
        taken = keys.join(F.broadcast(req.select("tgt_key").where(F.col("tgt_key").isNotNull()).distinct()), "tgt_key")
    return req.join(taken, "tgt_key", "left_semi").drop("tgt_key")


def apply_renames(catalog: DataFrame, plan: DataFrame) -> DataFrame:
    """New catalog after the ``ok`` rows of a rename plan; items below a renamed folder move too.

    1. reduce the catalog to its distinct parent folders (map side first), explode
       only those into their ancestor-or-self keys and inner-join the ok renames:
       a hot folder is one row, not one per item below it;
    2. gather ``part position -> new name`` per affected folder (small groups:
       bounded by path depth);
    3. an item meets its folder's map and its own rename, rewrites its parts with
       ``transform`` and re-derives the item columns. Nested renames in one batch
       compose naturally, because every part is matched by its *old* ancestor key.

    The catalog is read twice, the first time for the parents alone.
    """
    ok = staged(plan.where(F.col("status") == "ok")
                .select(F.lower("path").alias("anc_key"), F.col("new_name").alias("new_part")), "renames")
    parts = F.split("path", "/")
    above = F.lower(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    folders = catalog.select(above.alias("folder_key")).where(F.col("folder_key") != "").distinct()
    keys = F.split("folder_key", "/")
    anc = (folders.select("folder_key", F.posexplode(keys).alias("pos", "part"), keys.alias("keys"))
           .select("folder_key", "pos", F.array_join(F.slice("keys", 1, F.col("pos") + 1), "/").alias("anc_key")))
    inside = staged(matching(anc, ok, "anc_key").join(ok, "anc_key", "inner").groupBy("folder_key")
                    .agg(F.map_from_entries(F.collect_list(F.struct("pos", "new_part"))).alias("renamed")), "moved")
    # An item's own rename; a second one of the same item is refused as for folders (a map has no key twice).
    own = ok.groupBy("anc_key").agg(F.collect_list(F.struct("new_part")).alias("names"))
    own = own.select(F.col("anc_key").alias("path_key"), "names")
    # Affected folders and renames are few unless the batch is large: within the bound they are broadcast, and the
    # catalog is not shuffled.
    size_of = lambda df, size: df.agg(F.sum(size)).first()[0] or 0
    small = lambda df, size: F.broadcast(df) if size <= MAX_BROADCAST_KEY_BYTES else df
    cat = (catalog.withColumn("folder_key", above)
           .join(small(inside, size_of(inside, F.octet_length("folder_key") + 300 * F.size("renamed"))), "folder_key", "left")
           .join(small(own, size_of(ok, F.octet_length("anc_key") + 300)), "path_key", "left"))
    mine = F.element_at(F.map_from_entries(F.transform("names", lambda n: F.struct(F.lit(1), n["new_part"]))), 1)
    new_parts = F.transform(parts, lambda p, i: F.coalesce(
        F.when(i == F.size(parts) - 1, F.col("mine")).otherwise(F.element_at(F.col("renamed"), i)), p))
    moved = (cat.withColumn("mine", F.when(F.col("names").isNotNull(), mine))
             .withColumn("path", F.when(F.col("renamed").isNull() & F.col("names").isNull(), F.col("path"))
                         .otherwise(F.array_join(new_parts, "/"))))
    extra = [c for c in catalog.columns if c not in CATALOG_COLUMNS and c not in ("tokens", "parent_key")]
    rebuilt = with_item_columns(moved.select("ordinal", "path", "is_dir", *extra))
    if "tokens" in catalog.columns:
        rebuilt = rebuilt.withColumn("tokens", X.tokenise_name("name_lc"))
    if "parent_key" in catalog.columns:
        rebuilt = rebuilt.withColumn("parent_key", F.lower("parent"))
    return rebuilt.select(*catalog.columns)


def undo_renames(new_catalog: DataFrame, plan: DataFrame) -> DataFrame:
    """Reverse an applied plan: rename each moved item back to its old name.

    The inverse request names the item by its *new full* path, which the plan
    itself gives when it is applied to its own paths; so nested renames undo
    in one batch, and the catalog is not searched.
    """
    ok = staged(plan.where(F.col("status") == "ok").select("change_id", "path", "new_name", "status"), "undo")
    own = with_item_columns(ok.select(F.col("change_id").alias("ordinal"), "path", F.lit(True).alias("is_dir")))
    inverse = apply_renames(own, ok).select(F.col("ordinal").alias("change_id"), "path").join(
        ok.select("change_id", P.name_of("path").alias("new_name"), "status"), "change_id")
    # Read twice below: the joins that made it are not run again.
    return apply_renames(staged(new_catalog, "renamed-catalog"), inverse)


# ---------------------------------------------------------------------------
# Creation plans.
# ---------------------------------------------------------------------------

def _plan_name_reason(name) -> Column:
    """Reference validity plus: no '.' or '..' part and no leading separator."""
    name = F.col(name) if isinstance(name, str) else name
    parts = F.split(F.regexp_replace(name, r"\\", "/"), "/")
    dotted = F.exists(parts, lambda p: (p == ".") | (p == ".."))
    return (F.when(X.unsafe_name_reason(name).isNotNull(), X.unsafe_name_reason(name))
            .when(name.rlike(r"^[/\\]"), F.lit("absolute"))
            .when(dotted, F.lit("dot_part")))


def _ids(manifest: DataFrame) -> list[str]:
    """What tells manifest rows apart: ``change_id``, and ``pos`` in flattened nested manifests."""
    return [c for c in ("change_id", "pos") if c in manifest.columns]


def _ancestor_rows(targets: DataFrame, *columns: str) -> DataFrame:
    """``columns, depth, tdepth, anc_path, anc_key`` for every ancestor (>= 2 parts) of ``target`` (of ``tdepth`` parts)."""
    parts = F.split("target", "/")
    return (targets.select(*columns, parts.alias("parts")).where(F.size("parts") > 2)
            .select(*columns, "parts", F.size("parts").alias("tdepth"),
                    F.explode(F.sequence(F.lit(2), F.greatest(F.size("parts") - 1, F.lit(2)))).alias("depth"))
            .select(*columns, "depth", "tdepth",
                    F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("anc_path"))
            .withColumn("anc_key", F.lower("anc_path")))


def _steps(catalog: DataFrame, targets: DataFrame, ids: list[str]) -> DataFrame:
    """The paths on the way of each request: its target, and the ancestors that may not be folders yet.

    An ancestor that is a folder already decides nothing. Most are: the
    catalog's folders are measured, and while they may be broadcast, the ancestors among them leave
    before anything is shuffled; beyond that the lookup finds them.
    """
    columns = [*ids, "kind", "make_parents"]
    named = targets
    for c in ids:  # a request without its id cannot be told apart
        named = named.where(F.col(c).isNotNull())
    own = F.size(F.split("target", "/"))
    itself = named.select(*columns, own.alias("depth"), own.alias("tdepth"), F.col("target").alias("anc_path"),
                          F.lower("target").alias("anc_key"))
    above = _ancestor_rows(named, *columns)
    folders = catalog.where("is_dir").select(F.col("path_key").alias("anc_key"))
    size = folders.agg(F.sum(F.octet_length("anc_key") + 16)).first()[0] or 0
    if size <= MAX_BROADCAST_KEY_BYTES:
        above = above.join(F.broadcast(folders), "anc_key", "left_anti")
    return itself.unionByName(above)


def _requested(manifest: DataFrame) -> DataFrame:
    """Manifest rows with ``target``, ``content``, ``make_parents`` and the ``reason`` they are refused at once."""
    parents = F.coalesce("make_parents", F.lit(True)) if "make_parents" in manifest.columns else F.lit(True)
    is_file = F.col("kind") == "file"
    return (manifest.where(F.col("kind").isin("file", "folder"))
            .withColumn("change_id", F.col("change_id").cast("bigint"))
            .withColumn("make_parents", parents | ~is_file)
            .select(*_ids(manifest), "kind", _join_path("location", "name").alias("target"),
                    (F.col("content") if "content" in manifest.columns else F.lit(None)).cast("string").alias("content"),
                    "make_parents", _plan_name_reason("name").alias("reason"))
            .withColumn("reason", F.when(F.coalesce(F.size(F.split("target", "/")), F.lit(0)) < 2, F.lit("no_location"))
                        .otherwise(F.col("reason"))))


def _first_claims(rows: DataFrame, prefix: str) -> DataFrame:
    """Per key the first of ``rows`` (``anc_key, as_dir, o``) that wants it as a folder, and as a file."""
    return rows.groupBy("anc_key").agg(F.min(F.when(F.col("as_dir"), F.col("o"))).alias(f"{prefix}_dir"),
                                       F.min(F.when(~F.col("as_dir"), F.col("o"))).alias(f"{prefix}_file"))


def _in_order(claims: DataFrame, ids: list[str]) -> DataFrame:
    """``ids, outcome`` (``ok``, ``conflict``, ``missing``) of requests carried out one after another.

    A path becomes a folder or a file by the first request that gets through,
    and stays that. ``claims`` has a row per request and path on its way:
    ``as_dir`` is what the request wants there, ``makes`` whether it would make
    it, ``needed`` whether it must be a folder already, ``exists_dir`` what the
    catalog has. Requests whose paths nobody wants otherwise get through at
    once; among the rest, each round settles those before which no open
    request wants one of their paths otherwise, or could make the folder that they need.
    """
    o = F.struct(*ids)
    blocked = F.max(F.coalesce(F.col("exists_dir") != F.col("as_dir"), F.lit(False)))
    base = claims.groupBy(*ids).agg(blocked.alias("blocked"))
    open_rows = staged(claims.join(base.where(~F.col("blocked")).select(*ids), ids)
                       .where(F.col("exists_dir").isNull()).select(*ids, "anc_key", "as_dir", "makes", "needed")
                       .withColumn("o", o), "creation-claims")
    made = open_rows.where("makes").groupBy("anc_key").agg(F.max("as_dir").alias("dirs"), F.min("as_dir").alias("all_dirs"))
    # Paths wanted in two ways, by makers or by somebody who relies on them, and folders that must be there first.
    kinds = (open_rows.groupBy("anc_key").agg(F.max("as_dir").alias("any_dir"), F.min("as_dir").alias("only_dir"),
                                              F.max("needed").alias("any_needed"))
             .where((F.col("any_dir") != F.col("only_dir")) | F.col("any_needed")).select("anc_key"))
    contested = kinds.join(made.select("anc_key"), "anc_key", "left_semi")
    lacking = open_rows.where("needed").join(contested, "anc_key", "left_anti").select(*ids).distinct()
    waiting = staged(open_rows.join(contested, "anc_key", "left_semi"), "creation-open")
    undecided = waiting.select(*ids).distinct()
    outcomes = [base.select(*ids, F.when(F.col("blocked"), F.lit("conflict")).otherwise(F.lit("ok")).alias("outcome"))
                .join(undecided, ids, "left_anti").join(lacking, ids, "left_anti"),
                lacking.join(undecided, ids, "left_anti").withColumn("outcome", F.lit("missing"))]
    lacking = staged(lacking, "creation-lacking")
    # Requests on contested paths alone are settled in rounds, so nothing has got through on those paths before.
    settled = staged(_first_claims(waiting.limit(0), "ok"), "creation-settled")
    while waiting.limit(1).count():
        firsts = _first_claims(waiting.where("makes"), "open").join(settled, "anc_key", "full")
        other = lambda p: F.when(F.col("as_dir"), F.col(f"{p}_file")).otherwise(F.col(f"{p}_dir"))
        earlier = lambda c: F.coalesce(c < F.col("o"), F.lit(False))
        lacks = F.col("needed") & ~earlier(F.col("ok_dir"))
        seen = (waiting.join(firsts, "anc_key", "left").groupBy(*ids)
                .agg(F.max(earlier(other("ok"))).alias("refused"),
                     F.max(earlier(other("open")) | (lacks & earlier(F.col("open_dir")))).alias("waits"),
                     F.max(lacks).alias("lacks"))
                .join(lacking.withColumn("lost", F.lit(True)), ids, "left"))
        verdict = (F.when(F.col("refused"), F.lit("conflict")).when(F.col("waits"), F.lit(None))
                   .when(F.col("lacks") | F.col("lost"), F.lit("missing")).otherwise(F.lit("ok")))
        decided = staged(seen.select(*ids, verdict.alias("outcome")).where(F.col("outcome").isNotNull()), "creation-round")
        outcomes.append(decided)
        through = waiting.where("makes").join(decided.where(F.col("outcome") == "ok").select(*ids), ids, "left_semi")
        both = _first_claims(through, "ok").unionByName(settled)
        settled = staged(both.groupBy("anc_key").agg(F.min("ok_dir").alias("ok_dir"), F.min("ok_file").alias("ok_file")),
                         "creation-settled")
        waiting = staged(waiting.join(decided.select(*ids), ids, "left_anti"), "creation-open")
    result = outcomes[0]
    for part in outcomes[1:]:
        result = result.unionByName(part)
    return result


def _creations(catalog: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows of a creation plan, stored: ``ids, path, kind, role, content, status``.

    Requests take effect one after another, in the order of ``change_id`` (and
    ``pos``): a folder or file that an earlier one makes is there for the
    later ones.
    """
    ids = _ids(manifest)
    o = F.struct(*ids)
    req = staged(_requested(manifest), "creation-requests")
    valid = req.where(F.col("reason").isNull())
    existing = catalog.select(F.col("path_key").alias("anc_key"), F.col("is_dir").alias("exists_dir"))
    steps = staged(_steps(catalog, valid, ids), "creation-steps")
    claims = staged(_lookup(steps, existing, "anc_key")
                    .withColumn("is_target", F.col("depth") == F.col("tdepth"))
                    .where(F.col("is_target") | F.col("exists_dir").isNull() | ~F.col("exists_dir"))
                    .withColumn("as_dir", ~F.col("is_target") | (F.col("kind") == "folder"))
                    .withColumn("makes", F.col("is_target") | F.col("make_parents"))
                    .withColumn("needed", (F.col("depth") == F.col("tdepth") - 1) & ~F.col("make_parents")), "creation-claims")
    outcome = staged(_in_order(claims, ids), "creation-outcomes")
    ok_rows = claims.join(outcome.where(F.col("outcome") == "ok").select(*ids), ids, "left_semi")
    # A new path is made by the first request that gets through to it.
    first = ok_rows.where(F.col("makes") & F.col("exists_dir").isNull()).groupBy("anc_key").agg(F.min(o).alias("first"))
    marked = (claims.where(F.col("is_target") | (F.col("makes") & F.col("exists_dir").isNull()))
              .join(outcome, ids).join(first, "anc_key", "left")
              .withColumn("new", F.col("exists_dir").isNull() & (F.col("first") == o)))
    status = (F.when(F.col("outcome") != "ok", F.col("outcome"))
              .when(F.col("new"), F.lit("created"))
              .when(F.col("kind") == "folder", F.lit("kept")).otherwise(F.lit("overwritten")))
    made = (marked.where(F.col("is_target") | ((F.col("outcome") == "ok") & F.col("new")))
            .select(*ids, F.col("anc_path").alias("path"), "kind",
                    F.when(F.col("is_target"), F.lit("target")).otherwise(F.lit("ancestor")).alias("role"),
                    status.alias("status")))
    content = valid.where(F.col("kind") == "file").select(*ids, F.coalesce("content", F.lit("")).alias("content"))
    planned = made.join(content, ids, "left")
    refused = req.where(F.col("reason").isNotNull()).select(
        *ids, F.col("target").alias("path"), "kind", F.lit("target").alias("role"), F.lit("invalid_name").alias("status"),
        F.when(F.col("kind") == "file", F.coalesce("content", F.lit(""))).alias("content"))
    return staged(planned.unionByName(refused), "creation-plan")


def _folder_rows(plan: DataFrame, ids: list[str]) -> DataFrame:
    return plan.where(F.col("kind") == "folder").select(*ids, "path", "role", "status")


def _file_rows(plan: DataFrame, ids: list[str]) -> DataFrame:
    return plan.where((F.col("kind") == "file") & (F.col("role") == "target")).select(*ids, "path", "content", "status")


def create_folders(catalog: DataFrame, manifest: DataFrame) -> DataFrame:
    """The folder rows of a creation plan: ``change_id, path, role, status``.

    Each ``kind = 'folder'`` row yields its target (role ``target``) and every
    ancestor that it makes (role ``ancestor``, made as with ``parents=True``).
    A folder that is there is fine (``kept``); a *file* at the target or at any
    ancestor is a ``conflict``. What earlier rows of the manifest made, files
    included, is there.
    """
    return _folder_rows(_creations(catalog, manifest), _ids(manifest))


def create_files(catalog: DataFrame, manifest: DataFrame) -> DataFrame:
    """The file rows of a creation plan: ``change_id, path, content, status``.

    ``created`` (new), ``overwritten`` (a file that is there is replaced, as the
    reference does), ``conflict`` (a folder at the target, or a file at an
    ancestor), ``missing`` (parent absent and ``make_parents`` false - files
    added to an existing folder), ``invalid_name``. What earlier rows of the
    manifest made, folders included, is there.
    """
    return _file_rows(_creations(catalog, manifest), _ids(manifest))


def flatten_nested_manifest(nested: DataFrame) -> DataFrame:
    """Nested manifest -> flat manifest rows (folder, its files, subfolders, their files).

    ``nested(change_id, location, folder, files ARRAY<STRUCT<name, content>>,
    subfolders ARRAY<STRUCT<name, files ARRAY<STRUCT<name, content>>>>)``.
    Generated rows keep ``change_id``; ``pos`` (an array of places) tells them
    apart and keeps the manifest's order: [] the folder, [0, i] its files,
    [1 + j] a subfolder, [1 + j, i] that one's files.
    """
    base = nested.select(F.col("change_id").cast("bigint").alias("change_id"), "location", "folder", "files",
                         "subfolders")
    inner = _join_path("location", "folder")
    place = lambda *xs: F.array(*xs).cast("array<int>").alias("pos")
    row = lambda pos, location, name, kind, content: [
        "change_id", pos, location.alias("location"), name.alias("name"), F.lit(kind).alias("kind"),
        content.cast("string").alias("content"), F.lit(kind == "folder").alias("make_parents")]
    nothing = F.lit(None)
    folder = base.select(*row(place(), F.col("location"), F.col("folder"), "folder", nothing))
    top_files = base.select("*", F.posexplode("files").alias("i", "f")).select(
        *row(place(F.lit(0), F.col("i")), inner, F.col("f.name"), "file", F.col("f.content")))
    subs = base.select("*", F.posexplode("subfolders").alias("j", "s"))
    sub_rows = subs.select(*row(place(F.col("j") + 1), inner, F.col("s.name"), "folder", nothing))
    sub_files = subs.select("*", F.posexplode("s.files").alias("i", "f")).select(
        *row(place(F.col("j") + 1, F.col("i")), _join_path(inner, F.col("s.name")), F.col("f.name"), "file",
             F.col("f.content")))
    return folder.unionByName(top_files).unionByName(sub_rows).unionByName(sub_files)


def create_folder_with_files(catalog: DataFrame, nested: DataFrame) -> DataFrame:
    """Plan a folder with files and subfolders: ``change_id, path, kind, status``.

    Folders come before the files inside them in the manifest's order, so
    those files are not ``missing``.
    """
    plan = _creations(catalog, flatten_nested_manifest(nested))
    return (plan.where((F.col("kind") == "folder") | (F.col("role") == "target"))
            .select("change_id", "path", "kind", "status"))


def resolve_location(requests: DataFrame, locations: DataFrame) -> DataFrame:
    """Named location (label) -> path; unknown labels fall back to the request's custom path.

    ``locations(label, path)`` is a handful of rows; it is an equi-join, so
    the planner broadcasts it from its size (and never has to).
    """
    locs = locations.select(F.lower("label").alias("_label"), F.col("path").alias("_loc_path"))
    return (requests.join(locs, F.lower(requests["label"]) == F.col("_label"), "left")
            .withColumn("location", P.normalise_path(F.coalesce("_loc_path", "custom")))
            .drop("_label", "_loc_path"))


def status_summary(plan: DataFrame) -> DataFrame:
    """``status, n``: outcome counts of a plan."""
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def quarantine(plan: DataFrame, ok_statuses=("ok", "created", "kept", "overwritten")) -> DataFrame:
    """Failed rows, set aside with their status as the reason."""
    return plan.where(~F.col("status").isin(*ok_statuses))


def created_counts(file_plan: DataFrame) -> DataFrame:
    """Files made per folder: ``folder, created``."""
    return (file_plan.withColumn("folder", P.parent_of("path"))
            .groupBy("folder")
            .agg(F.count_if(F.col("status").isin("created", "overwritten")).cast("bigint").alias("created")))
