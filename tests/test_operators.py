"""Every registered query against its DuckDB oracle, plus change-set and stream properties."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from compare import compare, duck
from conftest import SF_SMALL, catalog_from_paths
from findlake.operators import catalog as C
from findlake.operators import changes as CH
from findlake.operators import listing as L
from findlake.operators import search as S
from findlake.sources import fixtures as FX

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_against_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    if name not in ORACLE:
        assert df.count() >= 0
        return
    r = compare(df, con, ORACLE[name])
    assert r["match"], r


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["query_id", "rank", "path", "name", "item_type", "parent", "score"]


def test_undo_after_apply_is_identity(small_catalog):
    plan = CH.rename_plan(small_catalog, FX.rename_requests(small_catalog))
    statuses = {r.status for r in plan.select("status").distinct().collect()}
    assert statuses == {"unchanged", "invalid_name", "exists", "missing", "ok"}
    new = CH.apply_renames(small_catalog, plan)
    assert new.select("path_key").distinct().count() == small_catalog.count()
    back = CH.undo_renames(new, plan)
    cols = ["ordinal", "path", "path_key", "name", "parent", "parent_name", "suffix", "is_dir", "drive"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, small_catalog.select(cols).collect()))


def test_nested_renames_in_one_batch(spark):
    cat = catalog_from_paths(spark, [("D:/a/b/c.txt", False), ("D:/a/d.txt", False)])
    renames = spark.createDataFrame([(1, "D:/a", "A2"), (2, "D:/a/b", "B2"), (3, "D:/a/b/c.txt", "C2.txt")],
                                    "change_id bigint, path string, new_name string")
    plan = CH.rename_plan(cat, renames)
    assert {r.status for r in plan.collect()} == {"ok"}
    paths = {r.path for r in CH.apply_renames(cat, plan).collect()}
    assert paths == {"D:/A2", "D:/A2/B2", "D:/A2/B2/C2.txt", "D:/A2/d.txt"}


def test_rename_statuses(spark):
    cat = catalog_from_paths(spark, [("D:/x/a.txt", False), ("D:/x/b.txt", False)])
    renames = spark.createDataFrame(
        [(1, "D:/x/a.txt", "a.txt"), (2, "D:/x/a.txt", "bad|name"), (3, "D:/x/a.txt", "A.TXT"),
         (4, "D:/x/zz.txt", "q.txt"), (5, "D:/x/a.txt", "new.txt"), (6, "D:/x/b.txt", "new.txt"),
         (7, "D:/x/a.txt", "other.txt"), (8, "D:/x/b.txt", "sub/x.txt")],
        "change_id bigint, path string, new_name string")
    got = {r.change_id: r.status for r in CH.rename_plan(cat, renames).collect()}
    assert got == {1: "unchanged", 2: "invalid_name", 3: "exists", 4: "missing", 5: "ok", 6: "exists",
                   7: "missing", 8: "invalid_name"}


def test_create_plans(spark):
    cat = catalog_from_paths(spark, [("D:/x/a.txt", False), ("D:/x/f/g.txt", False)])
    manifest = spark.createDataFrame(
        [(1, "D:/x", "f", "folder", None, True), (2, "D:/x", "a.txt", "folder", None, True),
         (3, "D:/x", "new/deep", "folder", None, True), (4, "D:/x", "a.txt", "file", "hi", True),
         (5, "D:/x", "f", "file", "", True), (6, "D:/x/none", "n.txt", "file", "", False),
         (7, "D:/x/none", "n.txt", "file", "", True), (8, "D:/x", "../up", "file", "", True),
         (9, "D:/x/a.txt", "sub", "folder", None, True)],
        "change_id bigint, location string, name string, kind string, content string, make_parents boolean")
    folders = {(r.change_id, r.path): r.status for r in CH.create_folders(cat, manifest).collect()}
    assert folders[(1, "D:/x/f")] == "kept"
    assert folders[(2, "D:/x/a.txt")] == "conflict"
    assert folders[(3, "D:/x/new/deep")] == "created" and folders[(3, "D:/x/new")] == "created"
    assert folders[(9, "D:/x/a.txt/sub")] == "conflict"
    files = {r.change_id: r.status for r in CH.create_files(cat, manifest).collect()}
    assert files == {4: "overwritten", 5: "conflict", 6: "missing", 7: "created", 8: "invalid_name"}


def test_folder_with_files(spark):
    cat = catalog_from_paths(spark, [("D:/x/a.txt", False)])
    nested = spark.createDataFrame(
        [(1, "D:/x", "pack", [("r.txt", "hello"), ("bad?", "")], [("sub", [("s.txt", "")])])],
        "change_id bigint, location string, folder string, files array<struct<name:string,content:string>>, "
        "subfolders array<struct<name:string,files:array<struct<name:string,content:string>>>>")
    got = {(r.kind, r.path): r.status for r in CH.create_folder_with_files(cat, nested).collect()}
    assert got == {("folder", "D:/x/pack"): "created", ("file", "D:/x/pack/r.txt"): "created",
                   ("file", "D:/x/pack/bad?"): "invalid_name", ("folder", "D:/x/pack/sub"): "created",
                   ("file", "D:/x/pack/sub/s.txt"): "created"}


def test_listing_numbers_by_name(spark):
    cat = catalog_from_paths(spark, [("D:/x/b.txt", False), ("D:/x/.h", False), ("D:/x/a", True),
                                     ("D:/x/c/d.txt", False)])
    shown = L.number_listing(L.content_type_filter(L.hide_dotfiles(L.list_directory(cat, "d:/X/")), "everything"))
    assert [(r.row_no, r.name, r.item_label) for r in shown.orderBy("row_no").collect()] == [
        (1, "a", "\U0001F4C1 Folder"), (2, "b.txt", "\U0001F4C4 File"), (3, "c", "\U0001F4C1 Folder")]


def test_stream_equals_batch(spark, tmp_path):
    from findlake.streaming.ingest import ingest_fixture
    streamed = ingest_fixture(spark, SF_SMALL, str(tmp_path)).select("path_key")
    batch = C.build_catalog(FX.fixture_listing(spark, SF_SMALL)).select("path_key")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_rank_results_matches_window(spark, small_catalog):
    hits = S.hits_scan(small_catalog, S.prepare_queries(FX.query_batch(spark)))
    cands = S.fallback_union(hits, 50)
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")
    expected = cands.select("query_id", "ordinal", F.row_number().over(w).cast("bigint").alias("rank"))
    got = S.rank_results(cands, bucket_bits=3).select("query_id", "ordinal", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_tree_listing_source(spark, tmp_path):
    from findlake.sources.tree import list_tree
    root = tmp_path / "test_root"
    (root / "folder1").mkdir(parents=True)
    for rel in ("doc1.txt", "image.jpg", "folder1/doc2.pdf"):
        (root / rel).write_text("content")
    cat = C.build_catalog(list_tree(spark, str(root)))
    roots = spark.createDataFrame([(str(root),)], "root string").selectExpr("root", "root AS root_key")
    below = {r.path[len(str(root)) + 1:]: r.is_dir for r in C.scope_to_roots(cat, roots).collect()}
    assert below == {"doc1.txt": False, "image.jpg": False, "folder1": True, "folder1/doc2.pdf": False}


def test_autocomplete_pushes_prefix_filter(spark, tmp_path):
    from findlake.plans.search import autocomplete
    from findlake.sources import tables as TB
    path = str(tmp_path / "cat")
    TB.write_catalog(C.with_tokens(C.build_catalog(FX.fixture_listing(spark, SF_SMALL))), path)
    df = autocomplete(TB.read_catalog(spark, path), FX.query_batch(spark, ["blue", "doc"]), 20)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(name_lc,blue)" in plan


def test_stateful_stream_dedup(spark, tmp_path):
    from findlake.streaming.ingest import ingest_with_state
    listing = FX.fixture_listing(spark, SF_SMALL)
    src = str(tmp_path / "src")
    listing.unionByName(listing).repartition(3).write.parquet(src)  # every path arrives twice
    q = (ingest_with_state(spark, src).writeStream.format("memory").queryName("stateful_ingest")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("stateful_ingest")
    expected = C.skip_system_dirs(C.with_item_columns(C.normalise_listing(listing))).select("path_key").distinct()
    assert got.count() == expected.count()
    assert got.select("path_key").exceptAll(expected).count() == 0


def test_sequential_number_across_partitions(spark):
    from pyspark.sql import Window
    from findlake.operators.numbering import sequential_number
    rows = [("big", f"n{i % 37:02d}", i) for i in range(300)] + [("small", f"m{i}", 1000 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "grp string, name string, ordinal bigint")
    got = sequential_number(df, ["grp"], ["name", "ordinal"], num_partitions=6)
    assert got.count() == 305
    w = Window.partitionBy("grp").orderBy("name", "ordinal")
    expected = df.withColumn("row_no", F.row_number().over(w).cast("bigint"))
    assert sorted(map(tuple, got.select("grp", "ordinal", "row_no").collect())) == \
        sorted(map(tuple, expected.select("grp", "ordinal", "row_no").collect()))
    ungrouped = sequential_number(df, [], ["name", "ordinal"], num_partitions=6)
    w_all = Window.orderBy("name", "ordinal")
    expected_all = df.withColumn("row_no", F.row_number().over(w_all).cast("bigint"))
    assert sorted(map(tuple, ungrouped.select("ordinal", "row_no").collect())) == \
        sorted(map(tuple, expected_all.select("ordinal", "row_no").collect()))
