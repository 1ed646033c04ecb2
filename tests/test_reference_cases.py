"""The reference's own test cases, re-expressed as DataFrame tests."""

from pyspark.sql import functions as F

from conftest import catalog_from_paths
from findlake.functions import paths as P
from findlake.functions import text as X
from findlake.operators import search as S
from findlake.plans import search as SP
from findlake.sources.fixtures import query_batch


def test_is_safe_filename(spark):
    cases = [("document.pdf", True), ("New Folder", True), ("", False), ("   ", False),
             ("../escaped", False), ("..\\escaped", False)] + [("invalid" + c, False) for c in '<>:"|?*']
    df = spark.createDataFrame(cases, "name string, expected boolean")
    got = df.select("name", "expected", X.is_safe_name("name").alias("safe")).collect()
    assert all(r.safe == r.expected for r in got), [r for r in got if r.safe != r.expected]


def test_get_drive_path(spark):
    df = spark.createDataFrame([("c", "C:/"), ("D", "D:/")], "letter string, root string")
    assert all(r.got == r.root for r in df.select("root", P.drive_path("letter").alias("got")).collect())


def test_get_item_type(spark):
    df = spark.createDataFrame([("folder", True, "folder"), ("file.txt", False, "file")],
                               "path string, is_dir boolean, type string")
    assert all(r.got == r.type for r in df.select("type", P.item_type("is_dir").alias("got")).collect())


def _prefix(spark, catalog, raws, n=20):
    res = SP.autocomplete(catalog, query_batch(spark, raws), n).collect()
    out = {i: [] for i in range(len(raws))}
    for r in sorted(res, key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append(r.path)
    return out


def test_trie_insert_and_search(spark):
    cat = catalog_from_paths(spark, [("C:/docs/report", False), ("C:/docs/report_final", False),
                                     ("C:/images/photo", False)])
    got = _prefix(spark, cat, ["rep", "photo", "xyz"])
    assert set(got[0]) == {"C:/docs/report", "C:/docs/report_final"}
    assert got[1] == ["C:/images/photo"]
    assert got[2] == []


def test_trie_case_insensitivity(spark):
    cat = catalog_from_paths(spark, [("x/Test", False)])
    got = _prefix(spark, cat, ["test", "TEST"])
    assert got[0] == ["x/Test"] and got[1] == ["x/Test"]


def test_search_index_add_and_search(spark):
    cat = catalog_from_paths(spark, [("tmp/important_document.txt", False), ("tmp/my_image.jpg", False)])
    res = SP.multi_strategy_search(cat, query_batch(spark, ["important", "image"]), 20).collect()
    assert "tmp/important_document.txt" in {r.path for r in res if r.query_id == 0}
    assert "tmp/my_image.jpg" in {r.path for r in res if r.query_id == 1}


def test_search_index_relevance(spark):
    cat = catalog_from_paths(spark, [("tmp/test.txt", False), ("tmp/test_long_file_name.txt", False)])
    res = SP.multi_strategy_search(cat, query_batch(spark, ["test"]), 20).orderBy("rank").collect()
    assert [r.path for r in res] == ["tmp/test.txt", "tmp/test_long_file_name.txt"]
    assert res[0].score > res[1].score
