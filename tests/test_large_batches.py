"""What meets the whole catalog or all hits: few shuffles, and the same rows on either side of the broadcast bound."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import catalog_from_paths
from findlake.operators import catalog as C
from findlake.operators import changes as CH
from findlake.operators import search as S
from findlake.sources import tables as TB
from findlake.sources.fixtures import query_batch

RENAMES = "change_id bigint, path string, new_name string"
MANIFEST = "change_id bigint, location string, name string, kind string, content string, make_parents boolean"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def both_bounds(monkeypatch, make):
    """The sorted rows of ``make()`` with keys broadcast and with keys shuffled."""
    found = [sorted(map(tuple, make().collect()), key=str)]
    for module in (C, CH):
        monkeypatch.setattr(module, "MAX_BROADCAST_KEY_BYTES", -1)
    found.append(sorted(map(tuple, make().collect()), key=str))
    assert found[0] == found[1] and found[0]
    return found[0]


def test_unions_do_not_shuffle_the_hits(spark, no_auto_broadcast, monkeypatch):
    cat = catalog_from_paths(spark, [(f"D:/r/blue_{i}.txt", False) for i in range(30)] + [("D:/r/sky blue", False)])
    hits = S.hits_scan(cat, S.prepare_queries(query_batch(spark, ["blue", "sky", "zz"]))).select(*S.MEMBER_COLUMNS)
    for union in (S.union_strategies, S.fallback_union):
        assert "SortMergeJoin" not in plan_of(union(hits, 3))
    with monkeypatch.context() as m:
        assert len(both_bounds(m, lambda: S.union_strategies(hits, 3).select("query_id", "path"))) == 32
    # The prefix cut is 6 items; 'blue' is a word of all, so nothing falls back for it.
    assert len(both_bounds(monkeypatch, lambda: S.fallback_union(hits, 100).select("query_id", "path"))) == 32


def test_indexed_items_from_distinct_folders(spark, no_auto_broadcast, monkeypatch):
    paths = ["C:/Users/me/Documents/a/b.txt", "C:/Users/me/Documentsx/c.txt", "C:/Users/me/other.txt", "D:/x", "D:/y/z/w",
             "/home/q", "E:/Archive/1"]
    cat = catalog_from_paths(spark, [(p, False) for p in paths])
    roots = spark.createDataFrame([("C:/users/me/documents/",) * 2, ("D:/",) * 2, ("C:/nowhere",) * 2, (None, None)],
                                  "root string, root_key string")
    assert "SortMergeJoin" not in plan_of(C.indexed_items(cat, roots)).split("Scan parquet")[0]
    below = {r.path for r in C.scope_to_roots(cat, C.valid_roots(roots, cat)).collect()}
    found = both_bounds(monkeypatch, lambda: C.indexed_items(cat, roots).select("path"))
    assert {p for p, in found} == below == {"C:/Users/me/Documents/a", "C:/Users/me/Documents/a/b.txt", "D:/x", "D:/y",
                                            "D:/y/z", "D:/y/z/w"}


def test_target_exists_of_a_large_batch_is_one_join(spark, no_auto_broadcast, monkeypatch):
    cat = catalog_from_paths(spark, [(f"D:/r/f{i}", False) for i in range(20)])
    requests = spark.createDataFrame([(1, "D:/r/f3", "F4"), (2, "D:/r/f3", "zz"), (3, "D:/r/f5", None), (None, "D:/r/f5", "f6")],
                                     RENAMES)
    found = both_bounds(monkeypatch, lambda: CH.target_exists(cat, requests).select("change_id"))
    assert found == [(1,), (None,)]
    assert plan_of(CH.target_exists(cat, requests)).count("Join") == 1


def recorded(monkeypatch, spark, seen):
    real = CH.staged

    def staged(df, name):
        seen.append((name, plan_of(df)))
        kept = real(df, name)
        seen[-1] += (kept.count(),)
        return kept

    monkeypatch.setattr(CH, "staged", staged)


def test_folders_that_exist_are_no_claims(spark, monkeypatch):
    cat = catalog_from_paths(spark, [(f"D:/a/b/c/d/f{i}", False) for i in range(40)])
    batch = [(i, "D:/A/b/c/d", f"new{i}", "file", "x", True) for i in range(40)]
    batch += [(40, "D:/a/b/c/d/f1", "below", "folder", None, True), (41, "D:/a/q/r", "s", "folder", None, True),
              (42, "D:/a/q/R", "t", "file", None, False), (None, "D:/a", "lost", "file", None, True)]
    manifest = spark.createDataFrame(batch, MANIFEST)
    with monkeypatch.context() as m:
        seen = []
        recorded(m, spark, seen)
        CH.create_files(cat, manifest).count()
        # 43 targets and the paths above them that are no folders yet: f1; q and q/r, twice.
        assert [n for name, _, n in seen if name in ("creation-steps", "creation-claims")][:2] == [48, 48]
    both = lambda: CH.create_files(cat, manifest).select("change_id", "path", "status")
    with monkeypatch.context() as m:
        assert {(c, s) for c, _, s in both_bounds(m, both)} == {(i, "created") for i in range(40)} | {(42, "created")}
    rows = both_bounds(monkeypatch, lambda: CH.create_folders(cat, manifest))
    assert {(r[0], r[1], r[3]) for r in rows} == {(40, "D:/a/b/c/d/f1/below", "conflict"), (41, "D:/a/q", "created"),
                                                  (41, "D:/a/q/r", "created"), (41, "D:/a/q/r/s", "created")}


def test_rows_without_rivals_are_not_joined_for_them(spark, no_auto_broadcast, monkeypatch):
    rows = [(i, f"s{i}", f"t{i}") for i in range(20)] + [(20, "s3", "u"), (21, "v", "t4"), (22, None, "w"), (23, "x", None)]
    df = spark.createDataFrame(rows, "change_id bigint, src_key string, tgt_key string")
    with monkeypatch.context() as m:
        seen = []
        recorded(m, spark, seen)
        assert {r.change_id for r in CH._first_come(df).collect()} == set(range(20))
        first = next(p for name, p, _ in seen if name == "rivals")
        assert "SortMergeJoin" not in first and "Exchange hashpartitioning" not in first
    monkeypatch.setattr(C, "MAX_BROADCAST_KEY_BYTES", -1)
    assert {r.change_id for r in CH._first_come(df).collect()} == set(range(20))


def test_large_parts_of_a_stored_catalog_are_split(spark, tmp_path):
    cat = catalog_from_paths(spark, [(f"D:/r/some_name_{i * 7919}.txt", False) for i in range(4000)]).repartition(8)
    settings = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        TB.write_catalog(cat, str(tmp_path / "cat"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = [f for _, _, names in os.walk(tmp_path / "cat") for f in names if f.endswith(".parquet")]
    assert len(files) > 1
    assert TB.read_catalog(spark, str(tmp_path / "cat")).agg(F.count_distinct("path_key")).first()[0] == 4001
