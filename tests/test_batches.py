"""Batches of changes against one-after-another models, and catalogs from awkward listings."""

import random

import pytest

from conftest import catalog_from_paths
from findlake.operators import catalog as C
from findlake.operators import changes as CH
from findlake.operators import index as IX
from findlake.operators import listing as L
from findlake.plans import search as SP
from findlake.sources import tables as TB
from findlake.sources.fixtures import query_batch

RENAMES = "change_id bigint, path string, new_name string"
MANIFEST = "change_id bigint, location string, name string, kind string, content string, make_parents boolean"
NESTED = ("change_id bigint, location string, folder string, files array<struct<name:string,content:string>>, "
          "subfolders array<struct<name:string,files:array<struct<name:string,content:string>>>>")


def one_after_another(existing, batch):
    """Status of each rename when they are carried out in order on a directory."""
    used_names, moved, out = {p.lower() for p in existing}, set(), {}
    for cid, path, new in batch:
        target = (path.rpartition("/")[0] + "/" + new).lower()
        if new == path.rpartition("/")[2]:
            out[cid] = "unchanged"
        elif target in used_names:
            out[cid] = "exists"
        elif path.lower() in moved or path.lower() not in {p.lower() for p in existing}:
            out[cid] = "missing"
        else:
            out[cid] = "ok"
            used_names.add(target)
            moved.add(path.lower())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rival_renames_as_one_after_another(spark, seed):
    rng = random.Random(seed)
    existing = [f"D:/x/f{i}" for i in range(6)]
    cat = catalog_from_paths(spark, [(p, False) for p in existing])
    batch = [(i, rng.choice(existing + ["D:/x/none"]), rng.choice(["a", "A", "b", "c", "d", "f1"])) for i in range(40)]
    got = {r.change_id: r.status for r in CH.rename_plan(cat, spark.createDataFrame(batch, RENAMES)).collect()}
    assert got == one_after_another(existing, batch)


def test_rival_of_a_rename_that_never_happens(spark):
    cat = catalog_from_paths(spark, [("D:/x/a", False), ("D:/x/b", False)])
    batch = [(1, "D:/x/a", "x1"), (2, "D:/x/a", "y1"), (3, "D:/x/b", "y1")]
    got = {r.change_id: r.status for r in CH.rename_plan(cat, spark.createDataFrame(batch, RENAMES)).collect()}
    assert got == {1: "ok", 2: "missing", 3: "ok"}


def test_later_write_of_a_path_wins(spark, tmp_path):
    cat = catalog_from_paths(spark, [("D:/x/a.txt", False)])
    manifest = [(1, "D:/x", "n.txt", "file", "one", True), (2, "D:/x", "N.txt", "file", "two", True),
                (3, "D:/x", "made", "folder", None, True), (4, "D:/x", "made", "file", "z", True)]
    plan = CH.create_files(cat, spark.createDataFrame(manifest, MANIFEST))
    assert {r.change_id: r.status for r in plan.collect()} == {1: "created", 2: "overwritten", 4: "conflict"}
    TB.write_created_files(plan, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("D:/x/n.txt", "two")]


def creations_in_order(existing, batch):
    """Rows of a creation plan when the requests are carried out in order on a dict of paths (True: a folder)."""
    disk, folders, files = {p.lower(): d for p, d in existing}, [], {}
    for cid, location, name, kind, _, make_parents in batch:
        parts = f"{location}/{name}".split("/")
        way = ["/".join(parts[:d]) for d in range(2, len(parts) + 1)]
        above, target = way[:-1], way[-1]
        state = disk.get(target.lower())
        if any(disk.get(p.lower()) is False for p in above) or (state is not None and state != (kind == "folder")):
            status = "conflict"
        elif kind == "file" and not make_parents and above and above[-1].lower() not in disk:
            status = "missing"
        elif state is not None:
            status = "kept" if kind == "folder" else "overwritten"
        else:
            status = "created"
        if status in ("created", "kept", "overwritten"):
            new = [p for p in above if p.lower() not in disk]
            disk.update({p.lower(): True for p in new})
            disk[target.lower()] = kind == "folder"
            if kind == "folder":
                folders += [(cid, p, "ancestor", "created") for p in new]
        if kind == "folder":
            folders.append((cid, target, "target", status))
        else:
            files[cid] = status
    return sorted(folders), files


@pytest.mark.parametrize("seed", range(3))
def test_creations_as_one_after_another(spark, seed):
    rng = random.Random(seed)
    existing = [("D:/x", True), ("D:/x/a", False), ("D:/x/b", True)]
    batch = [(i, "D:/x" + rng.choice(["", "/n", "/N", "/m", "/n/p", "/b", "/q"]),
              rng.choice(["a", "b", "n", "p", "m", "Q", "n/m", "p/r"]), rng.choice(["file", "folder"]), "",
              rng.random() < 0.6) for i in range(70)]
    cat = catalog_from_paths(spark, existing)
    manifest = spark.createDataFrame(batch, MANIFEST).repartition(3)
    folders, files = creations_in_order(existing, batch)
    assert sorted(map(tuple, CH.create_folders(cat, manifest).collect())) == folders
    assert {r.change_id: r.status for r in CH.create_files(cat, manifest).collect()} == files


@pytest.mark.parametrize("batch,folder,file", [
    ([(1, "D:/x", "n", "file", "", True), (2, "D:/x", "n", "folder", None, True)], {2: "conflict"}, {1: "created"}),
    ([(3, "D:/x", "f", "file", "", True), (4, "D:/x/f", "g", "file", "", True)], {}, {3: "created", 4: "conflict"}),
    ([(5, "D:/x", "k", "folder", None, True), (6, "D:/x", "K", "folder", None, True)], {5: "created", 6: "kept"}, {}),
    ([(7, "D:/x/k", "f", "file", "", False), (8, "D:/x", "k", "folder", None, True), (9, "D:/x/k", "f", "file", "", False)],
     {8: "created"}, {7: "missing", 9: "created"})])
def test_order_inside_a_creation_batch(spark, batch, folder, file):
    cat = catalog_from_paths(spark, [("D:/x/a", False)])
    manifest = spark.createDataFrame(batch, MANIFEST)
    assert {r.change_id: r.status for r in CH.create_folders(cat, manifest).where("role = 'target'").collect()} == folder
    assert {r.change_id: r.status for r in CH.create_files(cat, manifest).collect()} == file


def test_large_nested_request(spark):
    cat = catalog_from_paths(spark, [("D:/x/a.txt", False)])
    nested = [(9 * 10**15, "D:/x", "pack", [(f"f{i}", "") for i in range(1200)], [("sub", [(f"s{i}", "") for i in range(3)])])]
    rows = CH.create_folder_with_files(cat, spark.createDataFrame(nested, NESTED)).collect()
    assert len({r.path for r in rows}) == 1205 and {r.status for r in rows} == {"created"}
    assert sum(r.kind == "file" for r in rows) == 1203


def test_ordinals_of_any_step_and_deep_paths(spark):
    paths = [f"D:/r/d{i % 3}/blue{i}" for i in range(8)]
    found = SP.multi_strategy_search(catalog_from_paths(spark, [(p, False) for p in paths]),
                                     query_batch(spark, ["blue", "d"]), 50).collect()
    assert sum(r.query_id == 0 for r in found) == 8 and sum(r.query_id == 1 for r in found) == 3
    deep = "D:/" + "/".join(f"p{i}" for i in range(120)) + "/leaf"
    rows = catalog_from_paths(spark, [(deep, False)]).collect()
    assert len({r.ordinal for r in rows}) == len(rows) == 121
    by_order = [r.path for r in sorted(rows, key=lambda r: r.ordinal)]
    assert by_order == sorted(by_order, key=len)


def test_tied_ordinals_lose_no_hit(spark):
    listing = spark.createDataFrame([(7, f"D:/r/blue{i}", False) for i in range(9)], "ordinal bigint, path string, is_dir boolean")
    cat = C.with_tokens(C.build_catalog(listing))
    for plan in ("scan", "indexed"):
        assert SP.multi_strategy_search(cat, query_batch(spark, ["blue"]), 50, plan=plan).count() == 9
    plan = CH.rename_plan(cat, spark.createDataFrame([(1, "D:/r/blue3", "red")], RENAMES))
    new = {r.path for r in CH.apply_renames(cat, plan).collect()}
    assert new == {"D:/r"} | {f"D:/r/blue{i}" for i in range(9) if i != 3} | {"D:/r/red"}
    assert {r.path for r in CH.undo_renames(CH.apply_renames(cat, plan), plan).collect()} == {r.path for r in cat.collect()}


def test_prefixes_are_whole(spark):
    cat = catalog_from_paths(spark, [("D:/r/a_name_of_many_letters.txt", False)])
    got = {r.prefix for r in IX.prefix_index(cat).collect()}
    assert "a_name_of_many_letters.txt" in got and len(got) == 26 + 1  # and the folder 'r'


def test_small_batch_does_not_shuffle_the_catalog(spark, tmp_path):
    path = str(tmp_path / "cat")
    TB.write_catalog(catalog_from_paths(spark, [(f"D:/r/f{i}", False) for i in range(50)]), path)
    cat = TB.read_catalog(spark, path)
    requests = spark.createDataFrame([(1, "D:/r/f3", "q")], RENAMES)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        side = C.matching(cat.select("path_key", "ordinal"), requests.selectExpr("lower(path) AS path_key"), "path_key")
        plan = side._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert CH.target_exists(cat, spark.createDataFrame([(1, "D:/r/f3", "F4"), (2, "D:/r/f3", "zz")], RENAMES)).count() == 1


def test_paths_without_drive_survive_storage(spark, tmp_path):
    path = str(tmp_path / "cat")
    TB.write_catalog(catalog_from_paths(spark, [("/home/me/a", False), ("D:/b", False)]), path)
    assert {r.drive for r in TB.read_catalog(spark, path).collect()} == {"", "D"}


def test_drive_locations_and_pushed_filter(spark, tmp_path):
    path = str(tmp_path / "cat")
    TB.write_catalog(catalog_from_paths(spark, [("C:/a/b", False), ("C:/c", False)]), path)
    cat = TB.read_catalog(spark, path)
    for where in ("C:", "c:/", "C:\\"):
        assert {r.name for r in L.list_directory(cat, where).collect()} == {"a", "c"}
    assert "EqualTo(parent_key,c:/a)" in L.list_directory(cat, "C:/A/")._jdf.queryExecution().executedPlan().toString()


def test_no_private_checkpoint_folder_on_a_cluster():
    from findlake.session import checkpoint_dir

    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def test_scan_roots_are_not_results(spark):
    import __spark_entry__ as E

    rows = E.queries()["multi_strategy_search"](spark, "/root/testdata/sf0.001").collect()
    found = {(r.query_id, r.path) for r in rows}
    assert not {p for _, p in found} & {"C:/Users/me/Pictures", "C:/Users/me/Documents", "C:/Users/me", "C:/Users"}
    assert all(not p.startswith("C:/") or p.startswith("C:/Users/me/") for _, p in found)


def test_renames_meet_folders_not_every_item(spark, monkeypatch):
    paths = [(f"D:/hot/Deep/file_{i}.txt", False) for i in range(300)] + [("D:/hot", True), ("D:/hot/deep", True)]
    cat = catalog_from_paths(spark, paths)
    renames = spark.createDataFrame([(1, "D:/HOT", "cold"), (2, "D:/hot/deep", "low"), (3, "d:/hot/deep/FILE_7.txt", "seven.txt")],
                                    "change_id long, path string, new_name string")
    plan = CH.rename_plan(cat, renames)
    met = []
    matching = CH.matching
    monkeypatch.setattr(CH, "matching", lambda side, requests, key: met.append(side.count()) or matching(side, requests, key))
    new = {r.path for r in CH.apply_renames(cat, plan).collect()}
    assert max(met) <= 10  # parts of the distinct parent folders
    assert new == {"D:/cold", "D:/cold/low", "D:/cold/low/seven.txt"} | {
        f"D:/cold/low/file_{i}.txt" for i in range(300) if i != 7}
    monkeypatch.setattr(CH, "MAX_BROADCAST_KEY_BYTES", -1)
    assert {r.path for r in CH.apply_renames(cat, plan).collect()} == new
    # An undo gives the names as the requests spelled them.
    undone = {r.path.lower() for r in CH.undo_renames(CH.apply_renames(cat, plan), plan).collect()}
    assert undone == {r.path.lower() for r in cat.collect()}
