"""Tree listings, prefix counts by sorted names, and the file-content sink."""

import os
import random
from collections import Counter

import pytest

from conftest import catalog_from_paths
from findlake.operators import catalog as C
from findlake.operators import changes as CH
from findlake.operators import listing as L
from findlake.operators import search as S
from findlake.operators.prefixes import prefix_counts
from findlake.sources import tables as TB
from findlake.sources import tree as TR


def _make(root, files, folders=()):
    for rel in folders:
        (root / rel).mkdir(parents=True)
    for rel, text in files.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(text)


@pytest.mark.parametrize("splits", [1, 2, 100])
def test_tree_listing_loses_nothing(spark, tmp_path, splits):
    root = tmp_path / "tree"
    _make(root, {"a.txt": "x", "empty.txt": "", ".hidden": "h", "_under": "u", "sub/.deep/b": "", "sub/c d.txt": "y",
                 "café/naïve": "z"}, ["void", "sub/void2/void3"])
    os.symlink(root, root / "sub" / "loop")
    os.symlink(root / "nowhere", root / "broken")
    expected = {str(p): p.is_dir() for p in root.rglob("*") if "loop/" not in str(p)}
    got = TR.list_tree(spark, str(root), splits).collect()
    assert {r.path: r.is_dir for r in got} == expected and len(got) == len(expected) == 7 + 6 + 2  # files, folders, links
    assert TR.unreadable(spark, str(root), splits).count() == 0
    roots = spark.createDataFrame([(str(root),)], "root string").selectExpr("root", "root AS root_key")
    cat = C.build_catalog(TR.list_tree(spark, str(root), splits))
    below = {r.path: r.is_dir for r in C.scope_to_roots(cat, roots).collect()}
    assert below == expected


def test_tree_without_entries_or_without_root(spark, tmp_path):
    (tmp_path / "void").mkdir()
    assert TR.list_tree(spark, str(tmp_path / "void")).count() == 0
    with pytest.raises(Exception, match="no folder"):
        TR.list_tree(spark, str(tmp_path / "absent")).count()


def test_names_that_are_no_text_and_unreadable_folders(tmp_path, monkeypatch):
    raw = os.fsencode(str(tmp_path)) + b"/bad\xff"
    open(raw, "w").close()
    assert [r[0] for r in TR._walk(str(tmp_path))] == [str(tmp_path) + "/bad\\xff"]

    def refuse(folder):
        raise PermissionError(folder)

    monkeypatch.setattr(TR.os, "scandir", refuse)
    assert list(TR._walk("/locked")) == [("/locked", True, "PermissionError")]


def _names(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name_lc string, ordinal bigint")


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_prefix_counts_at_any_cut(spark, ranges):
    rng = random.Random(ranges)
    names = ["".join(rng.choice("abé😀") for _ in range(rng.randrange(0, 7))) for _ in range(300)] + ["same"] * 200 + [None]
    counts, first = Counter(), {}
    for i, name in enumerate(names):
        for d in range(1, len(name or "") + 1):
            counts[name[:d]] += 1
            first.setdefault(name[:d], i)
    got = prefix_counts(_names(spark, names), ranges).collect()
    assert len(got) == len(counts)
    assert {r.prefix: (r.n_items, r.first_ordinal) for r in got} == {p: (n, first[p]) for p, n in counts.items()}


def test_prefix_counts_of_long_and_no_names(spark):
    long = "x" * 3000
    got = {r.prefix: r.n_items for r in prefix_counts(_names(spark, [long, long[:2000] + "y"]), 2).collect()}
    assert len(got) == 3001 and got[long[:2000]] == 2 and got[long[:2001]] == 1
    assert prefix_counts(_names(spark, ["", None])).count() == 0
    assert prefix_counts(_names(spark, ["a"]).limit(0)).count() == 0


def test_last_write_inside_a_nested_request_stays(spark, tmp_path):
    nested = spark.createDataFrame(
        [(5, "D:/x", "pack", [("n.txt", f"text {i}") for i in range(30)], [])],
        "change_id bigint, location string, folder string, files array<struct<name:string,content:string>>, "
        "subfolders array<struct<name:string,files:array<struct<name:string,content:string>>>>")
    flat = CH.flatten_nested_manifest(nested).repartition(4, "content")
    plan = CH.create_files(catalog_from_paths(spark, [("D:/x/pack", True)]), flat)
    TB.write_created_files(plan, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("D:/x/pack/n.txt", "text 29")]


def _rows_scanned(df):
    """Rows that the file scan of a query without shuffles handed on."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        if "FileSourceScan" in node.getClass().getName():
            rows += node.metrics().get("numOutputRows").get().value()
        waiting.extend(node.children().apply(i) for i in range(node.children().size()))
    return rows


@pytest.mark.parametrize("dictionary", ["true", "false"])
def test_listing_skips_row_groups(spark, tmp_path, dictionary):
    """One folder's items are found without reading the row groups that hold none of them."""
    rows = [(f"D:/r/folder{i:04d}/file{i}", False) for i in range(3000)]
    old = spark.conf.get("parquet.enable.dictionary", None)
    try:
        spark.conf.set("parquet.enable.dictionary", dictionary)
        TB.write_catalog(catalog_from_paths(spark, rows), str(tmp_path / "cat"), num_files=20)
    finally:
        spark.conf.unset("parquet.enable.dictionary") if old is None else spark.conf.set("parquet.enable.dictionary", old)
    cat = TB.read_catalog(spark, str(tmp_path / "cat"))
    assert cat.count() == 6001
    listing = L.list_directory(cat, "D:/R/folder0777")
    assert [r.path for r in listing.collect()] == ["D:/r/folder0777/file777"]
    assert _rows_scanned(listing) <= 3 * 6001 / 20  # a file in 20, with room for a false positive


def test_ranks_over_blocks_of_buckets(spark):
    rng = random.Random(3)
    rows = [(q, rng.choice([10, 80, 110]), rng.randrange(2 ** rng.choice([4, 12, 40])), f"p{i}")
            for i in range(400) for q in (1, 2)] + [(3, 80, 7, f"t{i}") for i in range(5)]
    cands = spark.createDataFrame(rows, "query_id int, score int, ordinal bigint, path string")
    expected = {}
    for q in (1, 2, 3):
        ordered = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[1], r[2], r[3]))
        expected.update({(q, r[3]): n for n, r in enumerate(ordered, 1)})
    for bits in (2, 6, 16):
        assert {(r.query_id, r.path): r["rank"] for r in S.rank_results(cands, bits).collect()} == expected
