"""The run store of the stream: replays, compaction, running total, rows set aside, awkward ordinals and depths."""

import random

import pytest

from findlake.operators import catalog as C
from findlake.operators import stats
from findlake.streaming import ingest as IN
from findlake.streaming import store as ST

LISTING = "ordinal bigint, path string, is_dir boolean"
ITEM = ("ordinal", "path", "path_key", "is_dir", "name", "parent", "suffix", "drive")


def _rows(df):
    return sorted(map(tuple, df.select(*ITEM).collect()))


def _stored(spark, root, batches, fanout=3):
    ST.create(spark, root)
    for i, rows in enumerate(batches):
        IN.ingest_batch(spark.createDataFrame(rows, LISTING), i, root, fanout)
    return ST.snapshot(spark, root)


def test_many_batches_equal_one_build(spark, tmp_path):
    rng = random.Random(5)
    listing = [(rng.randrange(500), f"D:/r/{rng.choice('abAB')}/{rng.choice('cdC')}{rng.randrange(25)}/f{rng.randrange(4)}.txt",
                False) for _ in range(260)]
    batches = [listing[i::13] for i in range(13)]
    root = str(tmp_path / "store")
    snap = _stored(spark, root, batches)
    whole = spark.createDataFrame(listing, LISTING)
    batch_built = C.build_catalog(whole)
    assert _rows(IN.read_ingested(spark, root)) == _rows(batch_built)
    # 13 batches at fanout 3: 111 in base 3, so one run on each of three levels.
    assert sorted(r.level for r in snap.runs) == [0, 1, 2]
    exact = stats.total_items(batch_built).first()[0]
    assert snap.total_items == exact == ST.running_total(spark, root).first()[0]
    assert snap.listed == 260 and snap.set_aside == 0
    approx = ST.approximate_total(spark, [root, root]).first()[0]
    assert abs(approx - exact) <= 3 * ST.SKETCH_ERROR * exact


def test_replayed_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    first = _stored(spark, root, [[(1, "D:/a/b", False), (2, None, False)], [(3, "D:/a/c", False)]])
    again = IN.ingest_batch(spark.createDataFrame([(3, "D:/a/c", False)], LISTING), 1, root)
    assert again == first and first.total_items == 3
    ST.create(spark, root)  # a restart finds the store
    assert ST.snapshot(spark, root) == first


def test_lost_manifest_slot_leaves_the_other(spark, tmp_path):
    root = str(tmp_path / "store")
    _stored(spark, root, [[(1, "D:/a/b", False)], [(2, "D:/a/c", False)]])
    last = ST.snapshot(spark, root)
    # A writer that dies while it replaces the older slot: that slot is empty.
    spark.createDataFrame([], ST._MANIFEST).write.mode("overwrite").parquet(ST._slot(root, last.version + 1))
    assert ST.snapshot(spark, root) == last
    snap = IN.ingest_batch(spark.createDataFrame([(3, "D:/a/d", False)], LISTING), 2, root)
    assert snap.version == last.version + 1 and snap.total_items == 4


def test_earlier_row_in_a_later_batch(spark, tmp_path):
    rows = [[(9, "D:/a/B.txt", False)], [(4, "D:/a/b.txt", False)], [(6, "D:/A/b.TXT", False)]]
    root = str(tmp_path / "store")
    snap = _stored(spark, root, rows, fanout=8)
    assert snap.total_items == 2
    assert [r.n_rows for r in snap.runs] == [2, 2]  # the third batch holds nothing earlier
    assert _rows(IN.read_ingested(spark, root)) == _rows(C.build_catalog(spark.createDataFrame(sum(rows, []), LISTING)))


def test_bad_rows_go_to_a_sink_with_a_reason(spark, tmp_path):
    bad = [(None, "D:/a/x", False, "null_ordinal"), (1, None, False, "null_path"), (2, "  ", False, "blank_path"),
           (3, "D:/a/\0", False, "unparsable_path"), (4, "../b", False, "relative_path"), (5, "D:", True, "relative_path"),
           (6, "C:\\", True, "no_name"), (7, "/", True, "no_name")]
    good = [(8, "D:/a/b", False), (9, "/home/c", None)]
    listing = spark.createDataFrame([r[:3] for r in bad] + good, LISTING)
    aside = C.set_aside_listing(listing)
    assert sorted(map(str, map(tuple, aside.collect()))) == sorted(map(str, bad))
    assert aside.count() + C.sound_listing(listing).count() == listing.count()
    assert {r.path for r in C.build_catalog(listing).collect()} == {"D:/a", "D:/a/b", "/home", "/home/c"}
    # The same through files, as a stream.
    source, root = str(tmp_path / "in"), str(tmp_path / "store")
    listing.repartition(2).write.parquet(source)
    IN.ingest_foreach_batch(spark, source, root, str(tmp_path / "ck"))
    snap = ST.snapshot(spark, root)
    assert (snap.listed, snap.set_aside) == (10, 8)
    got = IN.read_set_aside(spark, root).select("ordinal", "path", "is_dir", "reason").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, bad))
    assert _rows(IN.read_ingested(spark, root)) == _rows(C.build_catalog(listing))


def test_deep_paths_and_empty_batches(spark, tmp_path):
    deep = "D:/" + "/".join(f"p{i}" for i in range(120)) + "/leaf"
    listing = [(1, deep, False), (2, "D:/p0/x", False)]
    root = str(tmp_path / "store")
    snap = _stored(spark, root, [listing[1:], [], listing[:1]])
    assert snap.batch_id == 2 and snap.deepest == 122
    rows = _rows(IN.read_ingested(spark, root))
    assert rows == _rows(C.build_catalog(spark.createDataFrame(listing, LISTING)))
    assert len({r[0] for r in rows}) == len(rows) == 122


@pytest.mark.parametrize("low,high", [(0, 2 ** 62), (-2 ** 63, 2 ** 63 - 1)])
def test_any_listing_ordinals(spark, tmp_path, low, high):
    """Ordinals too large to be spread become ranks: same rows, same order, in batch and stream."""
    deep = "D:/" + "/".join(f"p{i}" for i in range(120)) + "/leaf"
    listing = [(high, "D:/z/last", False), (low, deep, False), (5, "D:/z/mid", False), (5, "D:/z/also", False)]
    built = C.build_catalog(spark.createDataFrame(listing, LISTING))
    order = [r.path for r in built.orderBy("ordinal", "path").collect()]
    assert order[119:] == ["D:/" + "/".join(f"p{i}" for i in range(120)), deep, "D:/z", "D:/z/also", "D:/z/mid", "D:/z/last"]
    root = str(tmp_path / "store")
    _stored(spark, root, [listing[:2], listing[2:]])
    assert [r.path for r in IN.read_ingested(spark, root).orderBy("ordinal", "path").collect()] == order


def test_empty_store(spark, tmp_path):
    root = str(tmp_path / "store")
    ST.create(spark, root)
    assert IN.read_ingested(spark, root).count() == 0 and ST.running_total(spark, root).first()[0] == 0
    assert ST.approximate_total(spark, [root]).first()[0] == 0


def test_a_fixture_arrival_has_a_part_for_every_core(spark, tmp_path):
    from glob import glob

    from findlake.sources.fixtures import fixture_listing
    from findlake.streaming.ingest import ingest_fixture

    got = ingest_fixture(spark, "/root/testdata/sf0.001", str(tmp_path), n_files=2, batch_files=3)
    files = glob(str(tmp_path / "*" / "listing" / "*.parquet"))
    assert len(files) == 6
    store = glob(str(tmp_path / "*" / "catalog"))[0]
    assert ST.snapshot(spark, store).batch_id == 1  # two arrivals, of three files each
    want = C.build_catalog(fixture_listing(spark, "/root/testdata/sf0.001"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_normalised_once_equals_normalised_per_step(spark):
    from findlake.operators.catalog import listing_fault, normalised_paths
    from findlake.functions import paths as P
    from pyspark.sql import functions as F

    raw = ["a\\b//c/", "C:/x/\n", "a/\n/", " ", "", "C:/", "/", "x/../y", "x\0/y", None, "C:\\", "a/./b", "one", "r/ü"]
    listing = spark.createDataFrame([(i, p, False) for i, p in enumerate(raw)], "ordinal bigint, path string, is_dir boolean")
    want = {r[0]: r[1:] for r in listing.select("ordinal", P.normalise_path("path"), listing_fault()).collect()}
    got = normalised_paths(listing).select("ordinal", "path", listing_fault(normalised=True))
    assert {r[0]: r[1:] for r in got.collect()} == want
