"""The stored search index against the scan forms, which compare every item with every query."""

import pytest

from conftest import catalog_from_paths
from findlake.operators import postings as PO
from findlake.operators import search as S
from findlake.plans import search as SP
from findlake.sources.fixtures import query_batch

PATHS = [(f"C:/docs/{n}", False) for n in (
    "a", "b.txt", "ab", "abc", "abc.txt", "ABC-final.txt", "xabcx", "é", "Été.txt", "aé", "日本語.txt", "a.b.c", "aaa", "aaaa",
    "report_2020.pdf", "report-2021.pdf", "my report.pdf", "..x", ".hidden", "the_old_file.tar.gz", "p%q_r")]
PATHS += [(f"D:/many/order_{i}.pdf", False) for i in range(90)] + [("D:/many/order", True)]
RAW = ["a", "ab", "abc", "ABC ", "é", "日", "日本語", "aaa", "aa", "report", "report 2020", "my-report", "pdf order", "order_1", "zzz",
       "ab zzz", "c.txt", "", "  ", ".", "..", "old file", "%q", "x" * 300]


@pytest.fixture(scope="module", params=[20, 4], ids=["one block", "many blocks"])
def index(spark, tmp_path_factory, request):
    before, PO.BLOCK_BITS = PO.BLOCK_BITS, request.param
    cat = catalog_from_paths(spark, PATHS)
    yield cat, PO.write_index(cat, str(tmp_path_factory.mktemp("ix") / "index"))
    PO.BLOCK_BITS = before


def batches(spark, raw=RAW):
    qn = S.prepare_queries(spark.createDataFrame(list(enumerate(raw)), "query_id int, raw string"))
    few = PO.Batch.of(qn)
    assert few.rows is not None
    return qn, [few, PO.Batch(qn, None)]


def pairs(df, *more):
    return sorted(tuple(r) for r in df.select("query_id", "path", *more).collect())


def test_each_strategy(spark, index):
    cat, ix = index
    qn, forms = batches(spark)
    for batch in forms:
        assert pairs(PO.substring_hits(ix, batch)) == pairs(S.substring_match(cat, qn))
        assert pairs(PO.word_hits(ix, batch)) == pairs(S.word_match(cat, qn))
        assert pairs(PO.prefix_hits(ix, batch)) == pairs(S.prefix_pairs(cat, qn))
        assert pairs(PO.first_by_arrival(PO.prefix_hits(ix, batch), 3), "prefix_rank") == pairs(
            S.prefix_match(cat, qn, 3), "prefix_rank")


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search(spark, index, monkeypatch, k):
    cat, ix = index
    queries = spark.createDataFrame(list(enumerate(RAW)), "query_id int, raw string")
    want = sorted(map(tuple, SP.multi_strategy_search(cat, queries, k, plan="scan").collect()))
    assert sorted(map(tuple, PO.search(ix, queries, k).collect())) == want
    monkeypatch.setattr(PO, "MAX_LITERALS", 2)  # the joins of a large batch
    assert sorted(map(tuple, PO.search(ix, queries, k).collect())) == want


def test_fixture_search_and_flags(spark, small_catalog, tmp_path):
    ix = PO.write_index(small_catalog, str(tmp_path / "index"))
    want = SP.multi_strategy_search(small_catalog, query_batch(spark), 50, plan="scan")
    assert sorted(map(tuple, PO.search(ix, query_batch(spark), 50).collect())) == sorted(map(tuple, want.collect()))
    qn = S.prepare_queries(query_batch(spark))
    flags = ["query_id", *S.HIT_COLUMNS, "is_exact", "is_prefix", "is_word", "is_contains", "score"]
    have = sorted(map(str, PO.all_hits(ix, PO.Batch.of(qn)).select(*flags).collect()))
    assert have == sorted(map(str, S.hits_scan(small_catalog, qn).select(*flags).collect()))


def test_no_nested_loop_and_pushed_keys(spark, small_catalog, tmp_path):
    ix = PO.write_index(small_catalog, str(tmp_path / "index"))
    plan = PO.search(ix, query_batch(spark), 50)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    batch = PO.Batch.of(S.prepare_queries(query_batch(spark)))
    words = PO.word_postings_hits(ix, batch)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(word" in words and "Exchange" not in words


def test_empty_catalog_and_batch(spark, tmp_path, index):
    cat, ix = index
    none = spark.createDataFrame([], "query_id int, raw string")
    assert PO.search(ix, none).count() == 0
    empty = PO.write_index(cat.limit(0), str(tmp_path / "empty"))
    assert PO.search(empty, spark.createDataFrame([(0, "a")], "query_id int, raw string")).count() == 0


def test_grams_are_stored_per_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(PO, "BLOCK_BITS", 20)
    cat = catalog_from_paths(spark, [(f"D:/many/order_{i:05d}.pdf", False) for i in range(600)])
    ix = PO.write_index(cat, str(tmp_path / "index"))
    items = ix.items.count()
    # "ord" is in every name: one row a bucket, not one a name.
    assert ix.grams.where("gram = 'ord'").count() <= items / 2 ** PO.BUCKET_BITS + 1
    qn = S.prepare_queries(spark.createDataFrame([(0, "order_003"), (1, "9.p"), (2, "9"), (3, "der_00599.pdf")], "query_id int, raw string"))
    for batch in (PO.Batch.of(qn), PO.Batch(qn, None)):
        assert pairs(PO.substring_hits(ix, batch)) == pairs(S.substring_match(cat, qn))
