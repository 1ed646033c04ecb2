"""Search against the plain-Python model, plan-form equivalence and edge cases."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, catalog_from_paths
from findlake.operators import search as S
from findlake.plans import search as SP
from findlake.sources.fixtures import query_batch


# One arrival order of paths, and per query and k the expected (path, score), worked out by hand:
# 100 equal / 80 starts / 50 contains / 0 by word only, + max(0, 30 - name length), + 10 below a common folder.
WORKED_PATHS = ["r/x/report", "r/Documents/report.txt", "r/x/old report", "r/x/reporting-2024.csv", "r/x/my_report_final",
                "r/Downloads/REPORT", "r/x/unreported", "r/x/final.cut", "r/x/a"]
WORKED = {
    ("report", 3): [("r/Downloads/REPORT", 134), ("r/x/report", 124), ("r/Documents/report.txt", 110)],
    ("report", 9): [("r/Downloads/REPORT", 134), ("r/x/report", 124), ("r/Documents/report.txt", 110),
                    ("r/x/reporting-2024.csv", 92), ("r/x/unreported", 70), ("r/x/old report", 70),
                    ("r/x/my_report_final", 65)],
    ("  FINAL\t", 2): [("r/x/final.cut", 101), ("r/x/my_report_final", 65)],
    ("2024 old", 4): [("r/x/old report", 20), ("r/x/reporting-2024.csv", 12)],
    ("ported", 4): [("r/x/unreported", 70)],
    ("a", 1): [("r/x/a", 129)],
    ("documents", 2): [("r/Documents", 121)],
    ("zz", 4): [],
}


@pytest.mark.parametrize("plan", ["scan", "indexed"])
def test_hand_worked_results(spark, plan):
    cat = catalog_from_paths(spark, [(p, False) for p in WORKED_PATHS])
    for k in sorted({k for _, k in WORKED}):
        raws = [raw for raw, kk in WORKED if kk == k]
        rows = SP.multi_strategy_search(cat, query_batch(spark, raws), k, plan=plan).collect()
        for i, raw in enumerate(raws):
            got = [(r.path, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == i]
            want = WORKED[raw, k]
            assert [x[1] for x in got] == [x[1] for x in want] and set(got) == set(want), (raw, k, got)


def test_shuffle_partitions_do_not_change_results(spark, small_catalog):
    base = SP.multi_strategy_search(small_catalog, query_batch(spark), 50).collect()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        other = SP.multi_strategy_search(small_catalog, query_batch(spark), 50).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, base)) == sorted(map(tuple, other))


def test_hits_forms_agree(spark, small_catalog):
    qn = S.prepare_queries(query_batch(spark))
    cols = ["query_id", "ordinal", "is_exact", "is_prefix", "is_word", "is_contains", "score"]
    a = S.hits_scan(small_catalog, qn).select(cols).collect()
    b = S.hits_indexed(small_catalog, qn).select(cols).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def _search(spark, paths, raws, k):
    cat = catalog_from_paths(spark, [(p, False) for p in paths])
    rows = SP.multi_strategy_search(cat, query_batch(spark, raws), k).collect()
    out = {i: [] for i in range(len(raws))}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append(r.path)
    return out


def test_blank_and_whitespace_queries(spark):
    got = _search(spark, ["a/b c", "a/x"], ["", "   ", "\t\n", "\u00a0"], 10)
    assert all(v == [] for v in got.values())


def test_prefix_cut_at_2k_in_arrival_order(spark):
    # k = 2: only the first 4 prefix hits by arrival are candidates; 4 >= k, so no
    # fallback, and the later, shorter (higher scoring) 'ordex' is never seen.
    paths = [f"r/d/ordelongname{i}" for i in range(5)] + ["r/d/ordex"]
    got = _search(spark, paths, ["orde"], 2)[0]
    assert got == ["r/d/ordelongname0", "r/d/ordelongname1"]
    got = _search(spark, paths, ["orde"], 5)[0]
    assert "r/d/ordex" in got


def test_fallback_only_below_k(spark):
    # 'tion' is no prefix, no word: every hit comes from the substring fallback.
    paths = ["r/x/action", "r/x/motion", "r/x/nation"]
    assert len(_search(spark, paths, ["tion"], 5)[0]) == 3
    # Two word hits and k = 2: the fallback is off, the 50-point substring hit is never seen.
    paths = ["r/x/alpha_pdf_one", "r/x/beta_pdf_two", "r/x/pdfish"]
    got = _search(spark, paths, ["pdf"], 2)[0]
    assert "r/x/pdfish" in got  # prefix hit (80 points) is a member
    paths = ["r/x/alpha_pdf_one", "r/x/beta_pdf_two", "r/x/xpdfx"]
    got = _search(spark, paths, ["pdf"], 2)[0]
    assert "r/x/xpdfx" not in got
    got = _search(spark, paths, ["pdf"], 3)[0]
    assert "r/x/xpdfx" in got


def test_hyphenated_query_word_is_not_a_word_hit(spark):
    # 'my-file' is one query word; names are split on '-', so no word hit; the substring fallback finds it.
    got = _search(spark, ["r/x/my-file.txt", "r/x/my_file.txt"], ["my-file"], 5)[0]
    assert got == ["r/x/my-file.txt"]


def test_case_twins_and_hidden_names(spark):
    cat = catalog_from_paths(spark, [("r/x/Report.TXT", False), ("r/x/report.txt", False), ("r/x/.hidden", False)])
    keys = {r.path_key: r.path for r in cat.collect()}
    assert keys["r/x/report.txt"] == "r/x/Report.TXT"  # first arrival wins
    got = _search(spark, ["r/x/.hidden"], [".hid"], 5)[0]
    assert got == ["r/x/.hidden"]  # search keeps hidden names


def test_root_level_items_have_empty_parent_name(spark):
    cat = catalog_from_paths(spark, [("D:/top.txt", False), ("D:/a/b.txt", False)])
    rows = {r.path: r for r in cat.collect()}
    assert rows["D:/top.txt"].parent == "D:/" and rows["D:/top.txt"].parent_name == ""
    assert rows["D:/a"].is_dir and rows["D:/a"].parent == "D:/"
    assert rows["D:/a/b.txt"].parent_name == "a"


def test_unicode_whitespace_and_case(spark):
    # Python str.split() also splits on U+001C..U+001F and no-break space.
    cat = catalog_from_paths(spark, [("r/x/alpha\u00a0beta\u001cgamma.txt", False)])
    toks = cat.where(F.col("name_lc").startswith("alpha")).select("tokens").first().tokens
    assert toks == ["alpha", "beta", "gamma", "txt"]
    got = _search(spark, ["r/x/\u00c9T\u00c9.txt"], ["\u00e9t\u00e9"], 5)[0]
    assert got == ["r/x/\u00c9T\u00c9.txt"]


def test_large_batch_forms_agree(spark, small_catalog):
    qn = S.prepare_queries(query_batch(spark))
    for fn in (S.prefix_pairs, S.substring_match):
        a = fn(small_catalog, qn).collect()
        b = fn(small_catalog, qn, max_broadcast=0).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b)), fn.__name__


def test_indexed_form_with_stored_gram_index(spark, small_catalog):
    from findlake.operators.index import gram_index
    a = SP.multi_strategy_search(small_catalog, query_batch(spark), 50, plan="scan").collect()
    b = SP.multi_strategy_search(small_catalog, query_batch(spark), 50, plan="indexed",
                                 gram_freq=gram_index(small_catalog)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
