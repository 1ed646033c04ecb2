import hashlib

import pytest

from findlake.llm.linededup import kept_texts, line_bitmaps, line_key
from findlake.llm.queries import op13_line_dedup

SCHEMA = "doc_id long, text string, h string, ends string, pos string"
UPPER = {c: c + 32 for c in range(65, 91)}


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute(rows, min_docs, keep_first, hash_of):
    """(id, kept text) of every row; documents in the operator's order of first occurrences."""
    docs = sorted({(r[0], r[1]) for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0, hash_of[d[1]]))
    holders = {}
    for d in docs:
        for line in (d[1] or "").split("\n"):
            holders.setdefault(key_of(line), set()).add(d)
    seen, kept = set(), {}
    for d in docs:
        out = []
        for line in (d[1] or "").split("\n"):
            k = key_of(line)
            if k and len(holders[k]) >= min_docs and (not keep_first or k in seen):
                continue
            seen.add(k)
            out.append(line)
        kept[d] = out
    return sorted(((r[0], len((r[1] or "").split("\n")), len(kept[r[0], r[1]]), "\n".join(kept[r[0], r[1]])) for r in rows),
                  key=repr)


HOT = [(i, f"own {i}\n  Shared LINE \t\nshared line\n\nrare {i // 2}\nÉtat {i % 3}", "x", "y", "z") for i in range(60)]
ODD = [(None, None, None, None, None), (None, "a\nb", "", "", ""), (3, "", "", "", ""), (4, "a\r\nB \n\x0ba", "", "", ""),
       (4, "a\r\nB \n\x0ba", "", "", ""), (4, "b\na", "", "", ""), (5, "\n".join(f"l{i % 7}" for i in range(20_000)), "", "", ""),
       (6, "z" * 200_000 + "\nl3", "", "", ""), (7, "ÀB\nàb\nàB", "", "", "")]


@pytest.mark.parametrize("rows", [HOT, ODD, HOT + ODD + HOT[:5]], ids=["hot", "odd", "both"])
@pytest.mark.parametrize("min_docs, keep_first", [(1, True), (2, False), (10, False), (3, True)])
def test_against_brute_force(spark, rows, min_docs, keep_first):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    hashes = {r.text: r.t for r in df.select("text", F.xxhash64("text").alias("t")).distinct().collect()}
    got = kept_texts(df, min_docs, keep_first)
    have = sorted(((r.doc_id, r.n_lines, r.n_lines - r.n_dropped, r.kept) for r in got.collect()), key=repr)
    assert have == brute(rows, min_docs, keep_first, hashes)
    maps = {(r.doc_id, r.text_hash): r.keep_runs for r in line_bitmaps(df, min_docs, keep_first).collect()}
    for r in got.collect():
        runs = maps[r.doc_id, r.text_hash]
        assert runs == r.keep_runs and sum(x.n for x in runs) == r.n_lines - r.n_dropped
        assert all(a.first + a.n < b.first for a, b in zip(runs, runs[1:]))


def test_key_spread_over_ranges(spark):
    """A key in nearly all lines, in more ranges than one: its count and its first occurrence are the table's."""
    rows = [(i, "common\n" + "x" * (i % 5), "", "", "") for i in range(4_000)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = line_bitmaps(spark.createDataFrame(rows, SCHEMA), 4_000, True).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sorted(r.doc_id for r in got if r.n_dropped == 0) == [0]


def test_short_keys_stay_and_empty_table(spark):
    df = spark.createDataFrame([(i, "ab\nabc", "", "", "") for i in range(4)], SCHEMA)
    assert {r.kept for r in kept_texts(df, 2, False, min_chars=3).collect()} == {"ab"}
    assert kept_texts(df.limit(0)).count() == 0 and line_bitmaps(df.limit(0)).count() == 0


def test_key_folds_ascii_only(spark):
    from pyspark.sql import functions as F

    rows = ["  Ab\x0c", "ÄB\t", " x ", "İ", "\x0b \r"]
    got = spark.createDataFrame([(r,) for r in rows], "x string").select(line_key(F.col("x"))).collect()
    assert [r[0] for r in got] == [key_of(r) for r in rows]


def test_query_runs_no_python(spark):
    df = op13_line_dedup(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.kept_sha256 != empty or r.n_dropped <= r.n_lines for r in df.collect())
