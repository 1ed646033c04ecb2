import math
import re
from collections import defaultdict

import numpy as np

from findlake.llm.mixing import mix_copies, mixed
from findlake.llm.queries import op9_mixing

SCHEMA = "doc_id long, text string, source string, size string, copies int"


def targets(sizes):
    """source -> target by raising the water level a little at a time over exact fractions."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_w = sum(weight[s] for s in names if s not in capped)
        t = {s: 3 * sizes[s] if s in capped else rest * weight[s] / open_w for s in names}
        over = {s for s in names if t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def check(docs, rows):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = targets(sizes), defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["size"] >= 0 and 0 <= r["copies"] <= 3
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        taken[r.source] += r.copies * r["size"]
    return want, taken


def test_nulls_ties_and_hot_source(spark):
    docs = [(i, "w " * (1 + i % 9), "hot") for i in range(400)] + [(i, "a b", "b") for i in range(5)]
    docs += [(None, None, None), (1, "", "c"), (7, "x\x0by z", None), (7, "x\x0by z", None)]
    df = spark.createDataFrame([(*d, "clash", 9) for d in docs], SCHEMA)
    rows = mix_copies(df).collect()
    want, taken = check(docs, rows)
    for s in want:
        assert abs(taken[s] - want[s]) <= 5, (s, taken[s], want[s])
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mix_copies(df).collect()), key=repr)
    out = mixed(df)
    assert out.columns == df.columns and {r.doc_id for r in out.where("source = 'hot'").collect()} <= set(range(400))


def test_empty_table(spark):
    assert mix_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_meets_targets(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, taken = check(docs, mix_copies(spark.read.parquet(f"{sf}/documents.parquet")).collect())
    for s in want:
        assert abs(taken[s] - want[s]) <= max(10, 0.01 * want[s]), (s, taken[s], want[s])
    for r in op9_mixing(spark, sf).collect():
        assert r.taken <= 3 * r["size"]


def test_tilt_is_exponential_in_size(spark):
    """Within one source the long documents of a shrinking source lose more copies than the short ones."""
    docs = [(i, "w " * (10 if i % 2 else 100), "a", "", 0) for i in range(2000)] + [(9, "w " * 60_000, "b", "", 0)]
    rows = [r for r in mix_copies(spark.createDataFrame(docs, SCHEMA), weights=(1, 2)).collect() if r.source == "a"]
    rate = {s: sum(r.copies for r in rows if r["size"] == s) / 1000 for s in (10, 100)}
    assert rate[10] > rate[100]
    # log rate is proportional to size
    assert math.isclose(math.log(rate[100]) / math.log(rate[10]), 10, rel_tol=0.2)


def test_heavy_tailed_source_of_a_small_target(spark):
    """The tilt of a source that shrinks to a thousandth lies far from where the steps start."""
    sizes = np.maximum(20, 30 * np.exp(2.5 * np.random.default_rng(3).normal(size=4000))).astype(int).tolist()
    docs = [(i, "w " * n, "a") for i, n in enumerate(sizes)] + [(9, "w " * int(0.4995 * sum(sizes)), "b")]
    rows = mix_copies(spark.createDataFrame([(*d, "", 0) for d in docs], SCHEMA), weights=(1, 10**7)).collect()
    target = next(r.target for r in rows if r.source == "a")
    assert 0.0005 < target / sum(sizes) < 0.002
    assert abs(sum(r.copies * r["size"] for r in rows if r.source == "a") - target) <= 10


def test_rows_alike_lose_no_copies(spark):
    """Rows without an id, of one text or of texts of one size, get between them all the copies they were given."""
    docs = [(None, "a b", "a")] * 50 + [(None, f"a {i}", "a") for i in range(50)] + [(3, "c d e", "a")] * 7
    docs += [(9, "w " * 80, "b")]
    df = spark.createDataFrame([(*d, "", 0) for d in docs], SCHEMA)
    copies = defaultdict(int)
    for r in mix_copies(df, weights=(1, 10**7)).collect():
        copies[r.doc_id, r.source, r["size"]] += r.copies
    out = defaultdict(int)
    for r in mixed(df, weights=(1, 10**7)).collect():
        out[r.doc_id, r.source, len(r.text.split())] += 1
    assert dict(out) == {k: n for k, n in copies.items() if n}
    assert 0 < sum(n for k, n in copies.items() if k[0] is None) < 100


def test_classes_beyond_64_bits(spark):
    """Two sources of one class each, of 2e13 words: the tilts end and meet the targets."""
    from findlake.llm.mixing import source_targets, tilts

    hist = spark.createDataFrame([(False, "a", 2_000, 10**10), (False, "b", 2_000, 10**10)],
                                 "no_source boolean, source string, size long, n long")
    sources = hist.selectExpr("no_source", "source", "size * n as source_size")
    rows = tilts(hist, source_targets(sources)).collect()
    assert len(rows) == 2
    for r in rows:
        words = min(3.0, math.exp(r.lam * 2_000 / r["mean"])) * 2_000 * 10**10
        assert math.isclose(words, r.target, rel_tol=1e-6)


def test_alike_rows_share_the_remainder(spark):
    """Rows that agree in everything: together they take their class's copies, however the remainder falls."""
    rows = [(None, "one two three", "a", "s", 1)] * 7 + [(i, f"w{i} x", "b", "s", 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for r in mix_copies(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    have = defaultdict(int)
    for r in mixed(df).collect():
        have[r.doc_id] += 1
    assert dict(have) == {k: v for k, v in want.items() if v}
