import random
import re

import numpy as np
import pytest

from findlake.llm import grading as G
from findlake.llm.queries import op7_ordinal_quality

WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def slow_tokens(text):
    """Distinct tokens of one text with plain regular expressions."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return set(re.findall(r"[0-9a-z\x80-\U0010ffff]+|[#*$%&|<>@_~^=+\\/{}\[\]`]+", folded))


def test_features_are_distinct_tokens():
    texts = ["", "Ab ab, AB. c## ## d", "é" * 5000 + " x", "a\nb\tc", "***", "." * 100]
    text, weight = G.features([t.encode() for t in texts])
    got = np.bincount(text, minlength=len(texts))
    assert list(got) == [len(slow_tokens(t)) + 3 for t in texts]
    alone = [set(G.features([t.encode()])[1].tolist()) for t in texts]
    assert [set(weight[text == i].tolist()) for i in range(len(texts))] == alone
    assert alone[1] != alone[3] and G.features([])[0].size == 0


def test_slopes_match_differences():
    rng = np.random.default_rng(1)
    score, grade, cuts = rng.normal(size=40), rng.integers(0, 3, 40), np.array([-0.4, 0.9])
    loss, by_score, by_cut = G.loss_and_slopes(score, grade, cuts)
    for k in range(2):
        step = np.eye(2)[k] * 1e-6
        assert np.isclose((G.loss_and_slopes(score, grade, cuts + step)[0] - loss) / 1e-6, by_cut[k], atol=1e-5)
    step = np.eye(40)[3] * 1e-6
    assert np.isclose((G.loss_and_slopes(score + step, grade, cuts)[0] - loss) / 1e-6, by_score[3] / 40, atol=1e-5)


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=60)
        kind = rng.choice([0, 1, 2, 2, 2])
        words += {0: ["vile", "awful"], 1: ["***", "##"], 2: []}[kind]
        rng.shuffle(words)
        rows.append((i, " ".join(words), "x", 0.5))
        labels.append((i, int(kind != 1), int(kind == 0)))
    return rows, labels


SCHEMA, LABELS = "doc_id long, text string, kept string, p_good double", "doc_id long, quality int, toxic int"


def test_held_out_accuracy_and_order(spark):
    rows, labels = corpus(1500, 3)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in G.classified(docs, spark.createDataFrame(labels[:1000], LABELS)).collect()}
    held = labels[1000:]
    right = sum(got[i].kept == (q == 1 and t == 0) for i, q, t in held)
    assert right / len(held) >= 0.95
    mean = lambda k: np.mean([got[i].expected_grade for i, q, t in held if (0 if t else 1 if not q else 2) == k])
    assert mean(0) < mean(1) < mean(2)
    kept = G.selected(docs, spark.createDataFrame(labels[:1000], LABELS))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}


def test_nulls_ties_and_missing_ratings(spark):
    rows = [(None, None, "", 0.0), (1, "", "", 0.0), (1, "", "", 0.0), (2, "a " * 100_000, "", 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = G.classified(docs, spark.createDataFrame([(None, 1, 0), (7, None, None)], LABELS)).collect()
    assert len(none) == 4 and all(r.kept and r.p_good is None for r in none)
    some = G.classified(docs, spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, None)], LABELS)).collect()
    assert len(some) == 4 and all(0 <= r.p_good <= 1 for r in some)
    assert G.classified(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_query_on_labelled_rows(spark, sf):
    rows = {r.doc_id: r for r in op7_ordinal_quality(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    clean = [rows[r.doc_id].kept for r in labels if r.quality == 1 and r.toxic == 0]
    bad = [rows[r.doc_id].kept for r in labels if r.toxic == 1]
    assert np.mean(clean) >= 0.98 and np.mean(bad) <= 0.1


def test_bounded_sample_generalises(spark):
    """Fitted on half of the rated rows, the other half is held out."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.kept for r in G.classified(docs, labels.where("doc_id % 2 = 0")).collect()}
    rest = labels.where("doc_id % 2 = 1").collect()
    clean = np.mean([got[r.doc_id] for r in rest if r.quality == 1 and r.toxic == 0])
    toxic = np.mean([got[r.doc_id] for r in rest if r.toxic == 1])
    assert clean >= 0.95 and toxic <= 0.5


def test_rows_of_one_id_reach_the_driver_once(spark, monkeypatch):
    """A rated id of many texts is one document of the sample, the same whatever the order of rows."""
    rows, labels = corpus(60, 4)
    rows += [(1, f"{WORDS[i]} {WORDS[-i]}", "x", 0.5) for i in range(80)]
    docs, grades = spark.createDataFrame(rows, SCHEMA), G.grades_of(spark.createDataFrame(labels, LABELS))
    got, whole = [], type(docs).toPandas
    monkeypatch.setattr(type(docs), "toPandas", lambda self: got.append(whole(self)) or got[-1])
    models = [G.fit(d, grades, 20_000) for d in (docs, spark.createDataFrame(rows[::-1], SCHEMA))]
    assert [len(g) for g in got] == [60, 60]
    assert np.array_equal(models[0].weights, models[1].weights)
