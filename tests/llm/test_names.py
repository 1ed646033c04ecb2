"""Stages that return the columns of their input keep them, also where they have the names that operators use inside."""

import pytest

from findlake.llm import decontaminate, grading, jaccard, mixing
from findlake.llm.common import unused

NAMES = ["_m_copies", "_f_key", "_F_WORD", "_d_items", "_d_ranges", "__d_words", "_g_tail", "_g_expected", "doc", "key", "u",
         "copies", "cut", "base", "more", "size", "no_source", "_r_pid", "nth", "sig", "drop"]


@pytest.fixture(scope="module")
def docs(spark):
    text = lambda i: " ".join(f"w{i % 7}x{j % (11 + i)}" for j in range(30))
    rows = [(i, text(i), "en", "web" if i % 3 else "book", i, *[f"{n}-{i}" for n in NAMES]) for i in range(12)]
    rows += [rows[0], (None, None, None, None, None, *["null"] * len(NAMES))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, schema)


def same_rows(out, docs):
    assert out.columns == docs.columns
    have, want = [tuple(r) for r in out.collect()], [tuple(r) for r in docs.collect()]
    assert have and set(have) <= set(want)
    return have


def test_mixed(docs):
    same_rows(mixing.mixed(docs), docs)


def test_deduplicated(docs):
    assert len(same_rows(jaccard.deduplicated(docs), docs)) == 13


def test_decontaminated(spark, docs):
    bench = spark.createDataFrame([("a", docs.where("doc_id = 5").first().text)], "item_id string, text string")
    assert 5 not in {r[0] for r in same_rows(decontaminate.decontaminated(docs, bench), docs)}


def test_selected(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    same_rows(grading.selected(docs, labels), docs)


def test_unused(docs):
    assert unused(docs, "_d_words", "_d_items") == ["___d_words", "___d_items"] and unused(docs, "_z") == ["_z"]
