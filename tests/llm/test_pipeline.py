"""Every stage against a brute-force version on its own input, and run() against the stages."""
import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline as P  # noqa: E402
import test_decontaminate as leaks  # noqa: E402
import test_jaccard as near  # noqa: E402
import test_mixing as mix  # noqa: E402
import test_tokenfiles as tokens  # noqa: E402

from findlake.llm import grading, mixing  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(input rows, output DataFrame)] of each stage."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_classifier_rejects_toxic_and_keeps_clean(spark, stages):
    docs, out = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert out.columns == docs.columns
    verdicts = {r.doc_id for r in grading.classified(docs, labels).collect() if r.kept}
    kept = {r.doc_id for r in out.collect()}
    assert kept == verdicts
    clean = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    assert len(clean & kept) / len(clean) >= 0.98


def test_one_of_each_group_stays(stages):
    docs, out = stages[1]
    want = sorted(k for (k, n, c) in near.brute(pairs(docs)) if k == c)
    assert out.columns == docs.columns and sorted(k for k, _ in pairs(out)) == want


def test_contaminated_documents_go(spark, stages):
    docs, out = stages[2]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = leaks.brute(pairs(docs), bench)
    assert any(r[-1] for r in rows)
    assert out.columns == docs.columns and sorted(k for k, _ in pairs(out)) == sorted(r[0] for r in rows if not r[-1])


def test_mix_meets_targets(stages):
    docs, out = stages[3]
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    copies = mixing.mix_copies(docs).collect()
    want, taken = mix.check(rows, copies)
    for s in want:
        assert abs(taken[s] - want[s]) <= max(10, 0.01 * want[s])
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in copies if r.copies})


def test_files_give_back_all_ids(stages):
    docs, out = stages[4]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out.collect())
    assert got == sorted(tokens.brute(pairs(docs)))


def test_run_is_the_stages(spark, stages):
    got = sorted(map(tuple, P.run(spark, SF).collect()))
    assert got == sorted(map(tuple, stages[-1][1].collect()))
