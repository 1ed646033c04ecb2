"""Corpus pipeline: five stages from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from findlake.llm import decontaminate, grading, jaccard, mixing, tokenfiles
from findlake.llm.common import shared_path, table


def quality_classifier(spark, docs, sf_dir):
    """Documents that the ordinal classifier, fitted on the labels, rejects go."""
    return grading.selected(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark, docs, sf_dir):
    """One document of each group of near copies (5 words, similarity 0.8) stays."""
    return jaccard.deduplicated(docs)


def decontamination(spark, docs, sf_dir):
    """Documents with a window of a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark, docs, sf_dir):
    """Each document is repeated by the copies that bring its source to its target; none for 0 copies."""
    return mixing.mixed(docs)


def token_output(spark, docs, sf_dir):
    """The documents' token ids in range-coded files, and what the files give back for each."""
    import public_tokenizers

    return tokenfiles.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: The classifier, the Newton iterations and the tokenizer have no SQL form; tests/llm/test_pipeline.py checks the rows.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
