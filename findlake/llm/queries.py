"""The registered queries of the operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from findlake.llm import (collocations, convrepair, decontaminate, grading, jaccard, linededup, mixing, qualityrules,
                          secrets, sharding, tokenfiles, toolchat, urlmodel)
from findlake.llm.common import table
from findlake.llm.oracle import ORACLE_SQL  # noqa: F401


def op1_tool_chat(spark, sf_dir):
    return toolchat.formatted(*toolchat.implied(table(spark, sf_dir, "conversations")), toolchat.SCHEMAS)


def op2_token_files(spark, sf_dir):
    import public_tokenizers

    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_secrets(spark, sf_dir):
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op4_jaccard_join(spark, sf_dir):
    return jaccard.linked_components(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark, sf_dir):
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op7_ordinal_quality(spark, sf_dir):
    return grading.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_model(spark, sf_dir):
    return urlmodel.judge(table(spark, sf_dir, "pages"))


def op9_mixing(spark, sf_dir):
    mix = mixing.mix_copies(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_quality_rules(spark, sf_dir):
    return qualityrules.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "posterior")


def op11_collocations(spark, sf_dir):
    return collocations.top_collocations(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark, sf_dir):
    convs = table(spark, sf_dir, "conversations")
    return convrepair.digest(convs, *convrepair.repaired(convrepair.damaged(convs)))


def op13_line_dedup(spark, sf_dir):
    kept = linededup.kept_texts(table(spark, sf_dir, "documents"), min_docs=10, keep_first=False)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {name: fn for name, fn in sorted(globals().items()) if name.startswith("op") and callable(fn)}
