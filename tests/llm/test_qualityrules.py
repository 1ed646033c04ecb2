import re

from findlake.llm.qualityrules import judged
from findlake.llm.queries import op10_quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at, hit = {}, set()
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            for i in places:
                hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
            n < 20 or 100 * len(hit) > 30 * n)


def measures(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


GOOD = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
TEXTS = [None, "", " \t\x0b\x0c\r\n ", "one", "a b c d e f g h a b c d e f g h", "x " * 30, GOOD, GOOD + "\n" + GOOD,
         "é𝒳 " * 5 + "## <b> | $5%&*", "l1 a\nl1 a\n\n \nl1 a \nl2", "a b c d", "p q " * 40_000,
         "\n".join(["same line here"] * 60), GOOD.replace(" ", " ## ")]


def test_measures_match_brute_force(spark):
    rows = [(i % 11 if i else None, t, 5, True) for i, t in enumerate(TEXTS + TEXTS)]
    got = judged(spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean")).collect()
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, *measures(r)) for r in got), key=key) == sorted(
        ((r[0], *brute(r[1])) for r in rows), key=key)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_empty_table(spark):
    assert judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_measures_and_agreement_with_labels(spark):
    """Base measures by brute force; without having seen the labels, the verdicts agree with them."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op10_quality_rules(spark, sf).collect()}
    assert len(rows) == len(docs)
    for k, t in docs.items():
        assert measures(rows[k]) == brute(t), k
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    right = [[rows[r.doc_id].kept == bool(r.quality) for r in labels if r.quality == q] for q in (0, 1)]
    assert sum(right[1]) / len(right[1]) >= 0.95 and sum(right[0]) / len(right[0]) >= 0.6


def test_main_path_is_native(spark):
    df = op10_quality_rules(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_more_votes_than_digits(spark):
    """A rule that never votes bad among 120 million documents keeps finite parameters."""
    from pyspark.sql import functions as F

    from findlake.llm.qualityrules import fit_accuracies

    votes = spark.range(120_000_000).select(F.lit(1).alias("v_a"), F.when(F.col("id") % 1000 == 0, -1).otherwise(1).alias("v_b"))
    share, p = fit_accuracies(votes, ["v_a", "v_b"])
    assert all(0 < x < 1 for x in [*share.values(), *p.values()])
