"""Quality rules combined by weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains. The votes of all documents are counted
by pattern (a bounded table), expectation-maximisation over these counts
estimates each rule's accuracies without labels, and a document's posterior
probability of good quality replaces "every rule must pass".
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.llm.common import SPACE, WORD, stored

#: Words in the windows whose repetition counts.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MAX_EM = 30


# --- Measures of one text ---

def _shifted(a: str, by: int) -> tuple[Column, Column]:
    """Column ``a`` without its last ``by`` elements, and without its first."""
    rest = F.greatest(F.lit(0), F.size(a) - by)
    return F.slice(a, 1, rest), F.slice(a, F.lit(by + 1), rest)


def _hash_pairs(a: str, by: int) -> Column:
    return F.zip_with(*_shifted(a, by), lambda x, y: F.xxhash64(x, y))


def with_repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """``df`` plus ``out``: words in windows of 8 that occur twice or more in array ``words`` (first included).

    Windows are compared by a 64-bit hash, built in three doublings of word
    hashes. Only a text that repeats a window is sorted: equal neighbours
    repeat, and a repeating window adds the words that the one before it has
    not covered. Each step is a column of its own, so that it is evaluated once.
    """
    keep = df.columns
    step = df.withColumn("_q1", F.transform(words, lambda w: F.xxhash64(w)))
    for width in (1, 2, 4):
        step = step.select(*keep, _hash_pairs(f"_q{width}", width).alias(f"_q{2 * width}"))
    step = step.select(*keep, F.when(F.size(F.array_distinct("_q8")) < F.size("_q8"), F.sort_array(
        F.transform("_q8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_placed"))
    twins = F.zip_with(*_shifted("_placed", 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    at = F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    covered = F.aggregate(
        at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, x: F.struct((s["n"] + F.least(F.lit(WINDOW), x - s["last"])).alias("n"), x.alias("last")),
        lambda s: s["n"])
    return step.select(*keep, F.coalesce(covered, F.lit(0).cast("long")).alias(out))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id and the measures of its whole text (null: as empty)."""
    base = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = base.select("id", "t", F.filter(F.split("t", SPACE), lambda w: w != "").alias("words"),
                        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    removed = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    sized = split.select(
        "id", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        removed(SYMBOLS).cast("long").alias("n_symbols"), removed("0123456789").cast("long").alias("n_digits"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))
    return with_repeat_words(sized, "words", "n_repeat_words").drop("words")


# --- Rules: good (1), bad (-1) or abstain (0) ---

def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")


def rule_votes() -> dict[str, Column]:
    """The rules over the measures. A text without words is bad by length, and the others abstain or follow suit."""
    n, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    some, mean = n >= 1, chars / F.greatest(n, F.lit(1))
    part = lambda c, of: F.col(c) / F.greatest(of, F.lit(1))
    dup, repeat = part("n_dup_lines", F.col("n_lines")), part("n_repeat_words", n)
    distinct = part("n_distinct", n)
    return {
        "length": _vote(n >= 50, n < 20),
        "symbols": _vote(some & (part("n_symbols", chars) <= 0.01), part("n_symbols", chars) >= 0.05),
        "word_length": _vote(some & mean.between(4.0, 6.5), some & ((mean < 3) | (mean > 9))),
        "lines": _vote((F.col("n_lines") >= 2) & (dup <= 0.05), dup >= 0.5),
        "repeats": _vote((n >= 20) & (repeat <= 0.05), repeat > 0.3),
        "variety": _vote((n >= 50) & (distinct >= 0.3), (n >= 50) & (distinct < 0.1)),
        "digits": _vote(some & (part("n_digits", chars) <= 0.05), part("n_digits", chars) >= 0.3),
    }


# --- Expectation-maximisation over vote patterns ---
#
# A document is good, or bad in the way one of the rules looks for; each of
# these kinds has its own accuracy of every rule. (With a single bad kind the
# most frequent sort of junk claims it, and other junk counts as good.)

GOOD = "good"


def _with_parts(df: DataFrame, rules: list[str], share: dict, p: dict) -> DataFrame:
    """``df`` plus ``part_<kind>``: the probability of each kind given the votes; abstentions say nothing.

    The parameters form one array that the votes index, so that each step runs the same generated code.
    """
    kinds, table = [GOOD, *rules], []
    for z in kinds:
        for k, r in enumerate(rules):
            first = math.log(share[z]) if k == 0 else 0.0
            table += [first + math.log(p[r, z]), first, first + math.log(1 - p[r, z])]  # for votes -1, 0, 1
    logs, out = F.array(*[F.lit(x) for x in table]), df
    for j, z in enumerate(kinds):
        at = lambda k: F.get(logs, F.col(rules[k]) + (3 * (j * len(rules) + k) + 1))  # noqa: E731, B023
        out = out.withColumn(f"_e_{z}", F.exp(sum((at(k) for k in range(1, len(rules))), at(0))))
    total = sum((F.col(f"_e_{z}") for z in kinds), F.lit(0.0))
    return out.select(*df.columns, *[(F.col(f"_e_{z}") / total).alias(f"part_{z}") for z in kinds])


def _probability(x: float) -> float:
    """``x`` to nine significant digits, away from 0 and 1, whose logarithms count for any number of votes."""
    return min(max(float(f"{x:.9g}"), 1e-9), 1 - 1e-9)


def fit_accuracies(votes: DataFrame, rules: list[str]) -> tuple[dict, dict]:
    """({kind: share of documents}, {(rule, kind): probability of a bad vote given that the rule votes}).

    ``votes`` is grouped to at most 3 ** len(rules) patterns, which Spark sums
    anew in each step; the driver holds the parameters alone. The start takes
    votes at their word: a document with bad votes is probably bad in one of
    these ways. A rule's bad vote never becomes evidence of good quality.
    """
    patterns = votes.groupBy(*rules).agg(F.count("*").alias("n"))
    # A row for each pattern and rule, so that one small aggregate gives all sums of a step.
    patterns = stored(patterns.withColumn("cast", F.explode(F.array(*[
        F.struct(F.lit(k).alias("rule"), F.col(r).alias("vote")) for k, r in enumerate(rules)]))), "vote-patterns")
    kinds = [GOOD, *rules]
    n_bad = sum((F.when(F.col(r) == -1, 1).otherwise(0) for r in rules), F.lit(0))
    parts = patterns.withColumn(f"part_{GOOD}", F.when(n_bad == 0, 0.99).otherwise(0.2))
    for r in rules:
        parts = parts.withColumn(f"part_{r}", F.when(n_bad == 0, 0.01 / len(rules))
                                 .when(F.col(r) == -1, 0.8 / n_bad).otherwise(0.0))
    share, p, last = {z: 1 / len(kinds) for z in kinds}, {(r, z): 0.5 for r in rules for z in kinds}, None
    for _ in range(MAX_EM):
        sums = {(row["rule"], row["vote"]): row for row in parts.groupBy("cast.rule", "cast.vote").agg(
            *[F.sum(F.col(f"part_{z}") * F.col("n")).alias(z) for z in kinds]).collect()}
        if not sums:
            break
        at = lambda k, v, z: sums[k, v][z] if (k, v) in sums else 0.0  # noqa: E731, B023
        size = {z: sum(at(0, v, z) for v in (-1, 0, 1)) + 1e-3 for z in kinds}
        share = {z: _probability(size[z] / sum(size.values())) for z in kinds}
        for k, r in enumerate(rules):
            for z in kinds:
                p[r, z] = _probability((at(k, -1, z) + 0.05) / (at(k, -1, z) + at(k, 1, z) + 1))
            p[r, r] = max(p[r, r], 0.5)
            for z in rules:
                p[r, z] = max(p[r, z], p[r, GOOD])
        parts = _with_parts(patterns, rules, share, p)
        now = [*share.values(), *p.values()]
        if last and max(abs(a - b) for a, b in zip(now, last)) < 1e-3:
            break
        last = now
    else:
        warnings.warn(f"expectation-maximisation still moves after {MAX_EM} steps", stacklevel=2)
    return share, p


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, the measures, base_failed, posterior, kept.

    Null and empty texts have no words and fail the base rule; equal texts get
    equal verdicts; an empty table gives no rows.
    """
    rules = rule_votes()
    measures = stored(measured(docs, key, text), "quality-measures")
    votes = measures.select(*[c.alias(f"v_{r}") for r, c in rules.items()])
    names = [f"v_{r}" for r in rules]
    share, p = fit_accuracies(votes, names)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = measures.select("*", *[c.alias(f"v_{r}") for r, c in rules.items()])
    out = (_with_parts(out, names, share, p).withColumn("posterior", F.col(f"part_{GOOD}"))
           .withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col(f"part_{GOOD}") >= 0.5)))
    return out.select(F.col("id").alias(key), *measures.columns[1:], "base_failed", "posterior", "kept")
