"""Mixing sources to target weights by entropy balancing.

Document rates r stay as close as possible (in relative entropy) to one copy
each, subject to one token constraint per source and r <= cap. The optimum is
an exponential tilt, r = min(cap, exp(lambda_s * size / mean_s)); lambda solves
the convex dual, whose gradient and Hessian Spark sums over all documents
(grouped by source and size) in each Newton step. Sums are exact decimals, so
reruns agree to the bit. Rates become whole copies size by size: each size
class of a source takes the copies that keep the source's running total
nearest the running target, and within a class the copies go to documents in
hash order.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.common import WORD, ranked_within, stored

CAP = 3
_UNIT = 1 << 20


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """``sources`` (no_source, source, source_size) plus ``target``: its share of all words by weight.

    Sources in code point order (null last) weigh ``weights`` in turn. A target
    above ``cap`` times its source's size stops there; the others share the rest
    by weight, until none is above.
    """
    ranked = ranked_within(sources, [], ["no_source", "source"], "nth", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod("nth", F.lit(len(weights))) + 1).cast("int")).cast("double")
    state = stored(ranked.withColumn("weight", weight).withColumn("most", (cap * F.col("source_size")).cast("double")),
                   "mix-weights")
    total = float(state.agg(F.sum("source_size")).first()[0] or 0)
    level = None
    while True:  # each round caps at least one more source
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("most")
        got = state.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("full"),
                        F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        new = (total - (got["full"] or 0.0)) / got["open"] if got["open"] else (level or 0.0)
        if level is not None and new <= level * (1 + 1e-12):
            break
        level = new
    return state.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("most"))).drop("weight", "nth")


def _rate(lam: str, size: str) -> str:
    return f"least({CAP}D, exp({lam} * {size} / mean))"


def tilts(hist: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` plus ``lam`` and ``mean``: the dual's solution by distributed, safeguarded Newton steps.

    ``hist`` has (no_source, source, size, n). A source of no words keeps lam 0;
    one whose target is cap times its size takes every document cap times. The
    steps solve log(words) = log(target) and go on until every source meets its
    target: each eighth halves the bracket, or while the root has no bracket
    goes a reach that doubles from step to step, so they end.
    """
    spark = hist.sparkSession
    hist = hist.where("size > 0").select(F.col("no_source").alias("h_no"), F.col("source").alias("h_source"),
                                         "size", "n")
    on = [F.col("no_source") == F.col("h_no"), F.col("source") == F.col("h_source")]
    stat = hist.groupBy("h_no", "h_source").agg(F.sum("n").alias("docs"), F.min("size").alias("least"))
    state = (targets.join(stat, on, "left").drop("h_no", "h_source")
             .withColumn("mean", F.col("source_size") / F.col("docs"))
             .withColumn("full", F.col("target") >= F.col("most") * (1 - 1e-12))
             .withColumn("lam", F.when(F.col("docs").isNull(), F.lit(0.0))
                         .when(F.col("full"), F.lit(math.log(CAP) + 1e-9) * F.col("mean") / F.col("least"))
                         .otherwise(F.log(F.col("target") / F.col("source_size"))))
             .withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double"))
             .withColumn("done", F.col("docs").isNull() | F.col("full")))
    state = stored(state, "mix-newton")
    for nth in itertools.count():
        stuck = ~((F.col("lam") > F.coalesce("lo", F.lit(-math.inf))) & (F.col("lam") < F.coalesce("hi", F.lit(math.inf))))
        left = state.where(~F.col("done")).agg(F.count("*").alias("n"), F.max(F.when(stuck, F.col("source"))).alias("at")).first()
        if left["at"] is not None:
            raise ArithmeticError(f"no tilt brings source {left['at']!r} to its target")
        if not left["n"]:
            break
        reach = F.lit(2.0 ** min(nth, 1000))
        rate = _rate("lam", "size")
        # Not by floor(), whose BIGINT would saturate from 8.8e12 words of a class.
        exact = lambda e: f"sum(cast({e} * {_UNIT} as decimal(38,0)))"
        sums = (hist.join(state.select("no_source", "source", "lam", "mean", "done").where(~F.col("done")), on)
                .groupBy("h_no", "h_source")
                .agg(F.expr(exact(f"{rate} * size * n")).alias("g"),
                     F.expr(exact(f"if({rate} < {CAP}, {rate} * size * size / mean * n, 0D)")).alias("h")))
        step = (state.join(sums, on, "left").drop("h_no", "h_source")
                .withColumn("f", F.col("g").cast("double") / _UNIT - F.col("target"))
                .withColumn("slope", F.col("h").cast("double") / _UNIT)
                .withColumn("ok", F.col("done") | (F.abs("f") <= F.greatest(F.lit(0.25), 1e-9 * F.col("target"))))
                .withColumn("lo2", F.when(F.col("ok") | (F.col("f") > 0), F.col("lo")).otherwise(F.col("lam")))
                .withColumn("hi2", F.when(F.col("ok") | (F.col("f") <= 0), F.col("hi")).otherwise(F.col("lam")))
                .withColumn("words", F.col("g").cast("double") / _UNIT)
                .withColumn("newton", F.log(F.col("words") / F.col("target")) * F.col("words") / F.col("slope"))
                # Null: no slope to go by, or a round that must narrow the bracket.
                .withColumn("raw", F.when((F.col("slope") > 0) & (F.col("words") > 0) & F.lit(nth % 8 != 7),
                                          F.col("lam") - F.greatest(-reach, F.least(reach, F.col("newton"))))))
        inside = ((F.col("lo2").isNull() | (F.col("raw") > F.col("lo2")))
                  & (F.col("hi2").isNull() | (F.col("raw") < F.col("hi2"))))
        safe = (F.when(F.col("lo2").isNull(), F.col("hi2") - reach).when(F.col("hi2").isNull(), F.col("lo2") + reach)
                .otherwise((F.col("lo2") + F.col("hi2")) / 2))
        new = F.when(F.col("ok"), F.col("lam")).when(inside, F.col("raw")).otherwise(safe)
        keep = [c for c in state.columns if c not in ("lam", "lo", "hi", "done")]
        state = stored(step.select(*keep, new.alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"),
                                   F.col("ok").alias("done")), "mix-newton")
    return state.select("no_source", "source", "source_size", "target", "lam", "mean")


def _nudged(copies: list[int], sizes: list[int], n: list[int], owed: float) -> list[int]:
    """``copies`` after the one or two single-copy moves, if any, that bring a source's words nearest its target.

    Only the 500 smallest size classes move; a source of more classes ends within a word or so of its target anyway.
    """
    at = [i for i in range(len(copies)) if sizes[i]][-500:]
    moves = [(i, d * sizes[i]) for i in at for d in (1, -1) if 0 <= copies[i] + d <= CAP * n[i]]
    if abs(owed) < 1 or not moves:
        return copies
    step = np.array([0, *[m for _, m in moves]])
    left = np.abs(owed - step[:, None] - step[None, :])
    np.fill_diagonal(left[1:, 1:], np.inf)
    a, b = np.unravel_index(np.argmin(left), left.shape)
    if left[a, b] < abs(owed):
        for m in {int(a), int(b)} - {0}:
            i, d = moves[m - 1]
            copies[i] += 1 if d > 0 else -1
    return copies


def _copies_by_size(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for each size class of one source, largest size first, carrying the rounding error on.

    Errors count from the target itself. A class also leaves no more words to
    take than the smaller classes can give, and none too many taken.
    """
    rows = rows.sort_values("size", ascending=False)
    left = float(rows["target"].iloc[0])
    owed, words, out = left - rows["want"].sum(), (rows["size"] * rows["n"]).sum(), []
    for size, n, want in zip(rows["size"], rows["n"], rows["want"]):
        owed += want
        words -= size * n
        k = n
        if size:
            fewest, most = math.ceil((left - CAP * words) / size - 1e-9), math.floor(left / size + 1e-9)
            k = round(owed / size)
            k = max(fewest, min(k, most)) if fewest <= most else round((left - CAP * words / 2) / size)
            k = min(CAP * n, max(0, k))
        owed -= k * size
        left -= k * size
        out.append(k)
    rows["copies"] = _nudged(out, rows["size"].tolist(), rows["n"].tolist(), owed)
    return rows[["no_source", "source", "size", "n", "source_size", "target", "copies"]]


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), key: str = "doc_id", text: str = "text",
               source: str = "source") -> DataFrame:
    """One row per document: key, source, size, source_size, target, copies (0 to 3).

    Size is the text's words (null: 0). Documents without words are taken once,
    at no cost. Null sources form a source of their own; rows of one key are
    rows of their own; an empty table gives no rows. The per-source steps see
    one row per distinct size, never the documents.
    """
    ranked, quota = _classes(docs, weights, key, text, source)
    quota = quota.select(*[F.col(c).alias(f"q_{c}") for c in _CLASS], "n", "source_size", "target", "class_copies")
    copies = F.expr("class_copies div n + if(rank < class_copies % n, 1, 0)").cast("long")
    return (ranked.join(quota, [F.col(c) == F.col(f"q_{c}") for c in _CLASS])
            .select(F.col("key").alias(key), F.when(~F.col("no_source"), F.col("source")).alias(source), "size",
                    "source_size", "target", copies.alias("copies")))


_CLASS = ["no_source", "source", "size"]


def _narrow(docs: DataFrame, key: str, text: str, source: str, *more) -> DataFrame:
    """Each document's class (no_source, source, size) and ``u``, the hash that orders the documents of a class."""
    return docs.select(
        F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(key), F.col(text)).alias("u"), *more)


def _classes(docs: DataFrame, weights: tuple[int, ...], key: str = "doc_id", text: str = "text",
             source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents ranked within their class, one row per class with its n, source_size, target and class_copies)."""
    narrow = stored(_narrow(docs, key, text, source, F.col(key).alias("key")), "mix-narrow")
    ranked = stored(ranked_within(narrow, _CLASS, ["u"], "rank", "mix-rows"), "mix-ranked")
    hist = stored(ranked.groupBy(*_CLASS).agg(F.count("*").alias("n")), "mix-sizes")
    sources = hist.groupBy("no_source", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    found = tilts(hist, source_targets(sources, weights))
    want = (hist.join(found, ["no_source", "source"])
            .withColumn("want", F.expr(f"if(size = 0, 0D, {_rate('lam', 'size')} * size * n)")))
    quota = want.select(*_CLASS, "n", "source_size", "target", "want").groupBy("no_source", "source").applyInPandas(
        _copies_by_size, "no_source boolean, source string, size long, n long, source_size long, target double, "
                         "copies long")
    return ranked, stored(quota.withColumnRenamed("copies", "class_copies"), "mix-copies")


#: Most bytes of class rows that are broadcast to the documents; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The documents of the mix, each repeated by its copies, with the columns of ``docs``, whatever their names.

    A document's copies follow from its class (source and size) and its own
    hash: the class's copies divided by its documents, and one more below the
    hash at which the remainder ends. So documents meet one row per class,
    broadcast within ``BROADCAST_BYTES``, and stay where they are. Rows that
    agree in doc_id and text, where the remainder ends among them, are
    numbered, and the first of them take what is left.
    """
    ranked, quota = _classes(docs, weights)
    quota = quota.withColumn("extra", F.expr("class_copies % n"))
    last = ranked.join(quota.where("extra > 0").select(*_CLASS, "extra"), _CLASS).where("rank = extra")
    ends = last.select(*_CLASS, F.col("u").alias("cut"), "extra")
    # Where alike rows lie on both sides of the end: how many of them still take a copy.
    alike = ranked.join(ends, _CLASS).where("u = cut").groupBy(*_CLASS).agg(
        F.max("cut").alias("cut"), (F.max("extra") - F.min("rank")).alias("more"))
    classes = stored(quota.join(alike, _CLASS, "left").select(
        *[F.col(c).alias(f"q_{c}") for c in _CLASS], F.expr("class_copies div n").alias("base"), "cut",
        F.coalesce("more", F.lit(0)).alias("more")), "mix-classes")
    size = classes.agg(F.sum(F.octet_length("q_source") + 64)).first()[0] or 0
    rows = _narrow(docs, "doc_id", "text", "source", F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    rows = rows.join(F.broadcast(classes) if size <= BROADCAST_BYTES else classes,
                     [F.col(c) == F.col(f"q_{c}") for c in _CLASS])
    below = F.coalesce((F.col("u") < F.col("cut")).cast("long"), F.lit(0))
    tied = F.coalesce((F.col("u") == F.col("cut")) & (F.col("more") > 0), F.lit(False))
    taken = rows.where(~tied).select("doc", (F.col("base") + below).alias("copies"))
    if classes.where("more > 0").limit(1).count():
        numbered = ranked_within(rows.where(tied).select("doc", "base", "more", *_CLASS), _CLASS, [], "nth", "mix-alike")
        taken = taken.unionByName(numbered.select("doc", F.expr("base + if(nth < more, 1, 0)").alias("copies")))
    return (taken.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc.*"))
