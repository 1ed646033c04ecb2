"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds cut the score: P(grade <= k) = logistic(threshold_k - score). It
gives an expected grade and tail probabilities P(grade >= k), by which
documents are selected. Features are the distinct tokens of the whole text and
a few bucketed measures, all hashed into ``DIM`` weights. The model is fitted
on at most ``MAX_TRAIN`` rated documents, taken in hash order of their ids;
every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.common import bounded_batches, slices, tidy, unused, utf8

DIM = 1 << 18
#: Bound of the training sample (rated documents); about 1 KB of features each reach the driver.
MAX_TRAIN = 20_000
EPOCHS = 24
GRADES = 3
#: Grades: 0 toxic, 1 low quality, 2 good. Documents of an expected tail P(grade >= GOOD) of one half or more stay.
GOOD = 2

_SYMBOLS = b"#*$%&|<>@_~^=+\\/{}[]`"
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_CLASS = np.zeros(256, np.uint8)
_CLASS[[b for b in range(256) if b >= 0x80 or chr(b).isalnum()]] = 1
_CLASS[list(_SYMBOLS)] = 2
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(DIM)).astype(np.int64)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, weight number) of each distinct feature of each text, by text.

    Tokens are runs of letters and digits (A-Z folded, any byte from 0x80 on
    counts as a letter) and runs of symbols. Measures: size, share of distinct
    words and mean word length, in steps.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(t + b" " for t in texts).translate(_FOLD), np.uint8)
    of_text = np.repeat(np.arange(len(texts)), lengths + 1)
    kind = _CLASS[data]
    edge = size = np.zeros(0, np.int64)
    sums = np.zeros(0, np.uint64)
    if len(data):
        edge = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))  # every run, separators too
        size = np.diff(np.append(edge, len(data)))
        at = np.arange(len(data)) - np.repeat(edge, size)
        sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _POWERS[at & 63], edge)
        run = kind[edge] != 0
        edge, size, sums = edge[run], size[run], sums[run] + size[run].astype(np.uint64)
    text = of_text[edge]
    key = np.unique(text * DIM + _mixed(sums))
    word = kind[edge] == 1
    n = len(texts)
    words = np.bincount(text[word], minlength=n)
    chars = np.bincount(text[word], size[word], minlength=n)
    distinct = np.bincount(key // DIM, minlength=n)
    steps = np.stack([np.log2(1 + words).astype(np.int64),
                      (10 * distinct / np.maximum(words, 1)).astype(np.int64).clip(0, 20),
                      (2 * chars / np.maximum(words, 1)).astype(np.int64).clip(0, 40)], 1)
    extra = _mixed((steps + np.array([1, 2, 3]) * 1000).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    key = np.unique(np.concatenate([key, (np.arange(n)[:, None] * DIM + extra).ravel()]))
    return key // DIM, key % DIM


@dataclass
class OrdinalModel:
    """Weights and ordered thresholds; ``weights`` None: nothing was rated, every document keeps its place."""

    weights: np.ndarray | None
    thresholds: np.ndarray

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k = 0 .. GRADES - 2, by row."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        text, weight = features(texts)
        return np.bincount(text, self.weights[weight], minlength=len(texts))


def loss_and_slopes(score: np.ndarray, grade: np.ndarray, thresholds: np.ndarray):
    """Mean negative log-likelihood, its derivative by each score, and by each threshold."""
    n, rows = len(score), np.arange(len(score))
    cut = np.concatenate([[-np.inf], thresholds, [np.inf]])
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    hi, lo = sig(cut[grade + 1] - score), sig(cut[grade] - score)
    hi[grade == len(thresholds)], lo[grade == 0] = 1.0, 0.0
    p = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
    slope = np.zeros(len(thresholds) + 2)
    np.add.at(slope, grade + 1, -dhi)
    np.add.at(slope, grade, dlo)
    return float(-np.log(p).mean()), (dhi - dlo)[rows], slope[1:-1] / n


def train(starts: np.ndarray, weight_of: np.ndarray, grade: np.ndarray) -> OrdinalModel:
    """Adaptive-gradient descent over documents in a fixed random order; document i has
    features ``weight_of[starts[i]:starts[i + 1]]``."""
    rng, n = np.random.default_rng(7), len(grade)
    # A feature of a handful of documents would only memorise them.
    common = np.bincount(weight_of, minlength=DIM) >= max(5, n // 500)
    doc = np.repeat(np.arange(n), np.diff(starts))[common[weight_of]]
    starts, weight_of = np.searchsorted(doc, np.arange(n + 1)), weight_of[common[weight_of]]
    w, seen = np.zeros(DIM), np.full(DIM, 1e-6)
    base, gap, tseen = -1.0, np.zeros(GRADES - 2), np.full(GRADES - 1, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            docs = order[at:at + 64]
            size = starts[docs + 1] - starts[docs]
            of = np.repeat(np.arange(len(docs)), size)
            idx = weight_of[np.repeat(starts[docs] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            thresholds = base + np.concatenate([[0.0], np.cumsum(np.exp(gap))])
            _, by_score, by_cut = loss_and_slopes(np.bincount(of, w[idx], minlength=len(docs)), grade[docs], thresholds)
            used, where = np.unique(idx, return_inverse=True)
            g = np.bincount(where, by_score[of]) + 2e-3 * len(docs) * w[used]
            seen[used] += g * g
            w[used] -= 0.1 * g / np.sqrt(seen[used])
            tail = np.cumsum(by_cut[::-1])[::-1] * len(docs)  # every later threshold moves with an earlier one
            tail[1:] *= np.exp(gap)
            tseen += tail * tail
            step = 0.1 * tail / np.sqrt(tseen)
            base, gap = base - step[0], np.clip(gap - step[1:], -6, 6)
    return OrdinalModel(w.astype(np.float32), base + np.concatenate([[0.0], np.cumsum(np.exp(gap))]))


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 low quality, 2 good. Rows without id or rating fall out; repeated ids keep the lowest."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return (labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null")
            .groupBy("doc_id").agg(F.min("grade").alias("grade")))


def _featured(batches):
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            text, weight = features(utf8(batch.column(0)))
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            rows = [weight[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.binary())],
                                             ["doc_id", "grade", "at", "weights"])


def fit(docs: DataFrame, grades: DataFrame, max_train: int = MAX_TRAIN) -> OrdinalModel:
    """Fit on the rated documents of ``docs`` (doc_id, text), at most ``max_train`` ids in hash order.

    Of rows that repeat an id only the first text in hash order counts, and reaches the driver.
    """
    bounded_batches(docs.sparkSession)
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "text", "doc_id", "grade", F.xxhash64("text").alias("at")).mapInArrow(
        tidy(_featured), f"doc_id {kind}, grade int, at long, weights binary")
    one = sample.groupBy("doc_id").agg(F.min(F.struct("grade", "at", "weights")).alias("row"))
    rows = one.select("doc_id", "row.grade", "row.weights").toPandas().sort_values("doc_id", kind="stable")
    if not len(rows):
        return OrdinalModel(None, np.zeros(GRADES - 1))
    parts = [np.frombuffer(x, "<i4") for x in rows["weights"]]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return train(starts, np.concatenate(parts).astype(np.int64), rows["grade"].to_numpy(np.int64))


def graded(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``_g_expected`` and ``_g_tail`` = P(grade >= GOOD) of each whole text.

    Null texts count as empty; without a fitted model both are null. Where ``docs`` has columns of these names, the two
    get more underscores; they are the last ones in any case.
    """
    at = docs.columns.index(text)
    new = unused(docs, "_g_expected", "_g_tail")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in new]])
    if model.weights is None:
        return docs.select("*", *[F.lit(None).cast("double").alias(n) for n in new])
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = broadcast.value
        for whole in batches:
            for batch in slices(whole, whole.schema.names[at], 1 << 20):
                below = model.below(model.scores(utf8(batch.column(at))))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array((1 - below).sum(1)), pa.array(1 - below[:, GOOD - 1])], schema.fieldNames())

    return docs.mapInArrow(tidy(run), schema)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, expected_grade, p_good, kept (p_good of one half or more, or no rating at all)."""
    only = docs.select("doc_id", "text")
    found = graded(only, fit(only, grades_of(labels)))
    return found.select("doc_id", F.col("_g_expected").alias("expected_grade"), F.col("_g_tail").alias("p_good"),
                        (F.coalesce("_g_tail", F.lit(1.0)) >= 0.5).alias("kept"))


def selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with the columns of ``docs``, whatever their names."""
    found = graded(docs, fit(docs.select("doc_id", "text"), grades_of(labels)))
    return found.where(F.coalesce(found.columns[-1], F.lit(1.0)) >= 0.5).select(*docs.columns)
