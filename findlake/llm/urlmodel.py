"""URL filter by the likelihood ratio of two character language models.

URLs that a rule accepts or rejects train one smoothed variable-order Markov
model each: every context of 0 to ``ORDER`` characters has counts, and a
character's probability backs off through all of them (Witten-Bell weights).
The counts of all labelled URLs are one Spark table, which grows with what the
URLs hold: a row by context and by context with a character, told apart by a
64-bit hash. URLs are scored in blocks; a block asks for its distinct rows in a
join, so neither the driver nor a worker ever holds the table. The score is the
log-likelihood difference per character; its decision line comes from logistic
calibration on URLs that the scoring model has not seen (two-fold, by URL).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.common import bounded_batches, slices, stored

ORDER = 5
#: Bytes of URLs (one URL at least) that are scored together.
BLOCK_BYTES = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BINS, _SPAN = 2000, 10.0  # calibration histogram: scores -10 to 10


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("com", "/", "allow"), UrlRule("example.com", "/en/", "block"),
         UrlRule("www.example.com", "/en/", "allow"), UrlRule("net", "/es/", "block"), UrlRule("net", "/fr/", "block"))


# --- Parts of a URL and rules, native ---

def host_of(url: str) -> Column:
    """From the first :// to /, ?, # or the end, A-Z in lower case; '' for null or no ://."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(raw, upper, upper.lower())


def path_of(url: str) -> Column:
    """What follows the host up to ?, # or the end; '' for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: str, path: str, rules=RULES) -> Column:
    """The longest rule that fits: its host or a subdomain, and a path that starts with the rule's; else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


# --- Hashed contexts of every character ---

def _characters(urls: list[str]):
    """Characters of all URLs, each URL closed by 1 and preceded by ORDER zeros; the mask of scored positions."""
    parts = []
    for u in urls:
        parts += [np.zeros(ORDER, np.uint32), np.frombuffer(u.encode("utf-32-le", "surrogatepass"), np.uint32) + 2,
                  np.ones(1, np.uint32)]
    chars = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return chars.astype(np.uint64), chars > 0


def _hashed(urls: list[str]):
    """For each scored character and order 0..ORDER: key of its context, and of the context with the character."""
    chars, scored = _characters(urls)
    at = np.flatnonzero(scored)
    context = np.full(len(at), 0x51ED27, np.uint64)
    pairs = []
    for k in range(ORDER + 1):
        if k:
            context = (context ^ (chars[at - k] + np.uint64(1))) * _MULT
            context ^= context >> np.uint64(29)
        seed = (context + np.uint64(k)) * _MULT
        both = (seed ^ ((chars[at] + np.uint64(0x1F)) * np.uint64(0xD6E8FEB86659FD93))) * _MULT
        pairs.append((seed.view(np.int64), both.view(np.int64)))
    return pairs, at, chars


def _distinct(pairs):
    """``pairs`` once for each distinct longest context with its character, and the place of each position in them."""
    _, first, place = np.unique(pairs[ORDER][1], return_index=True, return_inverse=True)
    return [(context[first], both[first]) for context, both in pairs], place


def _url_of(at: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The number of the URL of each scored position."""
    closed = np.cumsum(chars == 1)
    return closed[at] - (chars[at] == 1)


class Markov:
    """Counts of one class by sorted key: ``n`` of a context or a context with a character, ``kinds`` of a context's continuations."""

    def __init__(self, n, kinds, keys):
        self.n, self.kinds, self.keys = n, kinds, keys

    def _found(self, keys):
        """The places of ``keys``, and whether each is there."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys

    def log_probabilities(self, pairs) -> np.ndarray:
        p = np.full(len(pairs[0][0]), 1.0 / 256)
        if not len(self.keys):
            return np.log(p)
        for context, both in pairs:
            at, known = self._found(context)
            total, kinds = np.where(known, self.n[at], 0), np.maximum(np.where(known, self.kinds[at], 0), 1)
            at, known = self._found(both)
            p = (np.where(known, self.n[at], 0) + kinds * p) / (total + kinds)
        return np.log(p)


def ratios(urls: list[str], accepted: Markov, rejected: Markov) -> np.ndarray:
    """Log-likelihood difference per character (the end counts as one) of each URL."""
    out = np.zeros(len(urls))
    start = 0
    while start < len(urls):  # a few hundred KB at a time
        end, size = start, 0
        while end < len(urls) and (end == start or size + len(urls[end]) < 400_000):
            size += len(urls[end])
            end += 1
        pairs, at, chars = _hashed(urls[start:end])
        few, place = _distinct(pairs)
        diff = (accepted.log_probabilities(few) - rejected.log_probabilities(few))[place]
        of = _url_of(at, chars)
        out[start:end] = (np.bincount(of, diff, end - start) / np.bincount(of, minlength=end - start))
        start = end
    return out


# --- Distributed counts ---

_SIDES = [(f, r) for f in (0, 1) for r in (0, 1)]
#: (model, class): models 0 and 1 count one fold each, model 2 both together; class 1 is rejected.
_MODELS = [(g, r) for g in (0, 1, 2) for r in (0, 1)]


def _count_batches(batches):
    """(fold, rejected, context, pair, n): the distinct contexts with a character of a slice of URLs."""
    for whole in batches:
        for batch in slices(whole, "url", 1 << 20):
            urls = np.array([u or "" for u in batch.column(0).to_pylist()], object)
            side = 2 * batch.column(1).to_numpy() + batch.column(2).to_numpy()
            for s in np.unique(side):
                few, place = _distinct(_hashed(list(urls[side == s]))[0])
                context, both = (np.concatenate([p[i] for p in few]) for i in (0, 1))
                pair, first, of = np.unique(both, return_index=True, return_inverse=True)
                n = np.bincount(of, np.tile(np.bincount(place), ORDER + 1)).astype(np.int64)
                like = lambda x: pa.array(np.full(len(pair), x, np.int32))  # noqa: E731, B023
                yield pa.RecordBatch.from_pydict({"fold": like(s // 2), "rejected": like(s % 2),
                                                  "context": pa.array(context[first]), "pair": pa.array(pair),
                                                  "n": pa.array(n)})


def counts_of(labelled: DataFrame) -> DataFrame:
    """(key, n<model><class>, k<model><class>) over all of ``labelled`` (url, fold, rejected).

    One row by context (n: its characters, k: kinds of them) and one by context
    with a character (n: how often). The table grows with the URLs' contexts.
    """
    found = labelled.select("url", F.col("fold").cast("int"), F.col("rejected").cast("int")).mapInArrow(
        _count_batches, "fold int, rejected int, context long, pair long, n long")
    pairs = stored(found.groupBy("context", "pair").agg(*[
        F.sum(F.when((F.col("fold") == f) & (F.col("rejected") == r), F.col("n")).otherwise(0)).alias(f"n{f}{r}")
        for f, r in _SIDES]), "url-pairs")
    pairs = pairs.withColumns({f"n2{r}": F.col(f"n0{r}") + F.col(f"n1{r}") for r in (0, 1)})
    contexts = pairs.groupBy(F.col("context").alias("key")).agg(
        *[F.sum(f"n{g}{r}").alias(f"n{g}{r}") for g, r in _MODELS],
        *[F.sum((F.col(f"n{g}{r}") > 0).cast("long")).alias(f"k{g}{r}") for g, r in _MODELS])
    pairs = pairs.select(F.col("pair").alias("key"), *[f"n{g}{r}" for g, r in _MODELS],
                         *[F.lit(0).cast("long").alias(f"k{g}{r}") for g, r in _MODELS])
    return stored(contexts.unionByName(pairs), "url-counts")


def _local(counts: DataFrame) -> dict:
    """(model, class) -> (n, kinds, keys) of a whole table of counts, on the driver: for small ones only."""
    pdf = counts.toPandas().sort_values("key")
    column = lambda c: pdf[c].to_numpy()
    return {(g, r): (column(f"n{g}{r}"), column(f"k{g}{r}"), column("key")) for g, r in _MODELS}


def count_tables(labelled: DataFrame) -> dict:
    """``counts_of`` a few URLs as the arguments of ``Markov`` by (model, class)."""
    return _local(counts_of(labelled))


# --- Distributed scores ---

def _blocks(batches):
    """The rows plus ``block``: rows of one model with about ``BLOCK_BYTES`` of URLs."""
    block = TaskContext.get().partitionId() << 33
    for whole in batches:
        for batch in slices(whole, "url", BLOCK_BYTES):
            model = batch.column(batch.schema.get_field_index("model")).to_numpy()
            for m in np.unique(model):
                own = batch.filter(pa.array(model == m))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(own.num_rows, block, np.int64))],
                                                 [*own.schema.names, "block"])
                block += 1


def _asked(batches):
    """(block, model, key): the distinct keys of a block's contexts, with and without their characters."""
    for whole in batches:
        for batch in slices(whole, "url", BLOCK_BYTES):
            urls = np.array([u or "" for u in batch.column(0).to_pylist()], object)
            model, block = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for b in np.unique(block):
                few, _ = _distinct(_hashed(list(urls[block == b]))[0])
                keys = np.unique(np.concatenate([k for p in few for k in p]))
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(keys), b, np.int64)),
                                                  "model": pa.array(np.full(len(keys), model[block == b][0], np.int32)),
                                                  "key": pa.array(keys)})


def _block_scorer(kept: list[str]):
    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        key = counts["key"].to_numpy()
        order = np.argsort(key)
        models = [Markov(counts[f"n{r}"].to_numpy()[order], counts[f"k{r}"].to_numpy()[order], key[order])
                  for r in (0, 1)]
        score = ratios([u or "" for u in rows["url"].to_pylist()], *models)
        return rows.select(kept).append_column("score", pa.array(score, pa.float64()))
    return run


def scored(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """The columns of ``urls`` but url and model (0 to 2: which counts), plus ``score``: the ratio of each URL.

    A key that all URLs share is asked for once a block, not once a URL.
    """
    kept = [f for f in urls.schema.fields if f.name not in ("url", "model")]
    blocks = stored(urls.mapInArrow(_blocks, T.StructType([*urls.schema.fields, T.StructField("block", T.LongType())])),
                    "url-blocks")
    asked = blocks.select("url", "model", "block").mapInArrow(_asked, "block long, model int, key long")
    of = lambda c, r: F.element_at(F.array(*[f"{c}{g}{r}" for g in (0, 1, 2)]), F.col("model") + 1)
    # Compressed files say little about the rows they give: never a broadcast here.
    found = asked.hint("merge").join(counts, "key").select(
        "block", "key", *[of(c, r).alias(f"{c}{r}") for c in "nk" for r in (0, 1)])
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        _block_scorer([f.name for f in kept]), T.StructType([*kept, T.StructField("score", T.DoubleType())]))


def calibrate(hist: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression on a score histogram (2 x bins: accepted, rejected), classes weighed alike."""
    x = (np.arange(_BINS) + 0.5) / _BINS * 2 * _SPAN - _SPAN
    w = hist / np.maximum(hist.sum(1, keepdims=True), 1)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        both = w.sum(0)
        g = np.array([((p * both - w[0]) * x).sum() + 1e-3 * a, (p * both - w[0]).sum()])
        v = both * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-10:
            break
    return float(a), float(b)


@dataclass
class UrlModel:
    """A fitted filter; without URLs of both classes it is ``only`` a constant verdict."""

    counts: DataFrame | None = None
    slope: float = 1.0
    offset: float = 0.0
    only: str | None = None

    @property
    def accepted(self) -> Markov:
        """The accepted URLs' model, brought to the driver: for small ones only."""
        return Markov(*_local(self.counts)[2, 0])

    @property
    def rejected(self) -> Markov:
        """The rejected URLs' model, brought to the driver: for small ones only."""
        return Markov(*_local(self.counts)[2, 1])


def fit(labelled: DataFrame) -> UrlModel:
    """Fit on all rows of ``labelled`` (url, rejected 0/1). Null URLs count as empty.

    With URLs of one class only, or none, the model gives that class (none: allow) for every URL.
    """
    data = labelled.select(F.coalesce("url", F.lit("")).alias("url"), F.col("rejected").cast("int").alias("rejected"))
    classes = {r["rejected"] for r in data.select("rejected").distinct().collect()}
    if len(classes) < 2:
        return UrlModel(only="block" if classes == {1} else "allow")
    data = data.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(2)).cast("int"))
    counts = counts_of(data)
    # Each fold is scored by the other's counts.
    found = scored(data.select("url", (1 - F.col("fold")).alias("model"), "rejected"), counts)
    width = 2 * _SPAN / _BINS
    bin_ = F.least(F.lit(_BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + _SPAN) / width))).cast("int")
    hist = np.zeros((2, _BINS))
    for row in found.groupBy("rejected", bin_.alias("bin")).count().collect():
        hist[row["rejected"], row["bin"]] = row["count"]
    slope, offset = calibrate(hist)
    return UrlModel(counts, slope, offset)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """One row per page: key, host, path, rule, verdict (allow or block), score.

    A page that a rule fits has its verdict and no score; the rules' verdicts
    train the model that judges all other pages by the calibrated score (allow
    at a probability of one half or more). Null and empty URLs are judged as
    empty ones. Equal URLs get equal verdicts.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    parts = (pages.select(F.col(key).alias("id"), F.col(url).alias("url"))
             .withColumn("host", host_of("url")).withColumn("path", path_of("url"))
             .withColumn("rule", rule_of("host", "path", rules)))
    parts = stored(parts, "urls")
    verdict = F.lit(None).cast("string")
    for r in rules:
        verdict = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(verdict)
    ruled = parts.where("rule is not null").withColumn("verdict", verdict).withColumn("score", F.lit(None).cast("double"))
    model = fit(ruled.select("url", (F.col("verdict") == "block").cast("int").alias("rejected")))
    rest = parts.where("rule is null")
    names = ["id", "host", "path", "rule", "verdict", "score"]
    if model.only:
        judged = rest.withColumn("verdict", F.lit(model.only)).withColumn("score", F.lit(None).cast("double"))
    else:
        judged = scored(rest.select(F.coalesce("url", F.lit("")).alias("url"), F.lit(2).alias("model"), "id", "host",
                                    "path", "rule"), model.counts)
        judged = judged.withColumn("score", F.col("score") * model.slope + model.offset).withColumn(
            "verdict", F.when(F.col("score") >= 0, F.lit("allow")).otherwise(F.lit("block")))
    return ruled.select(*names).unionByName(judged.select(*names)).withColumnRenamed("id", key)
