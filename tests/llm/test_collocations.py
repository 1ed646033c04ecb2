import random
import re
from collections import Counter, defaultdict

import pytest

from findlake.llm.collocations import collocations, top_collocations

SCHEMA = "doc_id long, text string, lang string, block string, id string, f string"
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, limit, least, longest):
    f = defaultdict(Counter)
    for r in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f["und" if r[2] is None else r[2]].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, n in f.items():
        total, found = sum(v for p, v in n.items() if len(p) == 1), []
        cands = {p: a for p, a in n.items() if len(p) > 1 and a >= least}
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in cands.items()):
                continue
            score, k = min((1_000_000 * a * a // (n[p[:k]] * n[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), " ".join(p), n[p[:k]], n[p[k:]]))
        out += [(lang, i, p, -a, left, right, total, -s) for i, (s, a, _, p, left, right) in enumerate(sorted(found)[:limit], 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def texts(seed, n):
    """Zipf-like words, so that some phrases are frequent, with all kinds of separators."""
    rng = random.Random(seed)
    words = ["der", "Haus", "É", "é", "a", "b", "x-y", "#", "日本", "zu viel", *[f"w{i}" for i in range(40)]]
    for i in range(n):
        out = "".join(rng.choice(words[:1 + int(rng.random() ** 3 * len(words))]) + rng.choice([" "] * 8 + ["  ", "\t", ".", ",", "\n", " ;", "\r", "!"])
                      for _ in range(rng.randrange(60)))
        yield (i, out, rng.choice(["en", "de", None, "und"]), "x", "y", "z")


ODD = [(None, None, None, None, None, None), (1, "", "en", "", "", ""), (2, " \t ..\n", "en", "", "", ""),
       *[(3, "New  York city", "en", "", "", "")] * 12, (4, "a " * 30_000, "en", "", "", ""), (5, "solo", "fr", "", "", "")]


@pytest.mark.parametrize("rows, least, longest, limit", [
    (list(texts(1, 400)), 10, 3, 2000), (list(texts(2, 300)) + ODD, 4, 4, 25), (ODD, 10, 3, 2000), (list(texts(3, 100)), 3, 2, 7)])
def test_against_brute_force(spark, rows, least, longest, limit):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(top_collocations(df, limit, least, longest)) == brute(rows, limit, least, longest)


def test_blocks_do_not_matter(spark, monkeypatch):
    """The same phrases from one block and from many, also where a phrase is frequent only over all blocks."""
    rows = [(i, f"rare pair {i}. rare pair again", "en", "", "", "") for i in range(24)]
    one = got(top_collocations(spark.createDataFrame(rows, SCHEMA).coalesce(1)))
    many = got(top_collocations(spark.createDataFrame(rows, SCHEMA).repartition(24)))
    assert one == many == brute(rows, 2000, 10, 3) and one


def test_empty_table(spark):
    assert top_collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_beyond_64_bits(spark):
    """Counts whose products need 110 bits; the two cuts differ in the last digit only before flooring."""
    a, left, right = 9_007_199_254_740_993, 9_007_199_254_741_993, 9_999_999_999_999_999
    schema = "id long, lang string, phrase string, f long, a long, b long, heads array<long>, tails array<long>"
    words = spark.createDataFrame([], schema)
    pairs = spark.createDataFrame([(1, "en", "x y", a, 0, 0, [left, a], [right, a])], schema)
    triples = spark.createDataFrame([(2, "en", "x y z", 10, 1, 5, [left, a, 10], [right, right - 1, 10])], schema)
    rows = {r.phrase: r for r in collocations([words, pairs, triples]).collect()}
    assert rows["x y"].score == 1_000_000 * a * a // (left * right)
    assert rows["x y z"].score == 0 and (rows["x y z"].l, rows["x y z"].r) == (left, right - 1)
