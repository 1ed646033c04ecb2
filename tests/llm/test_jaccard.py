import random
import re
import tracemalloc
from collections import defaultdict

import pyarrow as pa
import pytest

from findlake.llm import jaccard as J
from findlake.llm.queries import op4_jaccard_join


def shingles(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", folded)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """(id, size, least id of the component) by comparing every two documents that share a shingle."""
    sets = [shingles(t) for _, t in docs]
    holders, parent = defaultdict(list), list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders[g]}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                parent[root(i)] = root(j)
        for g in s:
            holders[g].append(i)
    least = {}
    for i, (k, _) in enumerate(docs):
        if sets[i] and k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [(k, len(s), least.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(docs, sets))]


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, n=120):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i in range(n):
        base = [f"b{i}x{rng.randrange(40)}" for _ in range(rng.randrange(3, 90))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randrange(1, 6)):
            docs.append(edited(rng, base, rng.randrange(0, 5)))
    short = ["", None, " \t\n", "a", "A", "a b c d", "A b\tc\x0bd", "a b c", "É b", "é b", "x\x1cy z", "x y z"]
    docs += short + short
    rng.shuffle(docs)
    rows = [(k, t) for k, t in enumerate(docs)]
    return rows + [(None, docs[0]), (None, docs[1]), (3, rows[3][1]), (3, rows[3][1]), (4, "w " * 50_000 + "q")]


SCHEMA = "doc_id long, text string, n long, g string"


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)
    assert got(J.linked_components(df)) == sorted(brute(rows), key=repr)


def test_chain_and_large_group(spark):
    """A chain whose ends do not link, and a group of many near copies of which some do not link directly."""
    rng = random.Random(9)
    base = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(base[:200 - 4 * i])) for i in range(25)]
    group = [f"g{i}" for i in range(60)]
    rows += [(100 + i, edited(rng, group, rng.randrange(1, 3))) for i in range(150)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)
    assert got(J.linked_components(df)) == sorted(brute(rows), key=repr)


def test_one_of_each_group_stays(spark):
    rows = corpus(5, 60)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)
    kept = J.deduplicated(df)
    assert kept.columns == df.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    comp = {(r[0], t): (size, c) for r, (_, size, c), t in zip(rows, brute(rows), [t for _, t in rows])}
    want = sorted([(k, t) for (k, t), (size, c) in comp.items() if size and k == c]
                  + [(k, t) for k, t in rows if not shingles(t)], key=repr)
    assert found == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert J.linked_components(df).count() == 0 and J.deduplicated(df).count() == 0


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op4_jaccard_join(spark, sf)) == sorted(brute(docs), key=repr)


def test_memory_of_shingling_does_not_grow_with_the_batch():
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(500)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(range(1000)), pa.array(texts)], ["id", "key", "text"])
    tracemalloc.start()
    assert sum(r.num_rows for r in J._first_pass(iter([batch]))) == 1000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6  # 37 MB before
