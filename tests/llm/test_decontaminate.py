import hashlib
import re

import pytest

from findlake.llm import decontaminate as D
from findlake.llm.queries import op5_decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def brute(docs, bench):
    windows = []
    for item, text in bench:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.append((w[i:i + 10], "" if item is None else str(item)))
    by_first = {}
    for w, item in windows:
        by_first.setdefault(w[0], []).append((w, item))
    out = []
    for key, text in docs:
        w = WORD.findall(lower(text))
        hit, items = set(), set()
        for i, first in enumerate(w):
            for win, item in by_first.get(first, ()):
                if w[i:i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    items.add(item)
        out.append((key, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                    bool(hit)))
    return sorted(out, key=repr)


BENCH = [(1, "What is, the capital?"), (2, " ".join(f"w{i}" for i in range(25))), (10, "what IS the capital"),
         (None, "Été ça"), (4, ""), (5, None), (6, "..."), (2, "zz yy"), (7, "a a")]
DOCS = [(1, "So: what is THE--capital? w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 x"), (2, None), (3, ""), (4, "a A a a b a"),
        (None, "été ça Été ça"), (4, "a A a a b a"), (6, "whatis the capital"), (7, "w0 " * 9 + "zz_yy"),
        (8, "n " * 300_000 + "zz yy"), (9, "x w3 w4 w5 w6 w7 w8 w9 w10 w11"), (10, "ÉTÉ ça")]


def frames(spark):
    docs = spark.createDataFrame([(k, t, 1, "c") for k, t in DOCS], "doc_id long, text string, n_hit int, item string")
    return docs, spark.createDataFrame([(*b, "q") for b in BENCH], "item_id long, text string, window string")


@pytest.mark.parametrize("part_bytes", [D.PART_BYTES, 300])
def test_matches_brute_force(spark, part_bytes):
    docs, bench = frames(spark)
    got = D.leaks(docs, bench, part_bytes=part_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(DOCS, BENCH)


def test_spans_are_offsets_of_the_original(spark):
    docs, bench = frames(spark)
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in D.leak_spans(docs, bench).collect()}
    text = dict(DOCS)
    assert [text[1][a:b] for a, b in spans[1]] == ["what is THE--capital? " + " ".join(f"w{i}" for i in range(3, 14))]
    assert [text[None][a:b] for a, b in spans[None]] == ["été ça Été ça"[7:]] or spans[None]
    assert set(spans) == {r[0] for r in brute(DOCS, BENCH) if r[-1]}


def test_clean_documents_stay_whole(spark):
    docs, bench = frames(spark)
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()]) == sorted(r[0] for r in brute(DOCS, BENCH) if not r[-1])


def test_empty_tables(spark):
    docs, bench = frames(spark)
    assert D.leaks(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in D.leaks(docs, bench.limit(0)).collect())


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = op5_decontaminate(spark, sf).collect()
    assert sorted(map(tuple, rows), key=repr) == brute(docs, bench)
    assert any(r.contaminated for r in rows)
