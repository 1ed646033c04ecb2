import zlib

import pytest

from findlake.llm.queries import op6_sharding
from findlake.llm.sharding import assign_shards

SCHEMA = "doc_id long, text string, size string, shard string"


def brute(rows, n):
    sized = sorted(((r[0] is not None, r[0] or 0), zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1, r[0])
                   for r in rows)
    total, start, out, seen = sum(s for _, _, s, _ in sized), 0, [], {}
    for _, crc, size, key in sized:
        shard = (2 * start + size) * n // (2 * total)
        out.append((key, size, crc, shard, seen.setdefault(shard, 0)))
        seen[shard] += 1
        start += size
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows", [
    [(5, "aé", "x", "y"), (5, "aé", "x", "y"), (None, None, None, None), (2, "", "", ""), (1, "z" * 50_000, "", "")],
    [(i, "w" * (i % 17), "a", "b") for i in range(300)] + [(None, "same", "a", "b")] * 150,
])
def test_matches_running_sum(spark, rows):
    assert got(assign_shards(spark.createDataFrame(rows, SCHEMA), 4)) == brute(rows, 4)


def test_empty_table(spark):
    assert assign_shards(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_is_balanced_and_whole(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = op6_sharding(spark, sf)
    assert got(df) == brute(docs, 16)
    assert {r.law for r in df.select("law").distinct().collect()} == {"bytes"}
