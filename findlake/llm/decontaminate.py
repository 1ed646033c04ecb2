"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are cut into windows of ten normalised words; all windows form one
automaton, and each document's normalised text runs through it once. Matches
become word ranges, and word ranges become character offsets of the original
text. The windows are measured before they are broadcast: a set beyond
``PART_BYTES`` is split into automata that run one after another, with the
partial results stored in between.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.llm.common import bounded_batches, slices, stored, unused, utf8

WINDOW = 10
#: Most bytes of window text in one automaton (about thirty times that in a worker's memory).
PART_BYTES = 8 << 20

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TO_WORDS = bytes(b if b >= 0x80 or b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

#: Words; first and last hit word, in turn; items.
_FOUND = {"_d_words": T.LongType(), "_d_ranges": T.ArrayType(T.LongType()), "_d_items": T.ArrayType(T.StringType())}


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of a UTF-8 text: A-Z in lower case, other ASCII but digits and letters separates."""
    return text.translate(_TO_WORDS).split()


def _windows_of(batches):
    for batch in batches:
        out = defaultdict(set)
        for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            words = words_of(text)
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                out[b" ".join(words[i:i + WINDOW])].add(item)
        rows = [(w, i) for w, items in out.items() for i in items]
        yield pa.RecordBatch.from_pydict({"window": pa.array([w for w, _ in rows], pa.binary()),
                                          "item": pa.array([i for _, i in rows], pa.string())})


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (window, item) of the benchmark; an item of 1 to 9 words is one window, one of none has none.

    All rows with a null id count as one item, named ''.
    """
    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
                             F.col(text).alias("text"))
    return named.mapInArrow(_windows_of, "window binary, item string").distinct()


_BUILT: dict[str, object] = {}


def _automaton(broadcast):
    """The automaton of a broadcast window list; a worker keeps the last one it built."""
    name, windows = broadcast.value
    if name not in _BUILT:
        import ahocorasick

        found: dict[bytes, list[str]] = defaultdict(list)
        for window, item in windows:
            found[window].append(item)
        automaton = ahocorasick.Automaton()
        for window, items in found.items():
            # One character a byte; the spaces around it tie a window to whole words.
            pattern = f" {window.decode('latin-1')} "
            automaton.add_word(pattern, (len(pattern), window.count(b" ") + 1, items))
        if found:
            automaton.make_automaton()
        _BUILT.clear()
        _BUILT[name] = automaton if found else None
    return _BUILT[name]


def _scan(text: bytes, automaton):
    """Number of words, merged ranges of hit words (first, last, first, ...), ids of items found."""
    words = words_of(text)
    if automaton is None or not words:
        return len(words), [], set()
    line = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(line.decode("latin-1")))
    if not found:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    starts = np.searchsorted(spaces, [end - size + 1 for end, (size, _, _) in found])
    ranges: list[int] = []
    for first, last in sorted((int(s), int(s) + n - 1) for s, (_, (_, n, _)) in zip(starts, found)):
        if ranges and first <= ranges[-1] + 1:
            ranges[-1] = max(ranges[-1], last)
        else:
            ranges += [first, last]
    return len(words), ranges, {i for _, (_, _, items) in found for i in items}


def _merged(old: list[int], new: list[int]) -> list[int]:
    out: list[int] = []
    for first, last in sorted([*zip(old[::2], old[1::2]), *zip(new[::2], new[1::2])]):
        if out and first <= out[-1] + 1:
            out[-1] = max(out[-1], last)
        else:
            out += [first, last]
    return out


def _scanner(broadcast, text_at: int, names: list[str], first: bool):
    def run(batches):
        automaton = _automaton(broadcast)
        for whole in batches:
            for batch in slices(whole, whole.schema.names[text_at]):
                columns = batch.columns if first else batch.columns[:-3]
                results = [_scan(t, automaton) for t in utf8(columns[text_at])]
                words = [r[0] for r in results]
                ranges, items = [r[1] for r in results], [sorted(r[2]) for r in results]
                if not first:
                    ranges = [_merged(a, b) for a, b in zip(batch.columns[-2].to_pylist(), ranges)]
                    items = [sorted({*a, *b}) for a, b in zip(batch.columns[-1].to_pylist(), items)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(words, pa.int64()), pa.array(ranges, pa.list_(pa.int64())),
                     pa.array(items, pa.list_(pa.string()))], names)
    return run


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """All columns of ``docs`` plus ``_d_words``, ``_d_ranges`` and ``_d_items`` of each whole text (null: no words).

    Where ``docs`` has columns of these names, the three get more underscores; they are the last ones in any case.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    windows = stored(benchmark_windows(benchmark), "bench-windows")
    size = windows.agg(F.sum(F.length("window"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    new = [T.StructField(n, t) for n, t in zip(unused(docs, *_FOUND), _FOUND.values())]
    out, schema = docs, T.StructType([*docs.schema.fields, *new])
    for k in range(parts):
        own = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k)
        broadcast = spark.sparkContext.broadcast((uuid.uuid4().hex, [(bytes(r[0]), r[1]) for r in own.collect()]))
        out = out.mapInArrow(_scanner(broadcast, docs.columns.index(text), schema.fieldNames(), k == 0), schema)
        if k + 1 < parts:
            out = stored(out, "bench-part")
    return out


def _digest(batches):
    for batch in batches:
        ids, ranges, items = (batch.column(i) for i in (0, 2, 3))
        ranges, items = ranges.to_pylist(), items.to_pylist()
        hits = [sum(r[1::2]) - sum(r[::2]) + len(r) // 2 for r in ranges]
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column(1), pa.array(hits, pa.int64()), pa.array(map(len, items), pa.int64()),
             pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]),
             pa.array([h > 0 for h in hits])],
            ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    kind = docs.schema[key].dataType.simpleString()
    found = scan(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), benchmark, **kw)
    return found.select("id", "_d_words", "_d_ranges", "_d_items").mapInArrow(
        _digest, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    ).withColumnRenamed("id", key)


def _offsets(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            out = []
            for text, ranges in zip(utf8(batch.column(1)), batch.column(3).to_pylist()):
                at = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))] if ranges else []
                out.append([{"start": at[a][0], "end": at[b][1]} for a, b in zip(ranges[::2], ranges[1::2])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 batch.column(4)], ["id", "spans", "items"])


def leak_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Contaminated documents only: key, spans (code point offsets in the original text, end exclusive), items."""
    kind = docs.schema[key].dataType.simpleString()
    found = scan(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), benchmark, **kw)
    return found.where(F.size("_d_ranges") > 0).mapInArrow(
        _offsets, f"id {kind}, spans array<struct<start: long, end: long>>, items array<string>"
    ).withColumnRenamed("id", key)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a window of the benchmark, with the columns of ``docs``, whatever their names."""
    found = scan(docs, benchmark)
    return found.where(F.size(found.columns[-2]) == 0).select(*docs.columns)
