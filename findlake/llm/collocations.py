"""Phrase collocations by set-oriented (SETM) mining.

Relations of occurrences are kept in blocks: a row of a relation table holds
one language's occurrences in a few megabytes of whole texts, sorted by place,
with the number of the item at each place. Places count on by one inside a
piece of text and by two or more between pieces, so "same piece, next
position" is "place + 1". Each length is mined from the stored relation of the
one before: its occurrences merge-join with themselves at the next place,
groups are counted in each block and summed by Spark over all blocks, and the
frequent groups go back to their blocks, which keep only their occurrences
(the semi-join) as the next relation. A group that occurs everywhere has one
row for each block, never one for each occurrence.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findlake.llm.common import bounded_batches, slices, stored, utf8
from findlake.operators.topn import top_n_per_group

UNKNOWN = "und"
#: A language's block closes at about so many bytes of texts; the open blocks of a task hold so many together.
BLOCK_BYTES, OPEN_BYTES = 8 << 20, 24 << 20
_ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to a-z, the ends of pieces to line feeds, tabs to spaces.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(_ENDS) + b" ")

_WORDS = "block long, lang string, n_words long, places binary, items binary, words array<string>"
_RELATION = "block long, lang string, places binary, items binary, ids binary"


# --- Relations of one block ---

def occurrences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(places, number of the word at each, words) of all words of the texts; a text ends a piece."""
    tokens = b" \n ".join(t.translate(_FOLD).replace(b"\n", b" \n ") for t in texts).split(b" ")
    number: dict[bytes, int] = defaultdict(count().__next__, {b"": -2, b"\n": -1})
    items = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
    word = items >= 0
    places = (np.cumsum(items == -1) + np.cumsum(word))[word]
    return places, items[word], list(number)[2:]


def adjacent(places: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The relation merge-joined with itself at the next place, grouped by the two items.

    Returns the first item, second item and count of each group (in order of
    the items), and the place and the group of each pair.
    """
    at = np.flatnonzero(np.diff(places) == 1)
    code = items[at].astype(np.int64) << 32 | items[at + 1]
    groups, of, n = np.unique(code, return_inverse=True, return_counts=True)
    return groups >> 32, groups & 0xFFFFFFFF, n, places[at], of


def _packed(places: np.ndarray, items: np.ndarray) -> tuple[bytes, bytes]:
    return np.diff(places, prepend=0).astype("<i4").tobytes(), items.astype("<i4").tobytes()


def _unpacked(places: bytes, items: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(places, "<i4"), dtype=np.int64), np.frombuffer(items, "<i4")


def _kept(places: np.ndarray, groups: np.ndarray, found: pa.Table) -> tuple[bytes, bytes, bytes]:
    """Semi-join: the occurrences whose group is found, items numbered as in ``found``."""
    local = found["local"].to_numpy()
    number = np.full(int(max(local.max(), groups.max(initial=0))) + 1, -1, np.int64)
    number[local] = np.arange(len(local))
    items = number[groups]
    keep = items >= 0
    return *_packed(places[keep], items[keep]), found["id"].to_numpy().astype("<i8").tobytes()


# --- Tasks ---

def _write_words(batches):
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("places", pa.binary()),
                        ("items", pa.binary()), ("words", pa.list_(pa.string()))])

    def row(lang):
        nonlocal block
        places, items, words = occurrences(held.pop(lang)[0])
        if len(places):
            names = pa.array(words, pa.binary()).cast(pa.string())
            listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), names)
            block += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], kind) for x, kind in zip((block, lang, len(places), *_packed(places, items)),
                                                       schema.types)] + [listed], schema=schema)

    held: dict[str, tuple[list[bytes], int]] = {}  # the texts of each language's open block, and their bytes
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                texts, size = held.get(lang, ([], 0))
                texts.append(text)
                held[lang] = texts, size + len(text)
            for lang in sorted(k for k, (_, size) in held.items() if size >= BLOCK_BYTES):
                yield from row(lang)
            while sum(size for _, size in held.values()) >= OPEN_BYTES:
                yield from row(max(held, key=lambda k: (held[k][1], k)))
    for lang in sorted(held):
        yield from row(lang)


def _word_groups(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            words = batch.column(3)[k].values
            n = np.bincount(np.frombuffer(batch.column(2)[k].as_py(), "<i4"), minlength=len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(batch.column(1)[k], len(words)), words, pa.repeat(batch.column(0)[k], len(words)),
                 pa.array(np.arange(len(words), dtype=np.int32)), pa.array(n.astype(np.int64))],
                ["lang", "word", "block", "local", "n"])


def _pair_groups(batches):
    for batch in batches:
        for row in batch.to_pylist():
            a, b, n, _, _ = adjacent(*_unpacked(row["places"], row["items"]))
            ids = np.frombuffer(row["ids"], "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[a]), pa.array(ids[b]), pa.array(np.full(len(n), row["block"], np.int64)),
                 pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "block", "local", "n"])


def _semi_join(pairs: bool):
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("places", pa.binary()), ("items", pa.binary()),
                        ("ids", pa.binary())])

    def run(relation: pa.Table, found: pa.Table) -> pa.Table:
        if not relation.num_rows or not found.num_rows:
            return schema.empty_table()
        row = relation.to_pylist()[0]
        places, groups = _unpacked(row["places"], row["items"])
        if pairs:
            places, groups = adjacent(places, groups)[3:]
        out = (row["block"], row["lang"], *_kept(places, groups, found))
        return pa.table([pa.array([x], kind) for x, kind in zip(out, schema.types)], schema=schema)
    return run


# --- Mining ---

def _frequent(groups: DataFrame, by: list[str], least: int) -> DataFrame:
    """The groups (one row for each block that has them) with ``f``, their count in all blocks, of ``least`` or more."""
    return groups.withColumn("f", F.sum("n").over(Window.partitionBy(*by))).where(F.col("f") >= least)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    return stored(df.withColumn("id", F.monotonically_increasing_id()), name)


def mined(docs: DataFrame, least: int = 10, longest: int = 3, text: str = "text",
          lang: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """(frequent phrases of 1, 2, ... ``longest`` words, words of each language).

    Phrase tables have id, lang, phrase, ``f`` (all contiguous occurrences
    within pieces), ``a`` and ``b`` (ids of the phrases without the last and
    without the first word; null for words), ``heads`` and ``tails`` (counts
    of the first and of the last 1, 2, ... words).
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    relation = stored(rows.mapInArrow(_write_words, _WORDS), "setm-words")
    totals = stored(relation.groupBy("lang").agg(F.sum("n_words").alias("n")), "setm-totals")
    groups = relation.select("block", "lang", "items", "words").mapInArrow(
        _word_groups, "lang string, word string, block long, local int, n long")
    found = stored(_frequent(groups, ["lang", "word"], least), "setm-frequent")
    last = _numbered(found.groupBy("lang", "word").agg(F.max("f").alias("f")), "setm-ids")
    tables = [last.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("end"), "f",
                          F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"),
                          F.array("f").alias("heads"), F.array("f").alias("tails"))]
    for length in range(2, longest + 1):
        by = ["lang", "word"] if length == 2 else ["a", "b"]
        back = found.join(last.select("id", *by), by).select("block", "local", "id")
        own = relation.select("block", "lang", "places", "items") if length == 2 else relation
        relation = stored(own.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
            _semi_join(length > 2), _RELATION), "setm-relation")
        groups = relation.mapInArrow(_pair_groups, "a long, b long, block long, local int, n long")
        if length < longest:
            found = stored(_frequent(groups, ["a", "b"], least), "setm-frequent")
            counted = found.groupBy("a", "b").agg(F.max("f").alias("f"))
        else:
            counted = groups.groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        last = _numbered(counted, "setm-ids")
        side = lambda s: tables[-1].select(*[F.col(c).alias(f"{s}_{c}") for c in tables[-1].columns])  # noqa: E731, B023
        tables.append(stored(
            last.join(side("x"), F.col("a") == F.col("x_id")).join(side("y"), F.col("b") == F.col("y_id")).select(
                "id", F.col("x_lang").alias("lang"), F.concat_ws(" ", "x_phrase", "y_end").alias("phrase"),
                F.col("y_end").alias("end"), "f", "a", "b", F.concat("x_heads", F.array("f")).alias("heads"),
                F.concat("y_tails", F.array("f")).alias("tails")), "setm-phrases"))
    return tables, totals


def collocations(tables: list[DataFrame], absorbed: int = 50) -> DataFrame:
    """Scored phrases of two words or more: lang, phrase, a, l, r, score.

    A phrase counted a times, cut into parts counted l and r times, scores
    floor(1,000,000 a a / (l r)) at its worst cut (the first of equal ones).
    Products are exact decimals up to counts of 10^16. A phrase goes if a longer frequent
    one that contains it has ``absorbed`` per cent of its count or more; since
    every part of a frequent phrase is as frequent, the next length decides.
    """
    out = None
    for k, table in enumerate(tables[1:], 1):
        part = lambda e: f"cast({e} as decimal(19,0))"
        cuts = F.expr(f"""array_min(transform(sequence(1, {k}), k -> struct(
            (1000000BD * {part('f')} * {part('f')}) div ({part('heads[k - 1]')} * {part(f'tails[{k} - k]')}) as score,
            k, heads[k - 1] as l, tails[{k} - k] as r)))""")
        own = table.select("id", "lang", "phrase", F.col("f").alias("a"), cuts.alias("cut"))
        if k + 1 < len(tables):
            longer = tables[k + 1].select(F.explode(F.array("a", "b")).alias("id"), "f").groupBy("id").agg(
                F.max("f").alias("longer"))
            own = own.join(longer, "id", "left").where(
                F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a"))).drop("longer")
        own = own.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))
        out = own if out is None else out.unionByName(own)
    return out


def top_collocations(docs: DataFrame, limit: int = 2000, least: int = 10, longest: int = 3, text: str = "text",
                     lang: str = "lang") -> DataFrame:
    """The first ``limit`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Order: score and count descending, then the phrase's bytes. A null
    language is ``und``; null and empty texts have no words; repeated rows
    count again; an empty table gives no rows. Other columns of ``docs`` are
    not read.
    """
    tables, totals = mined(docs, least, longest, text, lang)
    best = top_n_per_group(collocations(tables), ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], limit)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                            "n", "score")
