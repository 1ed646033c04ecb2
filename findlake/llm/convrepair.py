"""Repair of conversation structure by generalised LR parsing with weighted edits.

Roles form the grammar  C -> e | B | s B,  B -> P | B P,  P -> u a  (system,
user, assistant by their initials). A table-driven LR parser reads a
conversation's rows with a graph-structured stack: every row may be kept,
given the role user or assistant, or deleted, and an empty turn may be
inserted anywhere. Stacks whose tops are equal have the same continuations
and are merged by minimum (cost, audit), the audit being the edits' initials.

Conversations of any length are cut into chunks of ``CHUNK`` rows. Each chunk
is parsed by itself from every stack that it may meet; the chunks' results,
one per entry and exit, are then linked in order, streaming, so that no
task holds a conversation's rows. What one task holds of a conversation is
its audits, which the result holds too.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.llm.common import ranked_within, stored

CHUNK = 4096
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
OK, BLANK, DUPLICATE, TRUNCATED = "", "blank", "duplicate", "truncated"
_BLANKS = " \t\n\x0b\x0c\r"
_NAMES = {"u": "user", "a": "assistant"}

# --- The grammar's LR tables. States: 0 start, 1 s, 2 u, 3 B, 4 P, 5 s B, 6 u a, 7 B P ---

_SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (5, "u"): 2, (2, "a"): 6}
_REDUCE = {6: ("P", 2), 4: ("B", 1), 7: ("B", 2)}
_GOTO = {(0, "P"): 4, (1, "P"): 4, (3, "P"): 7, (5, "P"): 7, (0, "B"): 3, (1, "B"): 5}
_ACCEPT = {0, 3, 5}
#: Stacks that a chunk may start from, one for each set of continuations (3 and 5 have the same).
ENTRIES = {0: (0,), 1: (0, 1), 2: (0, 3, 2), 3: (0, 3)}


def shifted(stack: tuple, token: str) -> tuple | None:
    """The stack after shifting ``token`` and all reductions; None where the grammar has no such turn."""
    to = _SHIFT.get((stack[-1], token))
    if to is None:
        return None
    stack = (*stack, to)
    while stack[-1] in _REDUCE:
        symbol, n = _REDUCE[stack[-1]]
        stack = stack[:-n]
        stack = (*stack, _GOTO[stack[-1], symbol])
    return stack


def entry_of(stack: tuple) -> int:
    return 3 if stack[-1] == 5 else stack[-1]


class Frontier:
    """The tops of the graph-structured stack: {entry: (cost, audit, stack)}, equal tops merged by their minimum."""

    def __init__(self, tops=()):
        self.tops: dict[int, tuple[int, str, tuple]] = {}
        for cost, audit, stack in tops:
            self.add(cost, audit, stack)

    def add(self, cost: int, audit: str, stack: tuple | None) -> bool:
        if stack is None:
            return False
        top = entry_of(stack)
        if top in self.tops and self.tops[top][:2] <= (cost, audit):
            return False
        self.tops[top] = (cost, audit, stack)
        return True

    def inserted(self) -> Frontier:
        """Closed under insertions: the cheapest top is final, so each top is expanded once."""
        open_, done = Frontier(self.tops.values()), Frontier()
        while open_.tops:
            top = min(open_.tops, key=lambda t: open_.tops[t][:2])
            cost, audit, stack = open_.tops.pop(top)
            done.add(cost, audit, stack)
            for token in "ua":
                new = shifted(stack, token)
                if new is not None and entry_of(new) not in done.tops:
                    open_.add(cost + INSERT, audit + "I", new)
        return done

    def read(self, initial: str, fault: str) -> Frontier:
        """After one row."""
        out, extra = Frontier(), CUT_SHORT if fault == TRUNCATED else 0
        for cost, audit, stack in self.inserted().tops.values():
            out.add(cost + DELETE, audit + "D", stack)
            if fault not in (BLANK, DUPLICATE):
                out.add(cost + KEEP + extra, audit + "K", shifted(stack, initial))
                for token in "ua":
                    out.add(cost + REROLE + extra, audit + "R", shifted(stack, token))
        return out


def chunk_paths(rows: list[tuple[str, str]], entries=tuple(ENTRIES)) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of the cheapest edits of the (initial, fault) rows, from each entry to each exit."""
    out = []
    for entry in entries:
        frontier = Frontier([(0, "", ENTRIES[entry])])
        for initial, fault in rows:
            frontier = frontier.read(initial, fault)
        out += [(entry, top, cost, audit) for top, (cost, audit, _) in sorted(frontier.tops.items())]
    return out


def linked(chunks) -> tuple[int, list[tuple[int, str]]]:
    """(cost, [(entry, audit) of each chunk]) of the cheapest edits of a conversation, from its chunks' paths in order."""
    best = {0: (0, "", None)}
    for paths in chunks:
        new: dict[int, tuple] = {}
        for entry, top, cost, audit in paths:
            if entry in best:
                before = best[entry]
                path = (before[0] + cost, before[1] + audit)
                if top not in new or path < new[top][:2]:
                    new[top] = (*path, (entry, audit, before[2]))
        best = new
    last = Frontier((cost, audit, ENTRIES[top]) for top, (cost, audit, _) in best.items()).inserted()
    cost, audit, _ = min(x for x in last.tops.values() if x[2][-1] in _ACCEPT)
    # The exit that this audit extends by insertions at the end.
    end = next(b for b in best.values() if audit[:len(b[1])] == b[1] and b[0] + INSERT * (len(audit) - len(b[1])) == cost
               and not audit[len(b[1]):].strip("I"))
    pieces, link, tail = [], end[2], audit[len(end[1]):]
    while link:
        pieces.append((link[0], link[1] + tail))
        link, tail = link[2], ""
    return cost, pieces[::-1]


def edits_of(entry: int, audit: str, rows) -> list[tuple[str, str, str]]:
    """(action, role, text) for each initial of a chunk's audit, from the stack it starts with; rows are (role, text)."""
    rows, stack, out = iter(rows), ENTRIES[entry], []
    for action in audit:
        role, text = ("", "") if action == "I" else next(rows)
        if action in "IR":
            token = next(t for t in "ua" if shifted(stack, t))
            role = _NAMES[token]
        elif action == "K":
            token = role[:1]
        if action != "D":
            stack = shifted(stack, token)
        out.append((action, role, text))
    return out


# --- Tasks: streams of rows sorted by group ---

def _streams(batches, n_keys: int):
    """(key, iterator of rows) for each run of rows that agree in the first ``n_keys`` columns, over batches."""
    rows = (tuple(r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    return itertools.groupby(rows, key=lambda r: r[:n_keys])


def _batched(rows, schema: pa.Schema, most: int = 4096, most_chars: int = 4 << 20):
    """Arrow batches of tuples, bounded in rows and, roughly, in characters."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_PATHS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _parse(kind: pa.DataType):
    schema = pa.schema([("conv", kind), ("chunk", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()),
                        ("last", pa.string()), ("paths", _PATHS)])

    def run(batches):
        def chunks():
            for (conv, chunk), group in _streams(batches, 2):
                rows = [(initial, fault) for _, _, _, initial, fault in group]
                wrong = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
                paths = [dict(zip(("entry", "exit", "cost", "audit"), p))
                         for p in chunk_paths(rows, ENTRIES if chunk else (0,))]
                yield conv, chunk, wrong, rows[0][0], rows[-1][0], paths
        yield from _batched(chunks(), schema, 256)
    return run


def _link(kind: pa.DataType):
    schema = pa.schema([("conv", kind), ("chunk", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
                        ("entry", pa.int32()), ("audit", pa.string())])

    def run(batches):
        def pieces():
            for (conv,), group in _streams(batches, 1):
                illegal, last = 0, None

                def paths():
                    nonlocal illegal, last
                    for _, _, wrong, head, tail, found in group:  # noqa: B023
                        illegal += wrong + (last is not None and last + head not in ("su", "ua", "au"))
                        last = tail
                        yield [(p["entry"], p["exit"], p["cost"], p["audit"]) for p in found]
                cost, parts = linked(paths())
                for chunk, (entry, audit) in enumerate(parts):
                    yield conv, chunk, 0 if chunk else illegal, 0 if chunk else cost, entry, audit
        yield from _batched(pieces(), schema)
    return run


def _edit(kind: pa.DataType):
    schema = pa.schema([("conv", kind), ("chunk", pa.int64()), ("item", pa.int64()), ("action", pa.string()),
                        ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        def items():
            for (conv, chunk), group in _streams(batches, 2):
                first = next(group)
                rows = ((r[3], r[4]) for r in itertools.chain([first], group))
                for item, edit in enumerate(edits_of(first[5], first[6], rows)):
                    yield conv, chunk, item, *edit
        yield from _batched(items(), schema)
    return run


def _hash(kind: pa.DataType):
    schema = pa.schema([("conv", kind), ("repaired_sha256", pa.string())])

    def run(batches):
        def hashes():
            for (conv,), group in _streams(batches, 1):
                digest = hashlib.sha256()
                for nth, row in enumerate(group):
                    digest.update(("\n" * bool(nth) + row[3]).encode())
                yield conv, digest.hexdigest()
        yield from _batched(hashes(), schema)
    return run


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


# --- The operator ---

def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) plus ``pos`` (place in the conversation by turn, nulls first, then role and text)
    and ``fault``: the first of blank, duplicate (role and text seen earlier) and truncated, or empty."""
    placed = ranked_within(rows.select("conv", "turn", "role", "text"), ["conv"], ["turn", "role", "text"], "pos", "turns")
    placed = stored(placed, "turns-placed")
    narrow = placed.select("conv", "pos", "role", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    seen = ranked_within(narrow, ["conv", "role", "h", "g"], ["pos"], "seen", "turns-seen").where("seen > 0").select(
        F.col("conv").alias("s_conv"), F.col("pos").alias("s_pos"), "seen")
    bare = F.rtrim(F.col("text"), F.lit(_BLANKS))
    fault = (F.when(F.length(bare) == 0, BLANK).when(F.col("seen").isNotNull(), DUPLICATE)
             .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(OK))
    joined = placed.join(seen, F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("pos") == F.col("s_pos")), "left")
    return stored(joined.select("conv", "turn", "role", "text", "pos", fault.alias("fault")), "turns-faults")


def repaired(convs: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with faults, pieces of the cheapest edits, edited turns) of conversations.

    Pieces have conv, chunk, illegal and cost (of the conversation, on its
    first chunk), entry and audit. Edited turns have conv, chunk, item, action
    (K, R, D or I), role and text, in order of chunk and item; those that are
    not deleted make the repaired conversation. Null roles and texts count as
    one space; rows of null key form a conversation; an empty table gives
    empty ones. Other columns are not read.
    """
    kind = _ARROW[convs.schema[key].dataType.simpleString()]
    name = convs.schema[key].dataType.simpleString()
    rows = with_faults(convs.select(F.col(key).alias("conv"), F.col(turn).alias("turn"),
                                    F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                                    F.coalesce(F.col(text), F.lit(" ")).alias("text")))
    chunk = F.expr(f"pos div {CHUNK}").alias("chunk")
    dealt = lambda df, *by: df.repartition(*by).sortWithinPartitions(*by, *[c for c in ("chunk", "pos") if c in df.columns and c not in by])
    parsed = dealt(rows.select("conv", chunk, "pos", F.substring("role", 1, 1).alias("initial"), "fault"), "conv", "chunk")
    paths = parsed.mapInArrow(_parse(kind), f"conv {name}, chunk long, illegal long, first string, last string, "
                              "paths array<struct<entry: int, exit: int, cost: long, audit: string>>")
    pieces = stored(dealt(paths, "conv").mapInArrow(
        _link(kind), f"conv {name}, chunk long, illegal long, cost long, entry int, audit string"), "repair-pieces")
    heads = pieces.select(F.col("conv").alias("p_conv"), (F.col("chunk") * CHUNK).alias("p_pos"), "entry", "audit")
    marked = rows.join(heads, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("pos") == F.col("p_pos")), "left")
    edits = dealt(marked.select("conv", chunk, "pos", "role", "text", "entry", "audit"), "conv", "chunk").mapInArrow(
        _edit(kind), f"conv {name}, chunk long, item long, action string, role string, text string")
    return rows, pieces, edits


def digest(convs: DataFrame, rows: DataFrame, pieces: DataFrame, edits: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per key of ``convs``: key, gaps, counts of faults, illegal neighbours, cost, audit, repaired_sha256.

    A conversation's repaired text is hashed as a stream of its turns.
    """
    turns = rows.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == f).cast("long").alias(f) for f in (BLANK, DUPLICATE, TRUNCATED)])
    whole = pieces.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    kind, name = _ARROW[convs.schema[key].dataType.simpleString()], convs.schema[key].dataType.simpleString()
    left = edits.where(F.col("action") != "D").select("conv", "chunk", "item", F.concat_ws(":", "role", "text").alias("line"))
    hashes = left.repartition("conv").sortWithinPartitions("conv", "chunk", "item").mapInArrow(
        _hash(kind), f"conv {name}, repaired_sha256 string")
    out = convs.select(F.col(key).alias("id")).distinct()
    for nth, part in enumerate((turns, whole, hashes)):
        part = part.withColumnRenamed("conv", f"c{nth}")
        out = out.join(part, F.col("id").eqNullSafe(F.col(f"c{nth}")), "left").drop(f"c{nth}")
    numbers = ["gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost"]
    return out.select(F.col("id").alias(key), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(convs: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) after the damage that their crc32 decides; null fields are one space."""
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    sort = F.crc32(F.concat_ws(":", field("conv_id"), field("turn"))) % 20
    rows = convs.select("conv_id", "turn", field("role").alias("role"), field("text").alias("text"), sort.alias("damage"))
    text = (F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    copies = F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return (rows.where("damage != 0")
            .select("conv_id", "turn", F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    text.alias("text"), copies.alias("copy")).drop("copy"))
