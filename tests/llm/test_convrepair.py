import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from findlake.llm import convrepair
from findlake.llm.convrepair import damaged, digest, repaired
from findlake.llm.queries import op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, chunk string, pos string, item string"
SPACE = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """(cost, audit, repaired turns): uniform-cost search over the automaton of (s?(ua)+)?, states by the last initial."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done, n = [(0, "", 0, "", ())], set(), len(rows)
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in ("", "a"):
            return cost, audit, out
        moves = [(5, "I", i, t, f"{NAMES[t]}:") for t in "ua"]
        if i < n:
            role, text = rows[i]
            moves.append((2, "D", i + 1, None, None))
            if bad[i] not in ("b", "d"):
                more = 5 * (bad[i] == "t")
                moves += [(more, "K", i + 1, role[:1], f"{role}:{text}")]
                moves += [(1 + more, "R", i + 1, t, f"{NAMES[t]}:{text}") for t in "ua"]
        for price, letter, to, token, line in moves:
            new = state if token is None else step.get((state, token))
            if new is not None:
                heapq.heappush(heap, (cost + price, audit + letter, to, new, out if line is None else (*out, line)))


def exhaustive(rows, bad):
    """(cost, audit) by trying every edit of every row and up to two insertions at every place."""
    best = None
    for extra in itertools.product(range(3), repeat=len(rows) + 1):
        for edit in itertools.product(["D", "K", "Ru", "Ra"], repeat=len(rows)):
            roles, audit, cost = "I" * extra[0], "I" * extra[0], 5 * sum(extra)
            for (role, _), fault, e, more in zip(rows, bad, edit, extra[1:]):
                if e != "D":
                    if fault in ("b", "d"):
                        break
                    roles += role[:1] if e == "K" else e[1]
                cost += {"D": 2, "K": 0}.get(e, 1) + 5 * (fault == "t" and e != "D")
                audit += e[0] + "I" * more
                roles += "I" * more
            else:
                pattern = re.escape(roles).replace("I", "[ua]")
                if (best is None or (cost, audit) < best) and any(
                        re.fullmatch(pattern, x) for x in ["", *["ua" * k for k in range(1, 9)], *["s" + "ua" * k for k in range(1, 9)]]):
                    best = cost, audit
    return best


def model(convs, damage=True):
    """The query's rows in plain Python."""
    groups, ids = {}, {r[0] for r in convs}
    for conv, turn, role, text in (r[:4] for r in convs):
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3)))
    out = []
    for conv in ids:
        rows = sorted(groups.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in rows if r[0] is not None]
        rows = [r[1:] for r in rows]
        bad = faults(rows)
        cost, audit, lines = cheapest(rows, bad)
        initials = [r[0][:1] for r in rows]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(bad.count(f) for f in "bdt"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def conversations(seed, n, length=7):
    rng = random.Random(seed)
    for conv in range(n):
        for turn in range(rng.randrange(length)):
            yield (rng.choice([conv, conv, conv, None]), rng.choice([turn, turn, turn, turn + 2, None]),
                   rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "u", "", None]),
                   rng.choice(["Yes.", "No!", "well", "", " \n", "Why?\t", "é. ", None, f"t{turn}."]), "x", "y", "z", "w")


def test_parser_against_every_edit():
    rng = random.Random(7)
    for _ in range(120):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", "", "c!"])) for _ in range(rng.randrange(4))]
        bad = faults(rows)
        names = {"b": "blank", "d": "duplicate", "t": "truncated", "": ""}
        initials = [(r[:1], names[f]) for (r, _), f in zip(rows, bad)]
        cost, pieces = convrepair.linked([convrepair.chunk_paths(initials)] if rows else [])
        assert (cost, "".join(a for _, a in pieces)) == exhaustive(rows, bad) or not rows and cost == 0


@pytest.mark.parametrize("size", [1, 2, 5])
def test_chunks_link_to_the_same_repair(size):
    """Conversations cut into chunks of any size repair as in one piece, turns included."""
    rng = random.Random(size)
    for _ in range(150):
        rows = [(rng.choice(["system", "user", "assistant"]), rng.choice(["a.", "b", "", "c!", "d?", "e.", "f."])) for _ in range(rng.randrange(1, 14))]
        bad = faults(rows)
        names = {"b": "blank", "d": "duplicate", "t": "truncated", "": ""}
        initials = [(r[:1], names[f]) for (r, _), f in zip(rows, bad)]
        cut = [slice(i, i + size) for i in range(0, len(rows), size)]
        cost, pieces = convrepair.linked([convrepair.chunk_paths(initials[c]) for c in cut])
        edits = [e for c, (entry, audit) in zip(cut, pieces) for e in convrepair.edits_of(entry, audit, rows[c])]
        lines = tuple(f"{role}:{text}" for action, role, text in edits if action != "D")
        assert (cost, "".join(a for _, a in pieces), lines) == cheapest(rows, bad)


@pytest.mark.parametrize("chunk", [2, 4096])
def test_against_model(spark, monkeypatch, chunk):
    monkeypatch.setattr(convrepair, "CHUNK", chunk)
    rows = list(conversations(chunk, 60)) + [(900, i, "user" if i % 3 else "assistant", f"turn {i}" + "." * (i % 4), *"abcd") for i in range(200)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(digest(df, *repaired(damaged(df)))) == model(rows)
    plain = df.select("conv_id", "turn", "role", "text")
    assert got(digest(df, *repaired(plain))) == model(rows, damage=False)


def test_long_text_and_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], "x" * 300_000 + "." if i == 4 else f"{i}.", *"abcd") for i in range(9_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(digest(df, *repaired(damaged(df)))) == model(rows)


def test_nothing_left_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", *"abcd")], SCHEMA)
    assert got(digest(df, *repaired(damaged(df)))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    empty = df.limit(0)
    assert got(digest(empty, *repaired(damaged(empty)))) == []


def test_query_against_model(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op12_conversation_repair(spark, sf)) == model(rows)
