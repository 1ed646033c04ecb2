"""Secret scan through a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams that any
match must contain. Every batch of documents becomes an index segment: sorted
(trigram, row) postings over case-folded UTF-8. A rule's query intersects and
unites postings, and only the rows it leaves are verified with the expression
itself; a rule without mandatory trigrams scans every row. Segments are
independent, so nothing is shuffled and a lost task is simply run again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from re import _parser as parser

from findlake.llm.common import bounded_batches, slices, utf8

#: Most alternatives that a run of exact text may expand to before the query is cut there.
MOST_EXACT = 64
#: Most characters of a class that count as alternatives.
MOST_CLASS = 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``group`` (0: the whole match) must have ``least`` characters or more."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0

    @cached_property
    def regex(self):
        return re.compile(self.pattern.encode(), re.IGNORECASE if self.ignore_case else 0)

    @cached_property
    def query(self):
        return trigram_query(self.pattern)

    def spans(self, text: bytes):
        for m in self.regex.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.start(), m.end()


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ignore_case=True, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),  # maximal runs, as [0-9a-f]+ of 24 or more
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)


# --- Trigram queries: True (no condition), a trigram, ("and", ...) or ("or", ...) ---

def _and(*parts):
    parts = tuple(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(*parts):
    parts = tuple(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings) -> object:
    """Any of the strings occurs: an OR of the AND of each one's trigrams."""
    return _or(*[_and(*[s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items) -> set[str] | None:
    chars: set[str] = set()
    for op, arg in items:
        if op is parser.LITERAL:
            chars.add(chr(arg).lower())
        elif op is parser.RANGE and arg[1] - arg[0] < 2 * MOST_CLASS:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return chars if len(chars) <= MOST_CLASS else None


def _node(op, arg):
    """(all texts it can match, or None; a query that holds for any match)."""
    if op is parser.LITERAL:
        return {chr(arg).lower()}, True
    if op is parser.IN:
        return _class(arg), True
    if op is parser.AT:
        return {""}, True
    if op is parser.SUBPATTERN:
        return _sequence(arg[-1])
    if op is parser.BRANCH:
        found = [_sequence(branch) for branch in arg[1]]
        if all(exact is not None for exact, _ in found):
            return set().union(*(exact for exact, _ in found)), True
        return None, _or(*[_of_strings(e) if e is not None else q for e, q in found])
    if op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
        least, most, body = arg
        exact, query = _sequence(body)
        if exact is not None and most == 1:
            return exact | {""} if least == 0 else exact, True
        if exact is not None and least == most and len(exact) ** least <= MOST_EXACT:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in exact}
            return out, True
        return None, True if least == 0 else _of_strings(exact) if exact is not None else query
    return None, True


def _sequence(nodes):
    run, query, whole = {""}, True, True
    for op, arg in nodes:
        exact, own = _node(op, arg)
        if exact is not None and len(run) * len(exact) <= MOST_EXACT:
            run = {a + b for a in run for b in exact}
            continue
        query = _and(query, _of_strings(run), own, True if exact is None else _of_strings(exact))
        run, whole = {""}, False
    return (run if whole else None), _and(query, _of_strings(run))


def trigram_query(pattern: str):
    """A Boolean query over lower-case trigrams that every match of ``pattern`` meets; True: none are mandatory."""
    exact, query = _sequence(parser.parse(pattern))
    return _of_strings(exact) if exact is not None else query


_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ROW_BITS = 20


class Segment:
    """Sorted (trigram, row) postings of some texts. Trigrams across two texts only add candidates."""

    def __init__(self, texts: list[bytes]):
        self.rows = len(texts)
        data = np.frombuffer(b"".join(texts).translate(_FOLD), np.uint8).astype(np.int64)
        row = np.repeat(np.arange(self.rows), [len(t) for t in texts])
        keys = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) << _ROW_BITS | row[:-2] if len(data) > 2 else row[:0]
        self.keys = np.sort(keys)

    def postings(self, trigram: str) -> np.ndarray:
        """The rows that contain ``trigram``, ascending."""
        a, b, c = trigram.encode("latin-1")
        code = a << 16 | b << 8 | c
        lo, hi = np.searchsorted(self.keys, [code << _ROW_BITS, code + 1 << _ROW_BITS])
        return np.unique(self.keys[lo:hi] & ((1 << _ROW_BITS) - 1))

    def candidates(self, query) -> np.ndarray:
        """The rows that meet a query."""
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, str):
            return self.postings(query)
        found = self.candidates(query[1])
        for part in query[2:]:
            if query[0] == "and" and not len(found):
                break
            own = self.candidates(part)
            found = np.intersect1d(found, own, True) if query[0] == "and" else np.union1d(found, own)
        return found


def _point(text: bytes, at: int) -> int:
    """Code points before byte ``at``."""
    return at if text.isascii() else len(text[:at].decode("utf-8", "replace"))


def find(texts: list[bytes], rules) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, rule number, end) in code points, by start, then rule."""
    segment, out = Segment(texts), [[] for _ in texts]
    for k, rule in enumerate(rules):
        for row in segment.candidates(rule.query):
            text = texts[row]
            out[row] += [(_point(text, a), k, _point(text, b)) for a, b in rule.spans(text)]
    return [sorted(x) for x in out]


_SPANS = "array<struct<kind: string, start: long, end: long>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, rules=BASE_RULES + MORE_RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, spans (kind, start, end in code points) by start, then kind in rule order.

    Matches of one kind are leftmost and do not overlap. Null and empty texts
    have no spans; equal rows give equal rows; an empty table gives none.
    """
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in one]
                         for one in find(utf8(batch.column(1)), rules)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS_ARROW)], ["id", "spans"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, spans {_SPANS}").withColumnRenamed("id", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the checksum of their spans, and all spans as a string."""
    base = [r.kind for r in BASE_RULES]
    written = lambda spans: F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(key, *[count(k).alias(f"n_{k}") for k in base],
                        F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))
