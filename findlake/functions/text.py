"""Column expressions for names and queries (case folding, tokens, validity).

All of these are built-in Spark expressions, so they run inside whole-stage
codegen on the executors; no Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must match the reference's behaviour -------------------
# Words of a name are indexed only when longer than this many characters.
MIN_WORD_LENGTH = 2
# Characters turned into spaces before a *name* is split into words.
NAME_WORD_SEPARATORS = "._-"
# Characters turned into spaces before a *query* is split into words ('-' is kept).
QUERY_WORD_SEPARATORS = "._"
# Characters a new name may not contain.
RESERVED_NAME_CHARS = '<>:"|?*'
# Substrings that mark a name as a directory-traversal attempt.
TRAVERSAL_PATTERNS = ("../", "..\\")
# -----------------------------------------------------------------------------

# Python's str.split()/str.strip() white space: Unicode White_Space plus the
# four information separators U+001C..U+001F. Java's (?U)\s lacks the latter.
WS_CLASS = r"[\s\x1c-\x1f]"
WS_RUN = "(?U)" + WS_CLASS + "+"
_EDGE_WS = "(?U)^" + WS_CLASS + "+|" + WS_CLASS + "+$"
_RESERVED_RE = "[" + "".join("\\" + c for c in RESERVED_NAME_CHARS) + "]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def case_fold(c) -> Column:
    """Lower-case a name, path, prefix or query (same code points as Python)."""
    return F.lower(_col(c))


def strip_ws(c) -> Column:
    """Strip Python white space at both ends (``trim`` strips blanks only)."""
    return F.regexp_replace(_col(c), _EDGE_WS, "")


def is_blank(c) -> Column:
    """True for NULL, empty or white-space-only strings."""
    c = _col(c)
    return c.isNull() | (strip_ws(c) == "")


def normalise_query(raw) -> Column:
    """Lower-case, then strip white space at both ends."""
    return strip_ws(case_fold(raw))


def _split_words(c: Column, separators: str) -> Column:
    return F.split(F.translate(c, separators, " " * len(separators)), WS_RUN)


def tokenise_name(name_lc) -> Column:
    """Indexed words of a lower-cased name: '.', '_', '-' split; longer than 2."""
    return F.filter(_split_words(_col(name_lc), NAME_WORD_SEPARATORS),
                    lambda w: F.length(w) > MIN_WORD_LENGTH)


def tokenise_query(q) -> Column:
    """Words of a normalised query: '.', '_' split, '-' kept, short words kept."""
    return F.array_distinct(F.filter(_split_words(_col(q), QUERY_WORD_SEPARATORS),
                                     lambda w: w != ""))


def unsafe_name_reason(name) -> Column:
    """Why a new file or folder name is rejected, or NULL when it is accepted.

    Same rule as the reference's validity check: not blank, no traversal
    pattern (case-insensitive), none of the reserved characters.
    """
    name = _col(name)
    lowered = F.lower(name)
    traversal = None
    for pattern in TRAVERSAL_PATTERNS:
        hit = lowered.contains(pattern)
        traversal = hit if traversal is None else (traversal | hit)
    return (F.when(is_blank(name), F.lit("blank"))
            .when(traversal, F.lit("traversal"))
            .when(name.rlike(_RESERVED_RE), F.lit("reserved_char")))


def is_safe_name(name) -> Column:
    return unsafe_name_reason(name).isNull()
