"""Text functions agree with Python's own str.lower / str.strip / str.split on random Unicode."""

from itertools import groupby

from hypothesis import given, settings
from hypothesis import strategies as st

from findlake.functions import paths as P
from findlake.functions import text as X

# Letters, separators and white space that Python and Java treat differently unless handled.
ALPHABET = "aB9._- \t\n  　\x1c\x1d\x1e\x1f\u0085ÉİΣẞ"


def _runs(text: str, separators: str) -> list[str]:
    """Maximal runs of characters that neither separate nor are white space, one character at a time."""
    return ["".join(run) for apart, run in groupby(text, lambda c: c in separators or c.isspace()) if not apart]


def _py_suffix(name: str) -> str:
    name = name.lower()
    i = name.rfind(".")
    return name[i:] if 0 < i < len(name) - 1 else ""


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, min_size=0, max_size=12), min_size=40, max_size=40))
def test_text_functions_match_python(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "s string")
    rows = df.select(
        "s",
        X.case_fold("s").alias("lower"),
        X.normalise_query("s").alias("q"),
        X.tokenise_name(X.case_fold("s")).alias("name_words"),
        X.tokenise_query(X.normalise_query("s")).alias("query_words"),
        X.is_blank("s").alias("blank"),
        P.suffix_of("s").alias("suffix"),
    ).collect()
    for r in rows:
        s = r.s
        assert r.lower == s.lower(), repr(s)
        assert r.q == s.lower().strip(), repr(s)
        assert r.blank == (not s.strip()), repr(s)
        assert r.name_words == [w for w in _runs(s.lower(), "._-") if w[2:]], repr(s)
        assert set(r.query_words) == set(_runs(s.lower(), "._")) and len(set(r.query_words)) == len(r.query_words), repr(s)
        if "/" not in s and "\n" not in s:
            assert r.suffix == _py_suffix(s), repr(s)
