import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from findlake.llm import secrets as S
from findlake.llm.queries import op3_secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)


def base_spans(text):
    """Base spans straight from the three expressions."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def row(key, text):
    spans = base_spans(text or "")
    line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    return (key, *[sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(line.encode()).hexdigest())


TEXTS = [None, "", "é PassWord = 'hunter22' token:abc api_key=\"Zz/9+._=-\"", "AKIA" + "A1" * 8 + "x AKIAAKIA",
         "deadbeef" * 3 + "g" + "0" * 23 + " " + "a" * 5000, "apikey=abcdef passwd:short1 secret", "ſecret=longenough",
         "toKen=longenough1 PASSWORD=password=password", "ü" * 200_000 + "secret: abcdefgh",
         "ghp_" + "a" * 36 + " AIza" + "b" * 35 + " -----BEGIN RSA PRIVATE KEY-----", "AKIA" * 9]


def test_matches_plain_expressions(spark):
    rows = [(i % 7 if i else None, t, "x") for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = S.digest(S.scan_secrets(df)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted((row(k, t) for k, t, _ in rows), key=repr)
    more = {s.split(":")[0] for r in got for s in r.spans.split(",")}
    assert {"github", "google", "pem"} <= more


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.digest(S.scan_secrets(df)).count() == 0


def test_queries_of_rules():
    assert S.trigram_query(r"[0-9a-f]{24,}") is True
    assert S.trigram_query("AKIA[A-Z0-9]+") == ("and", "aki", "kia")
    assert S.trigram_query("(foo|barn)") == ("or", ("and", "bar", "arn"), "foo")
    assert S.trigram_query("ab(c|de)[0-9]+f") == ("or", "abc", ("and", "abd", "bde"))
    assert S.trigram_query("a*bc(d|e)+") is True and S.trigram_query("a*bcd") == "bcd"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="akKiIA09 =:\"'passwordtoken_y", max_size=60), max_size=8), st.integers(0, 9**6))
def test_segment_loses_no_match(texts, seed):
    rng = random.Random(seed)
    texts = [t + rng.choice(["", "token=abcdefg", "AKIA" + "Z" * 16, "api_key:123456"]) for t in texts]
    got = S.find([t.encode() for t in texts], S.BASE_RULES)
    assert got == [base_spans(t) for t in texts]


def test_query_matches_plain_expressions(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op3_secrets(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(row(k, t) for k, t in docs)
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0
