import json
import re
from collections import defaultdict

from findlake.llm import toolchat as T
from findlake.llm.queries import op1_tool_chat

CALLS = "conv_id string, turn long, call_id string, tool string, arguments string, depends_on array<string>, kind int"
RESULTS = "conv_id string, turn long, call_id string, content string, level string"
MESSAGES = "conv_id string, turn long, role string, content string, json string"
GOOD = '{"limit": 3, "query": "a"}'


def frames(spark, calls, results, messages):
    return (spark.createDataFrame([(*m, "z") for m in messages], MESSAGES),
            spark.createDataFrame([(*c, 1) for c in calls], CALLS),
            spark.createDataFrame([(*r, "l") for r in results], RESULTS))


def run(spark, calls, results=(), messages=()):
    rows = T.formatted(*frames(spark, calls, results, messages), T.SCHEMAS).collect()
    return sorted(rows, key=lambda r: (str(r.conv_id), r.position))


def test_order_links_and_status(spark):
    calls = [("c", 9, "d", "search", GOOD, ["b", "a"]), ("c", 1, "a", "search", GOOD, []),
             ("c", 0, "b", "search", GOOD, ["a", "gone"]), ("c", 2, "a", "search", GOOD, ["d"]),
             ("c", 3, "x", "search", GOOD, ["y"]), ("c", 3, "y", "search", GOOD, ["x"]),
             ("c", 4, "z", "search", GOOD, ["x"]), ("c", 5, None, "search", GOOD, None),
             (None, 0, "a", "search", GOOD, ["a2"]), (None, 5, "a2", "search", GOOD, None)]
    results = [("c", 2, "a", "first"), ("c", 4, "a", "late"), ("c", 3, "zz", None), (None, 1, "a", "of null"),
               ("c", 3, None, "loose")]
    rows = run(spark, calls, results, [("c", 0, "system", "hi"), (None, None, None, None)])
    c = [r for r in rows if r.conv_id == "c"]
    assert [r.position for r in c] == list(range(len(c)))
    assert [(r.kind, r.call_id, r.level, r.status) for r in c] == [
        ("message", None, None, "message"), ("call", "a", 0, "ok"), ("call", "b", 1, "no_result"),
        ("call", "d", 2, "no_result"), ("call", "a", None, "duplicate"), ("call", "x", None, "cycle"),
        ("call", "y", None, "cycle"), ("call", "z", None, "cycle"), ("call", None, None, "no_id"),
        ("result", None, None, "orphan"), ("result", "zz", None, "orphan"), ("result", "a", None, "extra")]
    assert json.loads(c[1].json)["result"] == "first" and json.loads(c[2].json)["missing"] == 1
    null = [r for r in rows if r.conv_id is None]
    assert [(r.call_id, r.level) for r in null] == [(None, None), ("a2", 0), ("a", 1)]
    assert json.loads(null[2].json)["result"] == "of null"


def test_validation_and_canonical_json(spark):
    cases = {GOOD: "", '{"query":"a"}': "missing:limit", '{"limit":"3","query":1}': "type:limit,type:query",
             '{"limit":51,"query":"","zz":null}': "range:limit,unknown:zz", "[1]": "not_object", "{": "not_object",
             '{"a":1,"a":2}': "not_object", "": "not_object", '{"limit":null,"query":"x"}': "type:limit"}
    calls = [("c", i, str(i), "search", a, []) for i, a in enumerate(cases)]
    calls += [("c", 50, "n", "search", None, []), ("c", 51, "u", "nothing", GOOD, []), ("c", 52, "v", None, GOOD, []),
              ("c", 53, "t", "translate", '{"to":"it","text":"é\\n\\"q\\""}', []),
              ("c", 54, "s", "summarise", '{"ratio": 0.50, "text": "' + "long " * 50_000 + '"}', [])]
    rows = {r.call_id: r for r in run(spark, calls)}
    want = dict(zip(map(str, range(len(cases))), cases.values()))
    want |= {"n": "not_object", "u": "unknown_tool", "v": "unknown_tool", "t": "enum:to", "s": ""}
    assert {k: r.errors for k, r in rows.items()} == want
    for r in rows.values():
        record = json.loads(r.json)
        assert json.dumps(record, ensure_ascii=False, sort_keys=True, separators=(",", ":")) == r.json
    assert rows["0"].json.startswith('{"arguments":{"limit":3,"query":"a"},"depends_on":[]')


def test_deep_chain(spark):
    calls = [("c", 100 - i, f"k{i}", "search", GOOD, [f"k{i - 1}"] if i else []) for i in range(12)]
    rows = run(spark, calls + calls[:1])
    assert [r.call_id for r in rows if r.status != "duplicate"] == [f"k{i}" for i in range(12)]


def test_empty_tables(spark):
    assert run(spark, []) == []


def test_query_covers_the_table_in_order(spark):
    sf = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    rows = op1_tool_chat(spark, sf)
    assert not re.search("Python|Pandas|Arrow", rows._jdf.queryExecution().executedPlan().toString())
    rows, by = rows.collect(), defaultdict(list)
    answers = {(c, t - 1): x for c, t, r, x in table if r == "assistant"}
    users = {(c, t): x for c, t, r, x in table if r == "user"}
    assert sum(r.kind == "call" for r in rows) == len(users)
    assert sum(r.kind == "message" for r in rows) == sum(r == "system" for _, _, r, _ in table)
    assert sum(r.kind == "result" for r in rows) == len(set(answers) - set(users))
    for r in rows:
        by[r.conv_id].append(r)
        if r.kind == "call":
            c, t = map(int, r.call_id.split("-"))
            record = json.loads(r.json)
            assert users[c, t] in record["arguments"].values() and record.get("result") == answers.get((c, t))
    for one in by.values():
        one.sort(key=lambda r: r.position)
        assert [r.position for r in one] == list(range(len(one)))
        at = {r.call_id: r.position for r in one if r.kind == "call"}
        for r in one:
            if r.kind == "call":
                assert all(at[d] < r.position for d in json.loads(r.json)["depends_on"] if d in at)
