"""The queries that SQL can express against their SQL, at the size the contract checks."""

import pytest

from compare import compare, duck
from findlake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duck(SF)
    con.execute("SET threads = 4")
    r = compare(QUERIES[name](spark, SF), con, ORACLE_SQL[name])
    assert r["match"], r
    types = {f.name: f.dataType.simpleString() for f in QUERIES[name](spark, SF).schema.fields}
    rel = con.sql(ORACLE_SQL[name])
    sql = dict(zip(rel.columns, map(str, rel.types)))
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {k: same[v] for k, v in types.items()} == sql
