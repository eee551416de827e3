"""Corpus queries equal their SQL on whole small tables."""

import duckdb
import pytest

from granulite.llm.queries import ORACLES, QUERIES
from tests.test_queries import TABLES, key


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    d = QUERIES[name](spark, f"/root/testdata/{sf}")
    cols = sorted(d.columns)
    got = sorted((tuple(r) for r in d.select(*cols).collect()), key=key)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=key)
    assert got == want and got
