"""Every registered query equals its SQL on the smallest shared tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from granulite.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def key(row):
    return tuple((x is None, str(type(x)), x) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    d = QUERIES[name](spark, SF)
    cols = sorted(d.columns)
    got = sorted((tuple(r) for r in d.select(*[f"`{c}`" for c in cols]).collect()), key=key)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-6)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
