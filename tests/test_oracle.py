"""Every registered query with an oracle: Spark result == DuckDB result (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, compare

from .conftest import SF_SMALL

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[key])
    drows = cur.fetchall()
    msg = compare(rows, df.columns, drows, [c[0] for c in cur.description])
    assert msg is None, msg


def test_every_query_has_a_callable():
    q = E.queries()
    assert set(ORACLES) <= set(q)
    assert len(q) >= 100
