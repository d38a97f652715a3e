"""Every query of the engine against its SQL, on the smallest data."""

import duckdb
import pytest

from quadrille.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF), db.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(map(repr, want.project(", ".join(f'"{c}"' for c in cols)).fetchall()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
