"""Every registered frame query against its SQL in DuckDB, on the smallest given tables."""

import os

import duckdb
import pytest

from crestline import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert [str(got[c].dtype) for c in columns] == [str(want[c].dtype) for c in columns]
    rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
    assert len(got)


def test_entry_gives_the_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["label", "shot_id", "rank", "vec_id", "quality"]
    assert set(e.oracle_sql()) <= set(e.queries())
