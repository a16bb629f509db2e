"""Every query that SQL can express, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quarry.plans import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def frame(df):
    columns = sorted(df.columns)
    return df[columns].map(lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)).sort_values(columns).reset_index(drop=True)


@pytest.mark.skipif(not Path(DIR).exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ORACLES)
def test_same_rows(spark, sql, name):
    found, expected = frame(QUERIES[name](spark, DIR).toPandas()), frame(sql.sql(ORACLES[name]).df())
    assert list(found.columns) == list(expected.columns)
    assert found.equals(expected)


def test_all_have_sql():
    assert QUERIES.keys() == ORACLES.keys()
