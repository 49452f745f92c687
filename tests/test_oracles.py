"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from labelmill.plans import registry

SQL = registry.oracle_sql()


def rows(df):
    df = df[sorted(df.columns)]
    one = lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float, bool)) or hasattr(v, "dtype") and v.dtype.kind in "ifb" else str(v) if not isinstance(v, datetime.date) else str(v)
    return sorted([tuple(map(one, r)) for r in df.astype(object).itertuples(index=False)], key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf_dir, duck):
    ours, theirs = registry.queries()[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bootstrap_interval_holds_the_mean(spark, sf_dir):
    r = registry.queries()["bootstrap_brier"](spark, sf_dir).first()
    assert r["n_valid"] == 2000 and r["low"] <= r["mean"] <= r["high"]
