"""Each query of the reference's operators gives the rows of its SQL; those without SQL are compared elsewhere."""

import datetime
import decimal
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from townscribe.plans import catalog, registry
from townscribe.sources.tables import TABLES

catalog.load()


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return str([plain(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, float | np.floating | decimal.Decimal):
        return round(float(v), 6)
    return str(v) if isinstance(v, datetime.date) else v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, data, con, name):
    got, want = registry.QUERIES[name](spark, data).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert len(df.columns) >= 2
    assert df.count() > 0  # what the rows must be: test_brute, test_whole_tables, test_operators


def test_every_sql_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_the_rest_imports_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/townscribe", tmp_path / "townscribe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'entity_rollup' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
