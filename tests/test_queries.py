"""Each registered query of the engine against its SQL, on the smallest tables."""

import glob
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from weftmap import queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def same(x, y):
    if x is None or y is None:
        return x is y
    return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) else x == y


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=str)
    found = db.execute(queries.ORACLE_SQL[name])
    places = [[c[0] for c in found.description].index(c) for c in columns]
    assert len(places) == len(found.description)
    want = sorted((tuple(r[k] for k in places) for r in found.fetchall()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(map(same, g, w)), (g, w)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 1000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_training_data_operators(tmp_path):
    """The rest imports and has its queries when that subpackage and its pipeline are gone."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; assert set(e.queries()) and not [k for k in e.queries() if k.startswith('op') and k[2].isdigit()]; import weftmap.cli, weftmap.streaming.ingest"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": ""}, check=True)
