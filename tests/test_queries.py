"""Every registered query with SQL against DuckDB, and that the registry stands without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quillon.plans.queries import QUERIES, SQL

REPO = Path(__file__).resolve().parent.parent


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return list(df.columns), sorted(repr([round(float(x), 5) if isinstance(x, (float, int)) and not isinstance(x, bool) else x for x in r]) for r in df.values.tolist())


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, con, name):
    assert plain(QUERIES[name](spark, sf_dir).toPandas()) == plain(con.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(5).count() > 0


def test_entry_stands_alone():
    """Imports with the subpackage and the pipeline hidden."""
    code = "import sys; sys.modules['quillon.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') and n[2:3].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
