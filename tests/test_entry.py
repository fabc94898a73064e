"""Driver contract: entry() runs, every query has a callable, and the queries with
an oracle agree with DuckDB on sf0.001."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from statuta.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["item_id", "doc_id", "score"]
    assert df.count() > 0


def test_contract_keys():
    assert set(E.oracle_sql()) <= set(E.queries())


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    drows = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert srows == drows


def test_every_query_of_the_catalogue_has_an_oracle():
    from statuta.plans.catalog import REGISTRY

    assert set(REGISTRY) <= set(E.oracle_sql())


def test_python_workers_outside_the_repo(tmp_path):
    """The shred runs in Python workers; it must work when the driver process is
    started outside the repository (workers then cannot import the package)."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.ui.showConsoleProgress', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "print('ROWS', E.queries()['element_counts'](spark, %r).count())\n" % (repo, SF))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
