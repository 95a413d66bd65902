"""Every catalogue query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from keytable import queries as catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if value != value else repr(round(value, 9))
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return None if value is None else str(value)


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalogue.SQL:
        return
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in found.fetchall()), key=str)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["o_orderkey", "o_totalprice"]
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(catalogue.SQL) <= set(entry.oracle_sql())


def test_without_the_optional_subpackage(tmp_path):
    """The rest imports where the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "keytable", tmp_path / "keytable", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'scan_all' in e.queries() and 'scan_all' in e.oracle_sql(); assert 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
