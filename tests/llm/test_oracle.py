"""The queries that SQL can express against DuckDB, on the small tables and on fixtures."""

import duckdb
import numpy as np
import pytest

from keytable.llm import queries

TABLES = ("documents", "pages", "benchmark", "labels")


def plain(value):
    if isinstance(value, float):
        return None if value != value else repr(round(value, 9))
    return None if value is None else str(value)


def compare(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if folder.startswith('/root') else '/*.parquet'}')")
    df = queries.queries()[name](spark, folder if folder.startswith("/root") else f"file://{folder}")
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in found.fetchall()), key=str)
    return got


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_small_tables(spark, small, name):
    compare(spark, small, name)


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("fixture"))
    rng = np.random.default_rng(4)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    texts = [f"see {''.join(rng.choice(letters, int(n)))} é there" for n in rng.integers(20, 70, 40)]
    texts += [f"a b_c_d_e_f_g_h_i_j_k_{i} x 00000000000000000000aa{i} version-one-point-two-of-the-{i}nd" for i in range(20)]
    texts += ["token:password: abcdefghijklm", "API_KEY='0123456789abcdef' x", None, "", "", "Permission is hereby granted, freely, to any person obtaining a copy of this software", "licensed under the GNU Affero General Public License, version 3", "MIT License and Apache license and MIT license", "K İ licenSe"]
    texts += ["one two three four five six seven eight nine ten", "x one two three four five six seven eight nine ten", "one two", "ONE two"]
    rows = [(None if i == 3 else i // 2 if i < 4 else i, t, "en", [None, "a", "b", "é"][i % 4], 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "seven eight"), (3, None), (None, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, "http://h/x", ["a", None, "", "WARC/1.0 b"][i % 4]) for i in range(9)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", [n for n in sorted(queries.oracle_sql()) if n != "op7_ngram_join"])
def test_fixture(spark, fixture, name):
    rows = compare(spark, fixture, name)
    if name == "op4_secrets":
        assert sum("random" in str(r) for r in rows) >= 30
