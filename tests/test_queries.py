"""Every registered query with SQL, against that SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    want = rows(columns, result.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, float) for x in a) else repr(a) == repr(b) or all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), name


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"pipeline", "gbt_fit", "forecast_report"}))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.schema == QUERIES[name](spark, SF).schema if name in ("pca_project",) else df.columns
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_are_registered():
    assert set(ORACLES) <= set(QUERIES)
