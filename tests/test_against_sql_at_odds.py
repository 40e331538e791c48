"""Queries against their SQL on small tables with values that the given ones hold only when they are larger."""

import datetime

import duckdb
import pytest

from terralode.plans import catalogue
from tests.test_catalogue import rows


def _agree(spark, folder, name, **tables):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df, sql = catalogue.queries()[name](spark, str(folder)), con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    got = rows(df.columns, df.collect())
    assert sorted(columns) == sorted(df.columns) and got == rows(columns, sql.fetchall())
    return [r.asDict() for r in df.collect()]


def test_csv_uploads(spark, tmp_path):
    """Zeros below zero, halves, large and small balances; quotes, commas, blanks and nulls in names."""
    odd = [-0.0, -0.004, 1.005, 12_345_678.5, 1e9, 0.001, -2.675, 100.0, None]
    names = ['a "b", c', "d\\", " e ", None, "f\ng", "h", "i", "j", "k"]
    customer = spark.createDataFrame([(i + 1, n, 1, b, None if i == 6 else "S") for i, (b, n) in enumerate(zip(odd, names, strict=True))], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    got = {r["cuit"]: (r["apellido"], r["hectareas"]) for r in _agree(spark, tmp_path, "csv_uploads", customer=customer)}
    assert [got[str(i + 1)][1] for i in range(9)] == ["0.0", "0.0", "1.01", "12345678.5", "1000000000.0", "0.0", "-2.68", "100.0", ""]
    assert [got[str(i + 1)][0] for i in range(9)] == [n or "" for n in names]


def test_mean_ranking(spark, tmp_path):
    """Means that end in half of the last digit, and keys that outweigh a cent."""
    supplier = spark.createDataFrame([(n * 40 + i, n, 0.01 * (n * 7 + (i < n)) * (-1) ** n) for n in range(40) for i in range(40)], "s_suppkey long, s_nationkey int, s_acctbal double")
    customer = spark.createDataFrame([(50_000, 3, 1.00), (10, 3, 1.01), (7, 4, None), (9, 4, 2.0)], "c_custkey long, c_nationkey int, c_acctbal double")
    got = {r["nation"]: (r["mean"], r["least"]) for r in _agree(spark, tmp_path, "mean_ranking", supplier=supplier, customer=customer)}
    assert got[3] == (pytest.approx(-21.08), 50_000) and got[4] == (pytest.approx(28.1), 9) and got[1][0] == -7.03


def test_rate_limit_window(spark, tmp_path):
    """Parts of seconds on either side of a day."""
    at = datetime.datetime(2024, 1, 1, 0, 0, 0, 600_000)
    later = [datetime.timedelta(), datetime.timedelta(days=1), datetime.timedelta(days=1, microseconds=1), datetime.timedelta(seconds=86_400.7), datetime.timedelta(days=2, seconds=0.3)]
    events = spark.createDataFrame([(i, at + d, 1) for i, d in enumerate(later)], "event_id long, ts timestamp_ntz, user_id long")
    got = {r["event_id"]: r["in_window"] for r in _agree(spark, tmp_path, "rate_limit_window", events=events)}
    assert got == {0: 1, 1: 2, 2: 2, 3: 3, 4: 2}
