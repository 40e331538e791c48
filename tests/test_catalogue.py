"""Every registered query of the main library against the same question in DuckDB's SQL."""

import datetime
import decimal
import math

import duckdb
import pytest

from terralode.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    sql = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, sql.fetchall())


def test_visible_labels(spark, sf_dir):
    """A query without SQL, against choosing one after the other."""
    shown = {}
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").collect()
    for r in sorted(rows, key=lambda r: (r.o_orderkey % 3 != 0, -round(r.o_totalprice, 2), r.o_orderkey)):
        x, y = r.o_orderkey * 37 % 800, r.o_orderkey * 91 % 600
        kept = shown.setdefault(r.o_custkey % 40, [])
        if all((x - a) ** 2 + (y - b) ** 2 >= 1600 for _, a, b in kept):
            kept.append((r.o_orderkey, x, y))
    want = {(s, i) for s, kept in shown.items() for i, _, _ in kept}
    got = {(r.screen, r.id) for r in catalogue.queries()["visible_labels"](spark, sf_dir).collect()}
    assert got == want and set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"visible_labels", "random_points"}


def test_random_points(spark, sf_dir):
    """Points lie in their kites, three each at most and most of them three, and are the same each time."""
    run = lambda: sorted(map(tuple, catalogue.queries()["random_points"](spark, sf_dir).collect()))
    got = run()
    assert got == run() and len({r[:2] for r in got}) == len(got) and 60 <= len(got) <= 75
    for nation, k, x, y in got:
        cx, cy = nation % 5 * 200 + 100, nation // 5 * 200 + 100
        ring = [(cx - 90 - nation % 7, cy), (cx, cy - 80), (cx + 95, cy + nation % 5), (cx + nation % 9, cy + 90)]
        assert 1 <= k <= 3 and all((bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0 for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True))
