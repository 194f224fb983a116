"""Every catalogue query against its SQL on the smallest tables, as sorted rows."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from lodewell.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    done = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in done.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["version", "o_custkey", "kind", "before", "after", "kind_ord"]
    assert df.count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def differences(spark, folder, name, **tables):
    """(rows only the query has, rows only its SQL has) over the given DuckDB tables."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.sql(f"copy ({sql}) to '{folder}/{table}.parquet'")
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    want = Counter(map(lambda r: tuple(map(plain, r)), con.execute(f"select {', '.join(sorted(df.columns))} from ({catalog.ORACLE[name]})").fetchall()))
    return got - want, want - got


def test_human_size_of_large_and_null_keys(spark, tmp_path):
    keys = "select unnest([0, 18, 19, 59, 591, 1869, 5912, 18918, 18919, 90000, 900000, 20000000, null]::bigint[]) as c_custkey"
    assert differences(spark, tmp_path, "q_human_size", customer=keys) == (Counter(), Counter())


def test_overlap_flag_rounds_seconds_as_its_sql(spark, tmp_path):
    rows = [  # a click's minute ends, or a session's two hours do, within a second of the other's start
        (1, "2024-01-01 00:00:00.4", 1, "click"), (2, "2024-01-01 00:01:00.2", 1, "purchase"),
        (3, "2024-01-01 00:00:00.5", 2, "click"), (4, "2024-01-01 00:00:59.6", 2, "purchase"),
        (5, "2024-01-01 00:00:00.7", 4, "click"), (6, "2024-01-01 00:01:00.2", 4, "purchase"),
        (7, "2024-01-01 02:00:01.5", 5, "click"), (8, "2024-01-01 00:00:00.5", 5, "purchase"),
        (9, "2024-01-01 02:00:00.9", 7, "click"), (10, "2024-01-01 00:00:01.1", 7, "purchase"),
        (11, "1969-12-31 23:59:58.5", 8, "click"), (12, "1970-01-01 00:00:58.5", 8, "purchase"),
        (13, "2024-01-01 00:00:00.7", 3, "click"), (14, "2024-01-01 00:00:00.7", 3, "purchase"),
        (15, "2024-01-01 00:00:00.7", 10, "click"), (16, "2024-01-01 09:00:00.7", 10, "error"),
        (1, "2024-01-05 00:00:00.4", 1, "click"), (5, "2024-01-05 00:00:00.7", 1, "click"),
        ("null", "2024-01-01 00:00:30", 1, "click"), (17, "2024-01-01 00:00:30", "null", "click"),
    ]
    events = "select * from (values " + ", ".join(f"({i}::bigint, timestamp '{ts}', {user}::bigint, '{kind}')" for i, ts, user, kind in rows) + ") v(event_id, ts, user_id, event_type)"
    assert differences(spark, tmp_path, "q_overlap_flag", events=events) == (Counter(), Counter())
