"""Registered queries against their SQL, and the shape of some plans."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from seatpool.plans import domain, oracle, queries as registry
from seatpool.sources import readers

QUERIES = registry.registered()


@pytest.fixture(scope="module")
def tables(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle.SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sf_dir, tables, name):
    found = QUERIES[name](spark, sf_dir)
    cursor = tables.execute(oracle.SQL[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert plain(found.collect(), found.columns) == plain(cursor.fetchall(), columns)


def test_groups_come_best_first(spark, sf_dir, tables):
    found = [(r["bids_total"], r["day"], r["title_id"]) for r in QUERIES["ranked_groups"](spark, sf_dir).collect()]
    cursor = tables.execute(oracle.SQL["ranked_groups"])
    at = [[c[0] for c in cursor.description].index(n) for n in ("bids_total", "day", "title_id")]
    assert found == [tuple(row[i] for i in at) for row in cursor.fetchall()]


def plan(rows, capsys) -> str:
    rows.explain("formatted")
    return capsys.readouterr().out


def test_status_filter_and_columns_reach_the_scan(spark, sf_dir, capsys):
    text = plan(readers.available_bids(domain.raw_bids(spark, sf_dir)), capsys)
    assert "o_totalprice" not in text and "l_extendedprice" not in text and "p_retailprice" not in text
    text = plan(domain.interest(spark, sf_dir), capsys)
    assert "EqualTo(o_orderstatus,O)" in text


def test_page_limit_is_applied_before_the_shuffle(spark, sf_dir, capsys):
    text = plan(QUERIES["active_bids_page"](spark, sf_dir), capsys)
    assert "WindowGroupLimit" in text


def test_no_python_functions_and_no_products_in_plans(spark, sf_dir, capsys):
    names = (
        "available_bids", "bid_requests_result", "bookings", "user_active_bids", "group_totals",
    )
    for name in names:
        text = plan(QUERIES[name](spark, sf_dir), capsys)
        for operator in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "NestedLoop"):
            assert operator not in text
