"""Each registered query of the panel library against its SQL, whole tables, value by value."""

import datetime
import decimal
import math

import duckdb
import pytest

from strandline.plans import catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Types whose values the comparison takes as one.
WHOLE, TEXT = {"tinyint", "smallint", "int", "bigint", "integer"}, {"string", "varchar"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def kind(name):
    name = name.lower()
    return "whole" if name in WHOLE else "text" if name in TEXT else name.replace("timestamp_ntz", "timestamp")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, decimal.Decimal):
        raise AssertionError("a decimal where a double or a whole number is due")
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


def sorted_rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.all_queries()))
def test_same_as_sql(spark, duck, sf_dir, name):
    got = catalog.all_queries()[name](spark, sf_dir)
    want = duck.sql(catalog.all_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert {c: kind(t) for c, t in got.dtypes} == {c: kind(str(t)) for c, t in zip(want.columns, want.types)}
    assert sorted_rows([tuple(r) for r in got.collect()], got.columns) == sorted_rows(want.fetchall(), want.columns)
