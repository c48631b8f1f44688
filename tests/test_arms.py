"""Arms against their parts: bootstraps of an arm's excess and without slices; codes and boards."""

import datetime

import pytest
from pyspark.sql import functions as F

from strandline.functions import codes
from strandline.operators import arms, compare, panel


@pytest.fixture(scope="module")
def series(spark):
    day = datetime.date(2020, 1, 1)
    rows = [(day + datetime.timedelta(i), (i * 7 % 11 - 4) / 100.0, (i * 5 % 7 - 3) / 100.0) for i in range(60)]
    both = spark.createDataFrame(rows, "datetime date, a double, b double")
    return both.select("datetime", F.col("a").alias("ret")), both.select("datetime", F.col("b").alias("ret"))


def test_net_excess(series):
    a, b = series
    paired = compare.paired(a, b)
    want = compare.block_bootstrap(paired, compare.block_length(paired), 40, 3).first().asDict()
    got = arms.net_excess(a, b, 40, 3).first().asDict()
    state = got.pop("state")
    assert got == want and state == ("positive" if want["lo"] > 0 else "negative" if want["hi"] < 0 else "undecided")


def test_sliced_bootstrap(series):
    a, b = series
    got = {r.slices: r for r in arms.sliced_bootstrap(a, b, {"all": [], "later": [("2020-01-01", "2020-01-31")]}, 40, 3).collect()}
    assert got["all"].n == 60 and got["later"].n == 29
    late = "datetime > date '2020-01-31'"
    paired = compare.paired(a.where(late), b.where(late))
    assert got["later"].point == pytest.approx(compare.block_bootstrap(paired, compare.block_length(paired), 40, 3).first().point)


def test_dependence_on_a_sleeve_that_is_nowhere(spark):
    effects = spark.createDataFrame([(1, "A", 0.25), (1, "B", 0.75), (2, "A", 0.5), (2, "B", 0.5)], "fold long, group string, total double")
    assert arms.dependence(effects, "C", 2).first().asDict() == {"folds": 2, "share": None}
    assert arms.dependence(effects, "A", 2).first().share == 0.375


def test_codes_and_boards(spark):
    row = spark.range(1).select(codes.to_prefixed(F.lit("600000.HK")).alias("a"), codes.to_suffixed(F.lit("HK600000")).alias("b"), codes.board(F.lit("SH688")).alias("c"), codes.board(F.lit("SH688001")).alias("d")).first()
    assert tuple(row) == ("HK600000", "600000.HK", "other", "star")


@pytest.mark.parametrize("factor", [0.0, -1.0, float("nan"), float("inf")])
def test_bad_factors_are_refused(spark, factor):
    day = datetime.date(2020, 1, 1)
    dense = spark.createDataFrame([(day, "SH600000", 1.0)], "datetime date, instrument string, close double")
    factors = spark.createDataFrame([(day, "SH600000", factor)], "datetime date, instrument string, adj_factor double")
    with pytest.raises(Exception, match="not a positive number"):
        panel.adjusted(dense, factors, ("close",)).collect()
