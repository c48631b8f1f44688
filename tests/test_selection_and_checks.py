"""Cases that the test tables do not have: missing metrics, names without later closes, repeated keys, empty inputs."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from strandline.operators import selection, universe, validation

D = datetime.date


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_drift_names_each_reason(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 2.0), ("d", 3.0), ("e", None), ("f", 5.0)], "metric string, value double")
    now = spark.createDataFrame([("a", 1.2), ("b", 0.5), ("d", float("nan")), ("e", 1.0), ("f", 5.0), ("new", 1.0)], "metric string, value double")
    assert rows(selection.drifted(now, base, 0.1).select("metric", "why")) == [("a", "relative"), ("b", "absolute"), ("c", "missing"), ("d", "no number")]


def test_held_returns_states(spark):
    bars = spark.createDataFrame(
        [(D(2020, 1, 1), "A", 10.0), (D(2020, 1, 3), "A", 12.0), (D(2020, 1, 1), "B", 10.0), (D(2020, 1, 2), "B", 11.0), (D(2020, 1, 3), "B", None), (D(2020, 1, 1), "C", 10.0), (D(2020, 1, 2), "D", 10.0)],
        "datetime date, instrument string, close double",
    )
    stamps = spark.createDataFrame([(D(2019, 12, 31), D(2020, 1, 1), D(2020, 1, 3))], "signal date, execution date, horizon_end date")
    got = {r["instrument"]: (round(r["ret"], 9), r["state"]) for r in selection.held_returns(bars, stamps).collect()}
    assert got == {"A": (0.2, "held"), "B": (0.1, "truncated"), "C": (0.0, "flat")}


def test_scores_of_both_modes(spark):
    b = spark.createDataFrame([("x", 0.1, -0.2, 0.5, 0.3, True), ("y", None, 0.1, 0.1, 0.1, True), ("z", 0.1, 0.1, 0.1, 0.1, False)], "factor string, ic double, rank_ic double, ir double, mean_abs_change double, valid boolean")

    def run(mode):
        return {r["factor"]: r["score"] for r in selection.scored(b, F.lit(4), F.lit(0.25), F.lit(0.5), 0.3, mode, selection.WEIGHTS | {"baseline": 2.0}).collect()}

    full, rank = run("full"), run("rank")
    assert math.isclose(full["x"], 0.1 + 0.25 + 0.1 - 0.2 * 0.3 * 252 * 0.003 - 0.2 - 0.04 - 0.4)
    assert math.isclose(rank["x"], 0.2 - 0.04 - 0.4)
    assert full["y"] == full["z"] == rank["y"] == rank["z"] == float("-inf")


def test_kept_apart_follows_the_best(spark):
    scores = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0), ("d", 1.0)], "factor string, score double")
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.9), ("c", "d", 0.8), ("a", "d", 0.1)], "a string, b string, corr double")
    assert rows(selection.kept_apart(scores, pairs, 0.7)) == [("a", True), ("b", False), ("c", True), ("d", False)]
    assert rows(selection.kept_apart(scores.limit(0), pairs, 0.7)) == []


def test_lists_and_overlays(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("y", 1), ("z", 3), ("z", 4)], "k string, v int")
    assert rows(universe.first_of_lists("k", a, b)) == [("x", 1), ("y", 2), ("z", 3)]
    day = spark.createDataFrame([(D(2020, 1, 1), "A"), (D(2020, 1, 1), "B"), (D(2020, 1, 2), "A")], "datetime date, instrument string")
    new = spark.createDataFrame([(D(2020, 1, 1), "C")], "datetime date, instrument string")
    assert rows(universe.overlaid(day, new)) == [(D(2020, 1, 1), "C"), (D(2020, 1, 2), "A")]


def test_checks_find_absent_and_repeated(spark):
    want = spark.createDataFrame([("A", 1), ("B", 2)], "instrument string, n int")
    found = spark.createDataFrame([("A",), ("A",), ("C",)], "instrument string")
    assert rows(validation.absent(want, found, "instrument")) == [("B", 2)]
    assert rows(validation.repeated(found, "instrument")) == [("A", 2)]
    assert rows(validation.calendar_defects(spark.createDataFrame([], "cal_date string, is_open int"))) == [(0, 0, 0, 0, 0, 0)]


def test_flat_trials_leave_the_bar(spark):
    flat = spark.createDataFrame([("a", i, 1.0) for i in range(8)] + [("b", i, float(i)) for i in range(8)], "trial string, pos int, x double")
    # A trial that never varies has no valid draw, so redrawing ends in an error; a bar without draws lets nothing pass.
    with pytest.raises(ValueError, match="does not vary"):
        selection.family_draws(flat, 5, 1)
    none = spark.createDataFrame([(b, None) for b in range(5)], "b long, max_t double")
    assert {r["trial"]: r["passed"] for r in selection.adjudicated(flat, none).collect()} == {"a": False, "b": False}
