"""Served panels and their judge, the plan of nested factors, correlations by blocks."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import factors as f
from strandline.operators import correlations, evaluation, mined, selection, served

D = datetime.date


def day(n):
    return D(2024, 1, 1) + datetime.timedelta(n)


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame([(day(i), i) for i in range(0, 20, 2)], "datetime date, idx int").withColumn("idx", (F.col("idx") / 2).cast("int"))


Q = {1: D(2023, 3, 31), 2: D(2023, 6, 30), 3: D(2023, 9, 30)}


@pytest.fixture(scope="module")
def record(spark):
    rows = [("x", "a", Q[1], day(2)), ("x", "a", Q[2], day(6)), ("x", "b", Q[2], day(4)), ("x", "b", Q[1], day(8)), ("y", "a", Q[1], day(16)), ("y", "a", Q[3], None)]
    return spark.createDataFrame(rows, "source string, code string, period date, available_from date")


def test_moves_of_winners(spark, days, record):
    got = served.winner_moves(record, days, days, 2)
    # Delayed by two of the days that are four dates apart in all; the second name's old quarter never wins.
    want = {("x", "a", 2, None, None), ("x", "a", 4), ("x", "a", 6), ("x", "a", 8), ("x", "b", 4), ("x", "b", 6), ("y", "a", 16), ("y", "a", 18)}
    assert {(r.source, r.code, (r.datetime - day(0)).days) for r in got.collect()} == {w[:3] for w in want}
    old = got.where("code = 'a' and source = 'x'").orderBy("datetime").collect()
    assert [(r.base_period, r.shifted_period) for r in old] == [(Q[1], None), (Q[1], None), (Q[2], Q[1]), (Q[2], Q[1])]
    with pytest.raises(ValueError):
        served.winner_moves(record, days, days, 0)


def test_delay_past_the_calendar(days, record):
    assert [r.available_from for r in served.delayed(record.where("source = 'y'"), days, 2).collect()] == [None, None]
    assert served.delayed(record.where("code = 'b'"), days, 1).agg(F.max("available_from")).first()[0] == day(10)


def panel(spark, rows):
    return spark.createDataFrame(rows, "source string, code string, datetime date, period date")


def test_verdicts(spark):
    moves = spark.createDataFrame([("x", "a", day(4), Q[1], None), ("x", "a", day(6), Q[2], Q[1])], "source string, code string, datetime date, base_period date, shifted_period date")
    base = panel(spark, [("x", "a", day(4), Q[1]), ("x", "a", day(6), Q[2]), ("x", "z", day(6), Q[3])])
    later = panel(spark, [("x", "a", day(4), None), ("x", "a", day(6), Q[1])])

    def verdict(one, two, of=moves):
        judged = served.judged_moves(of, one, two)
        return served.shift_verdict(judged).first()[:], [v for r in judged.orderBy("datetime").collect() for v in r.violations]

    assert verdict(base, later) == ((2, 0, "OK"), [])
    blind = verdict(base, base)
    assert blind[0][2] == "REFUSE" and blind[1] == ["served the same in spite of the delay"] * 2
    # An expected NULL must be said, not left out.
    assert verdict(base, later.where("period is not null")) == ((2, 1, "REFUSE"), ["no delayed row"])
    assert verdict(base.where("datetime > date '2024-01-06'"), later) == ((2, 1, "REFUSE"), ["no row"])
    assert verdict(panel(spark, []), panel(spark, []))[0] == (2, 4, "REFUSE")
    assert verdict(later, later)[1] == ["served another period", "served another period"]
    assert verdict(base, base, moves.where("false")) == ((0, 0, "INCONCLUSIVE"), [])


def test_panel_of_two_sources(spark, days):
    one = spark.createDataFrame([("a", Q[1], day(2), 1.0), ("a", Q[2], day(6), 2.0), ("b", Q[2], day(4), None)], "code string, period date, available_from date, v double")
    two = spark.createDataFrame([("a", Q[2], day(4), 5.0, 6.0), ("a", Q[1], day(10), 3.0, 4.0), ("a", Q[3], None, 9.0, 9.0)], "code string, period date, available_from date, w double, u double")
    codes = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    fields = {"one": ("v",), "two": ("w", "u")}
    got = served.fundamental_panel({"one": one, "two": two}, fields, days, codes, prior=True)
    assert got.count() == 30
    at = {(r.code, (r.datetime - day(0)).days): r for r in got.collect()}
    assert [at["a", i].v for i in (0, 2, 4, 6)] == [None, 1.0, 1.0, 2.0] and [at["a", i].v_prior for i in (4, 6)] == [None, 1.0]
    assert [(at["a", i].w, at["a", i].w_prior, at["a", i].two_prior_period) for i in (2, 8, 10)] == [(None, None, None), (5.0, None, None), (5.0, 3.0, Q[1])]
    assert (at["b", 4].v, at["b", 4].one_available, at["b", 4].one_period) == (None, day(4), Q[2])
    assert at["c", 18].one_period is None
    assert served.fundamental_defects(got, fields, prior=True).count() == 0
    late = got.withColumn("one_available", F.when(F.col("code") == "b", F.date_add("one_available", 3)).otherwise(F.col("one_available")))
    assert {(r.code, r.source, r.defect) for r in served.fundamental_defects(late, fields).collect()} == {("b", "one", "after the day")}
    gone = got.withColumns({"two_available": F.when(F.col("datetime") < F.lit(day(9)), F.col("two_available")), "one_period": F.when(F.col("code") != "b", F.col("one_period"))})
    assert {(r.code, r.source, r.defect) for r in served.fundamental_defects(gone, fields).collect()} == {("a", "two", "no evidence"), ("b", "one", "no period")}
    back = got.withColumn("one_available", F.when(F.col("datetime") == F.lit(day(10)), F.lit(day(3))).otherwise(F.col("one_available")))
    assert {(r.code, r.defect) for r in served.fundamental_defects(back, fields).collect()} == {("a", "went back"), ("b", "went back")} | {("c", "no period")}
    for bad in ({"one": ("v", "v")}, {"one": ()}, {"one": ("v",)}):
        with pytest.raises(ValueError):
            served.fundamental_panel({"one": one, "two": two}, bad, days, codes)


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    rows = [(day(t), f"n{i}", float(rng.normal() + 10) if rng.random() > 0.05 else None, float(rng.integers(1, 50))) for i in range(6) for t in range(40)]
    path = str(tmp_path_factory.mktemp("panel") / "dense")
    spark.createDataFrame(rows, "datetime date, instrument string, close double, volume double").write.parquet(path)
    return spark.read.parquet(path)


MEAN = ("ts_mean", "close", 5)


def exchanges(df):
    """Keys of the exchanges, the first one last."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1].split("#")[0] for line in text.splitlines() if "Exchange hashpartitioning" in line]


def test_nested_factors_share_exchanges(dense):
    pool = [(("cs_rank", MEAN), 1.0), (("cs_zscore", ("ts_std", ("ts_delta", MEAN, 1), 5)), 0.5), (("ts_max", ("ts_min", MEAN, 5), 5), 0.25), (("sub", ("cs_rank", MEAN), ("cs_demean", "volume")), 2.0)]
    got = mined.feature_matrix(dense, pool)
    assert exchanges(got) == ["datetime", "instrument"]
    assert got.columns == ["datetime", "instrument", *[mined.column_name(x) for x, _ in sorted(pool, key=lambda e: -e[1])], "LABEL0"]
    assert [k for k, _ in mined.turns([x for x, _ in pool])] == ["along", "across"]
    assert [k for k, _ in mined.turns([("ts_mean", ("cs_rank", MEAN), 5)])] == ["along", "across", "along"]
    assert [k for k, _ in mined.turns([("cs_rank", ("ts_mean", ("cs_demean", "close"), 3))])] == ["across", "along", "across"]


def test_equal_parts_are_worked_out_once():
    exprs = [("cs_rank", MEAN), ("cs_rank", ("add", MEAN, 1)), ("ts_sum", MEAN, 3)]
    parts = [p for _, levels in mined.turns(exprs) for level in levels for p in level]
    assert len(parts) == len(set(parts)) == 4 and parts.count(MEAN) == 1


def test_nested_factors_by_pandas(dense):
    x = dense.toPandas().sort_values(["instrument", "datetime"]).pivot(index="datetime", columns="instrument", values="close").astype(float)
    mean = x.rolling(5, min_periods=5).mean()
    want = {"a": mean.rank(axis=1, pct=True) - 0.5, "b": mean.diff(2).rolling(3, min_periods=3).max(), "c": (mean.sub(mean.mean(axis=1), axis=0)).rolling(4, min_periods=4).sum()}
    exprs = {"a": ("cs_rank", MEAN), "b": ("ts_max", ("ts_delta", MEAN, 2), 3), "c": ("ts_sum", ("cs_demean", MEAN), 4)}
    got = mined.evaluated(dense, exprs).toPandas()
    for name, w in want.items():
        own = got.pivot(index="datetime", columns="instrument", values=name).astype(float)
        np.testing.assert_allclose(own.to_numpy(), w.to_numpy(), atol=1e-9)


def test_pools_and_refusals(spark, dense):
    table = spark.createDataFrame([('["cs_rank",["ts_mean","close",5]]', 0.5), ('["neg","volume"]', 1.5)], "expr string, fitness double")
    pool = mined.pool_of(table)
    assert sorted(pool) == sorted([(("cs_rank", MEAN), 0.5), (("neg", "volume"), 1.5)])
    assert mined.from_json(mined.to_json(("where", "close", ("neg", "volume"), 2.0))) == ("where", "close", ("neg", "volume"), 2.0)
    out = mined.with_mined(dense.limit(7).select("datetime", "instrument"), mined.feature_matrix(dense, pool, horizon=None))
    assert out.count() == 7 and len(out.columns) == 4
    for bad in (("ts_mean", "close"), ("no_such", "close"), ("ts_mean", "close", 0), ("ts_mean", "close", "volume"), ("add", "close", True), ()):
        with pytest.raises(ValueError):
            mined.checked(bad)
    for args, more in (([], {}), ([pool[0], pool[0]], {}), (pool, {"refused": ("volume",)}), ([(("neg", "revenue"), 1.0)], {})):
        with pytest.raises(ValueError):
            mined.feature_matrix(dense, args, **more)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """500 factors over 240 rows, some rolling ones that begin late, one with holes, one that does not vary, ties."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 500)) + 100 * rng.normal(size=500)
    x[:, 100:200] = np.round(x[:, 100:200])
    x[:9, 200:300] = np.nan
    x[:19, 300:320] = np.nan
    x[rng.random(240) < 0.2, 400] = np.nan
    x[:, 401] = 7.0
    x[rng.random(240) < 0.5, 402] = np.nan
    x[:, 403] = np.nan
    x[3, 404] = np.inf
    frame = pd.DataFrame(x, columns=[f"f{i:03d}" for i in range(500)])
    path = str(tmp_path_factory.mktemp("wide") / "wide.parquet")
    frame.assign(datetime=range(240), instrument="i").to_parquet(path)
    return spark.read.parquet(path), frame


def matrix(rows, names):
    at = {n: i for i, n in enumerate(names)}
    out = np.full((len(names), len(names)), np.nan)
    for r in rows:
        assert at[r.a] < at[r.b]
        out[at[r.a], at[r.b]] = np.nan if r["corr"] is None else r["corr"]
    return out


def test_pearson_of_500_factors(many):
    wide, frame = many
    names = list(frame.columns)
    df = selection.pair_correlations(wide, tuple(names))
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    want = np.triu(frame.replace(np.inf, np.nan).corr(min_periods=3).to_numpy(), 1)
    got = matrix(df.collect(), names)
    up = np.triu_indices(500, 1)
    np.testing.assert_allclose(got[up], want[up], atol=1e-9)


def test_spearman_of_factors_with_holes(many):
    wide, frame = many
    names = [f"f{i:03d}" for i in (0, 1, 100, 101, 150, 200, 201, 300, 301, 400, 401, 402, 403, 404)]
    df = evaluation.factor_correlation(wide, tuple(names))
    got = matrix(df.collect(), names)
    want = np.triu(frame[names].corr(method="spearman").to_numpy(), 1)
    up = np.triu_indices(len(names), 1)
    np.testing.assert_allclose(got[up], want[up], atol=1e-9)


def test_sets_to_rank_over():
    n = np.array([[10, 10, 6, 5], [10, 10, 6, 5], [6, 6, 6, 3], [5, 5, 3, 5]], dtype=float)
    sets, between, of = correlations.rank_sets(n)
    assert of == [0, 0, 1, 2] and len(sets) == 4
    assert sets[between[0, 0]] == [0, 1] and sets[between[0, 1]] == sets[between[1, 1]] == [0, 1, 2] and sets[between[1, 2]] == [2, 3]
    one = correlations.rank_sets(np.full((5, 5), 8.0))
    assert one[0] == [[0, 1, 2, 3, 4]]


def test_rolling_functions_still_say_when_they_lack_rows(dense):
    assert dense.select(f.ts_mean(F.col("close"), 50).alias("x")).where("x is not null").count() == 0


def test_pearson_reads_rows_once_and_moves_centres(spark):
    """Tasks of other means, a factor that most tasks lack at first, a large offset, a flat factor; no pass over the rows before they are asked for."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=400) + np.repeat([0.0, 50.0, -3.0, 7.0], 100)
    y, z = 1e9 + x * 0.3 + rng.normal(size=400), rng.normal(size=400) + x
    rows = [(float(a), float(b), float(c) if k % 150 > 110 else None, 5e8) for k, (a, b, c) in enumerate(zip(x, y, z, strict=True))]
    names = ["x", "y", "z", "flat"]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "x double, y double, z double, flat double")
    got = {(r.a, r.b): (r.n, r["corr"]) for r in correlations.pearson(df, names).collect()}
    there = np.array([r[2] is not None for r in rows])
    for a, b, own, u, v in (("x", "y", there | True, x, y), ("x", "z", there, x, z), ("y", "z", there, y, z)):
        assert got[a, b][0] == own.sum() and got[a, b][1] == pytest.approx(np.corrcoef(u[own], v[own])[0, 1], abs=1e-6)
    assert got["x", "flat"] == (400, None)
    bad = spark.range(1).select(F.raise_error(F.lit("read")).cast("double").alias("x"), F.lit(1.0).alias("y"))
    correlations.pearson(bad, ["x", "y"])
