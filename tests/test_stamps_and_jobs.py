"""Stamp plans and slices, dropped signals counted on their way, family draws anew, the daily list's guards, the analysis of factors."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from strandline.functions import factors as f
from strandline.operators import analysis, arms, compare, daily, ingest, portfolio, pretrade, selection, stamps
from strandline.plans import catalog

D0 = datetime.date(2024, 1, 1)


def day(n):
    return D0 + datetime.timedelta(n)


def calendar(spark, n, step=1):
    return spark.createDataFrame([(day(i * step), i) for i in range(n)], "datetime date, idx int")


def windows(spark, rows):
    return spark.createDataFrame([(k, day(a), day(b)) for k, a, b in rows], "fold int, start date, end date")


def plan_by_hand(days, cadence, phase):
    out = []
    kept = [i for i in range(phase, len(days), cadence) if i < len(days) - 1]
    for j, i in enumerate(kept):
        end = days[kept[j + 1] + 1] if j + 1 < len(kept) else days[-1]
        if end > days[i + 1]:
            out.append((days[i], days[i + 1], end))
    return out


@pytest.mark.parametrize(("cadence", "phase"), [(1, 0), (3, 0), (3, 1), (5, 2), (20, 0), (4, 8)])
def test_plan_of_folds(spark, cadence, phase):
    folds = windows(spark, [(0, 0, 9), (1, 10, 19), (2, 20, 40)])
    got = stamps.stamp_plan(folds, calendar(spark, 28), "2024-01-26", cadence, phase).collect()
    last = min(27, (datetime.date(2024, 1, 26) - D0).days)
    want = {(k, *row) for k, a, b in ((0, 0, 9), (1, 10, 19), (2, 20, 40)) for row in plan_by_hand([day(i) for i in range(a, min(b, last) + 1)], cadence, phase)}
    assert {(r.fold, r.signal, r.execution, r.horizon_end) for r in got} == want
    firsts = {k: min((r.signal for r in got if r.fold == k), default=None) for k in range(3)}
    assert all((r.kind == "primary") == (r.signal == firsts[r.fold]) for r in got)


def test_phase_restarts_after_a_removed_slice(spark):
    cut = spark.createDataFrame([(day(6), day(7)), (day(7), day(8))], "start date, end date")
    got = stamps.stamp_plan(windows(spark, [(7, 0, 19)]), calendar(spark, 30), "2030-01-01", 4, 1, cut).orderBy("signal").collect()
    want = plan_by_hand([day(i) for i in range(6)], 4, 1) + plan_by_hand([day(i) for i in range(9, 20)], 4, 1)
    assert [(r.signal, r.execution, r.horizon_end) for r in got] == want and [r.kind for r in got] == ["primary"] + ["tail"] * (len(want) - 1)


def test_counts_and_faults_of_folds(spark):
    folds = windows(spark, [(0, 0, 9), (1, 10, 11), (2, 12, 15), (3, 100, 110), (4, 16, 18)])
    got = {r.fold: tuple(r)[1:] for r in stamps.stamp_counts(folds, calendar(spark, 30), "2030-01-01", 8, 0).collect()}
    assert got == {0: (10, 1, 1, None), 1: (2, 0, 1, "too few days"), 2: (4, 1, 0, None), 3: (0, 0, 0, "too few days"), 4: (3, 1, 0, None)}
    late = {r.fold: r.fault for r in stamps.stamp_counts(folds, calendar(spark, 30), "2030-01-01", 8, 2).collect()}
    assert late[2] == "all are held no day" and late[4] == "no stamp can be filled"


def test_longer_history_and_longer_holding(spark):
    folds = spark.createDataFrame([(i, datetime.date(2024, 1 + 3 * i, 1), e) for i, e in enumerate((datetime.date(2024, 3, 31), datetime.date(2024, 6, 30), datetime.date(2024, 9, 30)))], "fold int, start date, end date")
    early = {r.fold: (str(r.start), str(r.end)) for r in stamps.earlier_folds(folds, 2).collect()}
    assert early[-1] == ("2023-10-01", "2023-12-31") and early[-2] == ("2023-07-01", "2023-09-30") and len(early) == 5
    days = spark.sql("select explode(sequence(date'2024-01-03', date'2024-12-31')) as datetime").where("dayofweek(datetime) between 2 and 6").withColumn("idx", F.lit(0))
    (one,) = stamps.held_over(folds, days, "2024-06-28", 2).collect()
    assert [str(x) for x in one] == ["0", "primary", "2024-01-03", "2024-01-04", "2024-06-28"]
    assert stamps.held_over(folds, days, "2024-06-28", 4).count() == 0


def test_slices_are_merged(spark):
    rows = spark.createDataFrame([(1, day(5), day(9)), (1, day(1), day(3)), (1, day(4), day(4)), (1, day(6), day(7)), (1, day(12), day(12)), (2, day(3), day(1)), (2, None, day(1))], "k int, start date, end date")
    assert sorted((r.k, r.start, r.end) for r in stamps.merged_slices(rows, "k").collect()) == [(1, day(1), day(9)), (1, day(12), day(12))]
    series = calendar(spark, 15).withColumn("x", F.lit(1))
    left = stamps.outside(series, rows.where("k = 1"))
    assert sorted((r.datetime - D0).days for r in left.collect()) == [0, 10, 11, 13, 14]
    assert "NestedLoop" not in left._jdf.queryExecution().executedPlan().toString()


def test_slices_that_say_nothing_are_refused(spark):
    a = calendar(spark, 60).withColumn("ret", F.rand(1))
    full = calendar(spark, 60).withColumn("ret", F.rand(2))
    assert [r.slices for r in arms.sliced_bootstrap(a, full, {"all": [], "late": [("2024-01-01", "2024-01-20")]}, 20, 1).collect()] == ["all", "late"]
    for slices, why in (({"x": [("2020-01-01", "2020-02-01")]}, "nothing removed"), ({"x": [("2024-01-01", "2024-02-25")]}, "too few days")):
        with pytest.raises(ValueError, match=why):
            arms.sliced_bootstrap(a, full, slices, 20, 1)
    thin = calendar(spark, 90).where("idx < 5 or idx >= 30").withColumn("ret", F.rand(3))
    with pytest.raises(ValueError, match="too little overlap"):
        arms.sliced_bootstrap(calendar(spark, 60).withColumn("ret", F.rand(1)), thin, {"x": [("2024-01-01", "2024-01-05")]}, 20, 1)


@pytest.fixture(scope="module")
def market(spark):
    """Eight days, four names: b is suspended on day 2, c has one price on day 2, d turns risky on day 4."""
    rows = [(day(t), i, 10.0 + t, 9.0 + t if not (i == "c" and t == 2) else 10.0 + t, 9.5 + t, 0.0 if (i, t) == ("b", 2) else 5.0) for t in range(8) for i in "abcd"]
    dense = spark.createDataFrame(rows, "datetime date, instrument string, high double, low double, close double, volume double")
    scores = spark.createDataFrame([(day(t), i, float(ord(i) + t)) for t in range(8) for i in "abcd" if t != 3], "datetime date, instrument string, score double")
    spans = spark.createDataFrame([("d", day(0), day(4), False, "fine"), ("d", day(4), None, True, "*ST d"), ("a", day(0), None, False, "A")], "code string, start date, next date, is_risk boolean, name string")
    return scores, dense, spans


def test_dropped_signals_are_counted_in_the_same_pass(spark, market):
    scores, dense, spans = market
    judged = pretrade.judged_signals(scores, dense, calendar(spark, 8), 1, 0, 0, spans)
    seen = Observation("pretrade")
    got = pretrade.tradable(judged, seen)
    kept = {((r.datetime - D0).days, r.instrument, (r.execution - D0).days) for r in got.collect()}
    # Day 7 is the calendar's last, never scheduled; day 3 has no signals.
    due = [t for t in (0, 1, 2, 4, 5, 6)]
    want = {(t, i, t + 1) for t in due for i in "abcd" if not (t + 1 == 2 and i in "bc") and not (i == "d" and t + 1 >= 4)}
    assert kept == want
    assert seen.get == {"given": 28, "kept": len(want), "unscheduled": 4, "past the end": 0, "suspended": 1, "one_price": 1, "risk name": 3}
    assert pretrade.drop_counts(judged).first().asDict() == {k.replace(" ", "_"): v for k, v in seen.get.items()}


def test_cadence_is_the_calendars_and_lag_moves_stamps(spark, market):
    scores, dense, _ = market
    judged = pretrade.judged_signals(scores, dense, calendar(spark, 8), 3, 0, 1)
    assert {((r.datetime - D0).days, r.why) for r in judged.where("instrument = 'a'").collect()} == {(0, None), (6, "past the end"), *((t, "unscheduled") for t in (1, 2, 4, 5, 7))}
    assert {(r.stamp - D0).days for r in judged.where("why is null").collect()} == {6}
    n = Observation("n")
    assert pretrade.counted(scores, n, {"high": "score > 100"}).count() == 28 and n.get["high"] == scores.where("score > 100").count()


def test_degenerate_draws_are_drawn_anew(spark):
    rows = [("full", p, float(np.sin(p * 7.0))) for p in range(40)] + [("thin", p, v) for p, v in ((3, 1.0), (4, -1.0), (21, 0.5), (30, 2.0))]
    trials = spark.createDataFrame(rows, "trial string, pos int, x double")
    every = selection.counter_draws(trials, spark.range(0, 400).withColumnRenamed("id", "c"), 5).orderBy("c").collect()
    assert 0 < sum(r.max_t is None for r in every) < 400
    got = selection.family_draws(trials, 50, 5).orderBy("b").collect()
    assert [r.b for r in got] == list(range(50)) and [r.max_t for r in got] == [r.max_t for r in every if r.max_t is not None][:50]
    with pytest.raises(ValueError, match="too sparse"):
        selection.family_draws(trials.where("trial = 'full' or pos = 3"), 20, 5)
    with pytest.raises(ValueError, match="too sparse"):
        selection.family_draws(trials, 50, 5, most_redraws=0)


def test_daily_list_and_its_guards(spark, market):
    scores, dense, spans = market
    days = calendar(spark, 8)

    def made(today="2024-01-10", k=2, **more):
        return daily.daily_recommendations(scores, dense, days, spans, k, today, **more)

    on = {t: [(r.stock_code, r["rank"], r.unavailable_reason) for r in made().where(F.col("as_of_date") == F.lit(day(t))).orderBy(F.desc("predicted_score")).collect()] for t in (1, 4, 7)}
    assert on[1] == [("d", 1, None), ("c", None, "one price"), ("b", None, "suspended"), ("a", 2, None)]
    assert on[4] == [("d", None, "risk name"), ("c", 1, None), ("b", 2, None)]
    assert on[7] == [("d", None, "risk name"), ("c", 1, None), ("b", 2, None)]
    assert made().where(F.col("as_of_date") == F.lit(day(7))).first().entry_date is None
    assert made(drop=True).where("not tradable_flag").count() == 0
    named = {r.stock_code: r.stock_name for r in made().where(F.col("as_of_date") == F.lit(day(4))).collect()}
    assert named == {"d": "*ST d", "c": None, "b": None}
    with pytest.raises(Exception, match="the calendar is stale"):
        made(today="2024-01-23").collect()
    with pytest.raises(Exception, match="history of names is stale"):
        daily.daily_recommendations(scores, dense, days, spans, 2, "2024-01-10", most_age=2).collect()
    with pytest.raises(Exception, match="not in the calendar"):
        daily.daily_recommendations(scores, dense, calendar(spark, 5), spans, 2, "2024-01-10").collect()
    assert made(today="2024-01-22").count() == made().count()


def test_analysis_of_factors_scans_the_panel_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(day(t), f"n{i}", float(10 + rng.random()), float(rng.random())) for t in range(30) for i in range(8)]
    panel = spark.createDataFrame(rows, "datetime date, instrument string, close double, volume double")
    names = {"a": F.col("volume"), "b": -F.col("volume"), "c": f.ts_mean(F.col("close"), 3), "flat": F.lit(1.0)}
    found = analysis.factor_analysis(panel, names, forward=2, top=2, most_lag=3, path=str(tmp_path / "x"))
    ic = {r.factor: r for r in found.ic.collect()}
    assert set(ic) == set(names) and ic["flat"].days == 0 and ic["flat"].place == 4
    assert ic["a"].mean_ic == pytest.approx(-ic["b"].mean_ic) and sorted(r.place for r in ic.values()) == [1, 2, 3, 4]
    order = sorted(ic.values(), key=lambda r: (r.mean_ic is None, -abs(r.mean_ic or 0), r.factor))
    assert found.best == tuple(r.factor for r in order[:2])
    corr = {(r.a, r.b): r["corr"] for r in found.correlation.collect()}
    assert len(corr) == 4 and all(corr[n, n] == 1 for n in found.best) and corr[found.best] == corr[found.best[::-1]]
    assert {(r.factor, r.lag) for r in found.decay.collect()} == {(n, h) for n in found.best for h in (1, 2, 3)}
    at_lag = {r.factor: r.mean_ic for r in found.decay.collect() if r.lag == 2}
    assert all(at_lag[n] == pytest.approx(ic[n].mean_ic) for n in found.best)
    for bad in ({"forward": 0}, {"top": 0}):
        with pytest.raises(ValueError):
            analysis.factor_analysis(panel, names, **bad)


def run(spark, n, shift, ic, seed, step=1):
    rng = np.random.default_rng(seed)
    rows = [(day(t * step), float(rng.normal() * 0.01 + shift), float(rng.normal() * 0.01), float(rng.normal() * 0.02 + ic) if ic is not None else None, t % 10 == 0) for t in range(n)]
    return spark.createDataFrame(rows, "datetime date, excess double, gross double, ic double, boundary boolean")


def test_compared_runs_and_what_is_refused(spark):
    base = run(spark, 60, 0.0, 0.0, 1)
    better = compare.compared_runs(base, run(spark, 60, 0.02, 0.05, 2), 1000, 3).first()
    assert (better.verdict, better.ic_verdict, better.contradiction, better.n_shared, better.overlap) == ("treatment_better", "treatment", False, 60, 1.0)
    against = compare.compared_runs(base, run(spark, 60, 0.02, -0.05, 2), 1000, 3).first()
    assert (against.verdict, against.ic_verdict, against.contradiction) == ("treatment_better", "baseline", True)
    blind = compare.compared_runs(base, run(spark, 60, 0.02, None, 2), 1000, 3).first()
    assert (blind.n_ic, blind.ic_verdict, blind.ic_lo) == (0, "indistinguishable", None)
    excl = [r.excess for r in base.where("not boundary").collect()]
    incl = [r.excess for r in base.collect()]
    assert better.seam_a == pytest.approx((np.mean(excl) / np.std(excl, ddof=1) - np.mean(incl) / np.std(incl, ddof=1)) * 252**0.5)
    with pytest.raises(ValueError, match="no stable interval"):
        compare.compared_runs(base, base, 10, 3)
    with pytest.raises(Exception, match="share too few"):
        compare.compared_runs(base, run(spark, 60, 0.0, 0.0, 4, step=2), 1000, 3).collect()
    with pytest.raises(Exception, match="too few shared days"):
        compare.compared_runs(run(spark, 10, 0.0, 0.0, 1), run(spark, 10, 0.0, 0.0, 4), 1000, 3).collect()
    with pytest.raises(Exception, match="without width"):
        compare.compared_runs(base, base.withColumn("excess", F.col("excess") + 0.01), 1000, 3).collect()


def test_limits_in_a_scope(spark):
    rows = [(day(t), i, g, w) for t in range(2) for i, g, w in (("a", "x", 0.5), ("b", "x", 0.3), ("c", "y", 0.1))]
    p = spark.createDataFrame(rows, "datetime date, instrument string, board string, weight double")
    limits = {"per_name": 0.4, "per_group": 0.6, "cash": 0.1, "leverage": 1.0}
    scope = calendar(spark, 1)
    got = {((r.datetime - D0).days, r.instrument): r.weight for r in portfolio.held_within(p, "board", limits, scope).collect()}
    assert got[1, "a"] == 0.5 and got[0, "a"] == pytest.approx(0.4 * 0.6 / 0.7) and len(got) == 6
    with pytest.raises(Exception, match="limit broken: 2024-01-01 per_group x"):
        portfolio.held_within(p.where("instrument <> 'a' or datetime > date'2024-01-01'").withColumn("weight", F.col("weight") * 2), "board", {**limits, "per_name": 1.0, "per_group": 0.5}, scope, "raise").collect()
    loose = {"per_name": 1.0, "per_group": 1.0, "cash": 0.0, "leverage": 1.0}
    assert portfolio.held_within(p, "board", loose, mode="raise").count() == 6
    with pytest.raises(ValueError):
        portfolio.held_within(p, "board", limits, mode="warn")


def test_explicit_weights_and_single_industries(spark):
    names = spark.createDataFrame([("a",), ("b",), ("z",)], "instrument string")
    w = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("q", 9.0)], "instrument string, weight double")
    assert {r.instrument: r.weight for r in portfolio.given_weights(w, names).collect()} == {"a": 0.25, "b": 0.75, "z": 0.0}
    for bad in (-1.0, float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="no finite non-negative"):
            portfolio.given_weights(spark.createDataFrame([("a", bad)], "instrument string, weight double"), names).collect()
    with pytest.raises(Exception, match="no positive weight"):
        portfolio.given_weights(w.where("instrument = 'q'"), names).collect()
    mapped = spark.createDataFrame([("a", "steel", 1), ("b", "coal", 2), ("b", "oil", 2)], "instrument string, industry string, n long")
    assert [tuple(r) for r in ingest.one_industry_each(mapped.where("n = 1")).collect()] == [("a", "steel")]
    with pytest.raises(Exception, match="several industries: b"):
        ingest.one_industry_each(mapped).collect()


def test_value_of_a_unit(spark):
    r = spark.createDataFrame([(day(0), 0.1), (day(1), -0.5), (day(2), None), (day(3), 1.0)], "datetime date, ret double")
    got = portfolio.nav(r, r.where("ret > 0.5")).orderBy("datetime").collect()
    assert [round(x.nav, 6) for x in got] == [1.1, 0.55, 1.1] and [round(x.drawdown, 6) for x in got] == [0, -0.5, 0] and [x.bench_nav for x in got] == [1, 1, 2]
    assert portfolio.nav(r).where("bench_nav is not null").count() == 0


@pytest.mark.parametrize("name", ["panel_from_files", "shift_verdict", "compared_runs"])
def test_large_tables_are_read_once(spark, monkeypatch, name):
    """Of all that a query writes one table at most reads the rows, and the result reads none."""
    sf_dir = "/root/testdata/sf0.001"
    reads, write = {"lineitem": 0, "orders": 0}, DataFrameWriter.parquet

    def large(df):
        return [t for t in reads if any(f"/{t}.parquet" in x for x in df.inputFiles())]

    def counted(self, path, *args, **kwargs):
        for t in large(self._df):
            reads[t] += 1
        write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    out = catalog.all_queries()[name](spark, sf_dir)
    assert large(out) == [] and reads["lineitem"] == 1 and reads["orders"] <= 1
