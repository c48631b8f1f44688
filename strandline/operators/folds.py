"""Folds of a run and its surroundings: yearly rates, chained values, figures over folds, cost schedules, sessions, reviews.

Tables of folds, metrics, calendars and schedules are small; decisions to review are joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators.panel import following


def annualised(total: Column, n: Column, periods: int = 252) -> Column:
    """Yearly rate of a total return over n periods; NULL without periods or where all or more is lost."""
    return F.when((n > 0) & (total > -1), F.pow(1 + total, F.lit(float(periods)) / n) - 1)


def stitched(folds: DataFrame) -> DataFrame:
    """folds (fold, test_start, test_end, annual) with `nav`: from 1, each fold grows at its yearly rate over its days.

    Folds without a rate, without days or with a rate of -1 or less go."""
    usable = folds.where("annual > -1 and test_end > test_start")
    growth = F.log(1 + F.col("annual")) * F.datediff("test_end", "test_start") / 365
    return usable.withColumn("nav", F.exp(F.sum(growth).over(Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, 0))))


def fold_metrics(folds: DataFrame, *metrics: str) -> DataFrame:
    """(metric, mean, std, least, most, total, valid): over the folds that have the metric; std is that of the population. The worst
    drawdown is the least of a metric of drawdowns, the time of a run the total of its folds' seconds."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias("x")) for m in metrics]))
    return folds.select(cells.alias("c")).select("c.*").groupBy("metric").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("most"), F.sum("x").alias("total"), F.count("x").alias("valid"))


def differences(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(metric, baseline, candidate, delta, relative, missing) of metrics (metric, value): relative is NULL where the
    baseline is zero; missing tells which side has no number."""
    rows = baseline.withColumnRenamed("value", "baseline").join(candidate.withColumnRenamed("value", "candidate"), "metric", "full")
    a, b = (F.col(c).isNull() | F.isnan(c) for c in ("baseline", "candidate"))
    delta = F.when(~a & ~b, F.col("candidate") - F.col("baseline"))
    out = rows.withColumns({"delta": delta, "missing": F.when(a & b, "both").when(a, "baseline").when(b, "candidate")})
    return out.withColumn("relative", F.try_divide("delta", F.abs("baseline")))


def better_counts(differences: DataFrame, ratio: str, times: float = 1.1) -> DataFrame:
    """One row (candidate_better, baseline_better, unavailable, ratio_met) of differences(): metrics that each side has larger, metrics
    without a number on a side, and whether the candidate's metric `ratio` is at least so many times the baseline's (NULL where one lacks)."""
    d, own = F.col("delta"), F.col("metric") == ratio
    met = F.max(F.when(own & F.col("missing").isNull(), F.col("candidate") >= F.lit(times) * F.col("baseline")))
    return differences.agg(F.count_if(F.coalesce(d > 0, F.lit(False))).alias("candidate_better"), F.count_if(F.coalesce(d < 0, F.lit(False))).alias("baseline_better"), F.count("missing").alias("unavailable"), met.alias("ratio_met"))


def mean_rate(schedule: DataFrame, days: DataFrame, first: str, last: str) -> DataFrame:
    """One row (days, rate, changes): mean over the trading days first..last of a step schedule (start, rate), and how
    often it changes inside; days before the first step do not count."""
    steps = schedule.select("start", "rate", F.lead("start").over(Window.orderBy("start")).alias("_next"))
    inside = days.select("datetime").where(F.col("datetime").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    rows = inside.join(F.broadcast(steps), (F.col("datetime") >= F.col("start")) & (F.col("_next").isNull() | (F.col("datetime") < F.col("_next"))))
    return rows.agg(F.count(F.lit(1)).alias("days"), F.avg("rate").alias("rate"), F.greatest(F.countDistinct("start") - 1, F.lit(0)).alias("changes"))


def first_session(table: DataFrame, start: str) -> DataFrame:
    """One row (session, covered): the first open day from start on, and whether the table (day, is_open) reaches back to start."""
    at = F.to_date(F.lit(start))
    return table.agg(F.min(F.when((F.col("is_open") == 1) & (F.col("day") >= at), F.col("day"))).alias("session"), F.coalesce(F.min("day") <= at, F.lit(False)).alias("covered"))


def next_of(dates: DataFrame, days: DataFrame) -> DataFrame:
    """dates (d) with `due`, the first of the days on or after d; NULL past the last. Given the first days of weeks, the next rebalance day."""
    return following(dates, days, "due", 0)


def review_progress(candidates: DataFrame, journal: DataFrame, day: str, code: str) -> DataFrame:
    """(day, candidates, reviewed, missing): candidates (day, code) that the journal has on the very day and code."""
    done = journal.select(day, code, F.lit(True).alias("_done")).distinct()
    rows = candidates.select(day, code).distinct().join(done, [day, code], "left")
    return rows.groupBy(day).agg(F.count(F.lit(1)).alias("candidates"), F.count("_done").alias("reviewed"), F.count_if(F.col("_done").isNull()).alias("missing"))
