"""Choosing factors: decay, scores, likeness to others, held returns by fold, validation by segment, family bars.

Long factors: (datetime, instrument, factor, value). Tables with a row for each factor, fold or draw are small; cells
are not and are only ever aggregated by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators import correlations
from strandline.operators.evaluation import factor_quality
from strandline.operators.signal import daily_ic, returns_by_lag

#: Weights of the score's terms, cost of one unit of turnover, trading days of a year.
WEIGHTS = {"ic": 1.0, "ir": 0.5, "rank_ic": 0.5, "turnover": 0.2, "likeness": 0.8, "size": 0.01, "baseline": 0.0}
COST, DAYS = 0.003, 252
#: Weights of the parts of a run's stability and the trend that still counts as none.
STABILITY = {"steady": 0.4, "positive": 0.3, "drawdown": 0.2, "trend": 0.1}
MOST_TREND = 0.3


def ic_decay(factors: DataFrame, dense: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """(factor, lag, days, mean_ic): entry on the day itself. One shuffle serves all factors and lags."""
    joined = factors.withColumnRenamed("value", "score").join(returns_by_lag(dense, lags), ["datetime", "instrument"])
    daily = daily_ic(joined, "factor", "lag", "datetime").where("ic is not null")
    return daily.groupBy("factor", "lag").agg(F.count("ic").alias("days"), F.avg("ic").alias("mean_ic"))


def bundle(factors: DataFrame, returns: DataFrame, least_std: float = 1e-6) -> DataFrame:
    """A row for each factor: ic, rank_ic (means of the days), ir (NULL where the days hardly vary), days and the quality figures."""
    joined = factors.withColumnRenamed("value", "score").join(returns, ["datetime", "instrument"])

    def means(method: str, name: str) -> DataFrame:
        daily = daily_ic(joined, "factor", "datetime", method=method)
        return daily.groupBy("factor").agg(F.avg("ic").alias(name), F.stddev_samp("ic").alias(f"_sd_{name}"), F.count("ic").alias(f"days_{name}"))

    both = means("normal", "ic").join(means("rank", "rank_ic"), "factor", "full")
    out = factor_quality(factors, returns, least_std).join(both, "factor", "left")
    return out.withColumn("ir", F.when(F.col("_sd_ic") >= 1e-9, F.col("ic") / F.col("_sd_ic"))).withColumnRenamed("days_ic", "days").drop("_sd_ic", "_sd_rank_ic", "days_rank_ic")


def baseline_penalty(likeness: Column, weight: float, band: float) -> Column:
    """Weight times what the mean absolute correlation with a baseline has beyond the band; none where it is unknown."""
    return F.coalesce(F.lit(weight) * F.greatest(F.lit(0.0), likeness - band), F.lit(0.0))


def scored(bundles: DataFrame, size: Column, likeness: Column, baseline: Column, band: float = 0.0, mode: str = "full", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Adds `score`; minus infinity where the factor is not valid or has no information coefficient.

    mode "full": weighted terms for information, steadiness, cost of turnover, likeness to others, size and likeness to
    the baseline; "rank": absolute rank coefficient less size and baseline terms."""
    w = weights
    less = w["size"] * size.cast("double") + baseline_penalty(baseline, w["baseline"], band)
    rank = F.abs("rank_ic") - less
    full = w["ic"] * F.abs("ic") + w["ir"] * F.coalesce("ir", F.lit(0.0)) + w["rank_ic"] * F.abs("rank_ic") - w["turnover"] * F.col("mean_abs_change") * (DAYS * COST) - w["likeness"] * F.coalesce(likeness, F.lit(0.0)) - less
    usable = F.col("valid") & F.col("ic").isNotNull() & F.col("rank_ic").isNotNull()
    return bundles.withColumn("score", F.when(usable, full if mode == "full" else rank).otherwise(F.lit(float("-inf"))))


def pair_correlations(wide: DataFrame, names: tuple[str, ...], least: int = 3) -> DataFrame:
    """(a, b, n, corr): Pearson over the cells where both are finite; NULL under `least` of them or where one is flat."""
    return correlations.pearson(wide, names, least)


def likeness(pairs: DataFrame) -> DataFrame:
    """(factor, likeness, skipped): the largest absolute correlation with any other, and how many could not be compared."""
    both = pairs.select(F.col("a").alias("factor"), "corr").union(pairs.select(F.col("b").alias("factor"), "corr"))
    known = F.col("corr").isNotNull() & ~F.isnan("corr")
    return both.groupBy("factor").agg(F.coalesce(F.max(F.when(known, F.abs("corr"))), F.lit(0.0)).alias("likeness"), F.count_if(~known).alias("skipped"))


def kept_apart(scores: DataFrame, pairs: DataFrame, most: float) -> DataFrame:
    """(factor, kept): by falling score, a factor is kept unless it is too like one that is already kept.

    scores: (factor, score). One row of all factors, each with the names it is too like, is folded from best to worst."""
    close = pairs.where(F.abs("corr") > most)
    foes = close.select(F.col("a").alias("factor"), F.col("b").alias("foe")).union(close.select(F.col("b").alias("factor"), F.col("a").alias("foe"))).groupBy("factor").agg(F.collect_set("foe").alias("foes"))
    rows = scores.join(foes, "factor", "left").select((-F.col("score")).alias("o"), "factor", F.coalesce("foes", F.array().cast("array<string>")).alias("foes"))
    line = rows.agg(F.array_sort(F.collect_list(F.struct("o", "factor", "foes"))).alias("line"))
    kept = F.aggregate("line", F.array().cast("array<string>"), lambda k, x: F.when(F.arrays_overlap(k, x["foes"]), k).otherwise(F.array_append(k, x["factor"])))
    return line.withColumn("k", kept).select("k", F.explode("line").alias("x")).select("x.factor", F.array_contains("k", F.col("x.factor")).alias("kept"))


def top_of_pool(pool: DataFrame, by: Column, name: str, k: int) -> DataFrame:
    """The k best rows, ties by name."""
    return pool.orderBy(by.desc_nulls_last(), F.asc(name)).limit(k)


def baseline_likeness(rows: DataFrame, least: int = 3) -> DataFrame:
    """(factor, days, likeness): mean absolute daily rank correlation of value and baseline."""
    daily = daily_ic(rows.withColumnsRenamed({"value": "score", "baseline": "ret"}), "factor", "datetime", least=least).where("ic is not null")
    return daily.groupBy("factor").agg(F.count("ic").alias("days"), F.avg(F.abs("ic")).alias("likeness"))


def held_returns(panel: DataFrame, stamps: DataFrame) -> DataFrame:
    """(signal, instrument, ret, state) from the close at `execution` to the last close up to `horizon_end`.

    state: held, truncated (no close on the last session), flat (no close after entry; ret 0). Names without a close at
    execution have no row. stamps: (signal, execution, horizon_end), dates; the panel meets
    the days of all windows by the day, so work follows the windows' overlap; that table is broadcast only where its measured size allows."""
    s = stamps.where("execution <= horizon_end").select(F.explode(F.sequence("execution", "horizon_end")).alias("_d"), "signal", "execution", "horizon_end")
    rows = panel.where("close is not null").join(s, F.col("datetime") == F.col("_d"))
    later = F.col("datetime") > F.col("execution")
    out = rows.groupBy("signal", "instrument").agg(
        F.max(F.when(~later, F.col("close"))).alias("_in"), F.max_by(F.when(later, F.col("close")), F.when(later, F.col("datetime"))).alias("_out"),
        (F.max("datetime") < F.max("horizon_end")).alias("_short"),
    ).where("_in is not null")
    state = F.when(F.col("_out").isNull(), "flat").when(F.col("_short"), "truncated").otherwise("held")
    return out.select("signal", "instrument", (F.try_divide(F.coalesce("_out", "_in"), "_in") - 1).alias("ret"), state.alias("state"))


def fold_ic(rows: DataFrame, fold: str, least: int = 30) -> DataFrame:
    """(fold, n, rank_ic, ic) of rows (fold, score, ret); NULL under `least` names."""
    rank = daily_ic(rows, fold, least=least).withColumnRenamed("ic", "rank_ic")
    return rank.join(daily_ic(rows, fold, method="normal", least=least).select(fold, "ic"), fold)


def fold_summary(folds: DataFrame, column: str = "rank_ic") -> DataFrame:
    """One row: folds, mean, std, ir, t, positive."""
    x, sd = F.col(column), F.stddev_samp(column)
    out = folds.agg(F.count(x).alias("folds"), F.avg(x).alias("mean"), sd.alias("std"), F.count_if(x > 0).alias("positive"))
    return out.withColumn("ir", F.when(F.col("std") > 1e-12, F.col("mean") / F.col("std"))).withColumn("t", F.col("ir") * F.sqrt("folds"))


def segmented(rows: DataFrame, days: DataFrame, split: str, warm_up: int, label: str = "ret") -> DataFrame:
    """rows (datetime, ...) with `segment`: "is" before the split, "oos" from warm_up trading days before it on, so rows of the
    warm-up are in both; there the label of "oos" is NULL."""
    at = F.to_date(F.lit(split))
    edge = days.agg(F.min(F.when(F.col("datetime") >= at, F.col("idx"))).alias("_edge"))
    placed = rows.join(F.broadcast(days.select("datetime", "idx").join(edge, how="cross")), "datetime")
    before = F.col("_edge").isNull() | (F.col("idx") < F.col("_edge"))
    both = placed.withColumn("segment", F.explode(F.filter(F.array(F.when(before, F.lit("is")), F.when(F.col("idx") >= F.col("_edge") - warm_up, F.lit("oos"))), lambda x: x.isNotNull())))
    hidden = (F.col("segment") == "oos") & before
    return both.withColumn(label, F.when(~hidden, F.col(label))).drop("idx", "_edge")


def validated(rows: DataFrame, least_ic: float, least_ir: float, least_n: int) -> DataFrame:
    """(factor, segment, n, rank_ic, rank_ir, reasons) of rows (factor, segment, datetime, score, ret)."""
    daily = daily_ic(rows, "factor", "segment", "datetime")
    sd = F.stddev_samp("ic")
    out = daily.groupBy("factor", "segment").agg(F.sum("n").alias("n"), F.avg("ic").alias("rank_ic"), F.when(sd >= 1e-9, F.avg("ic") / sd).alias("rank_ir"))

    def failed(ok: Column, why: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(why))

    reasons = F.array(failed(F.abs("rank_ic") >= least_ic, "rank_ic"), failed(F.abs("rank_ir") >= least_ir, "rank_ir"), failed(F.col("n") >= least_n, "n"))
    return out.withColumn("reasons", F.array_compact(reasons))


def drifted(actual: DataFrame, baseline: DataFrame, tolerance: float, absolute: float | None = None) -> DataFrame:
    """(metric, baseline, actual, drift, why) of metrics (metric, value) that left the baseline: by more than the
    tolerance, absolute where the baseline is zero; missing or not a number where the baseline has one."""
    old = baseline.where("value is not null and not isnan(value)").select("metric", F.col("value").alias("baseline"))
    new = actual.select("metric", F.col("value").alias("actual"), F.lit(True).alias("_there"))
    rows = old.join(new, "metric", "left")
    near = F.abs("baseline") < 1e-12
    drift = F.abs(F.col("actual") - F.col("baseline")) / F.when(near, 1.0).otherwise(F.abs("baseline"))
    why = F.when(F.col("_there").isNull(), "missing").when(F.col("actual").isNull() | F.isnan("actual"), "no number").when(near & (F.col("drift") > F.lit(tolerance if absolute is None else absolute)), "absolute").when(~near & (F.col("drift") > tolerance), "relative")
    return rows.withColumn("drift", drift).withColumn("why", why).where("why is not null").drop("_there")


def stability(folds: DataFrame) -> DataFrame:
    """One row (n, steady, positive, drawdown, trend, score) from folds (fold, ir, drawdown), two at least: how little the
    ratios vary, how many are positive, how alike the drawdowns are, whether later folds differ; from 0 to 1."""
    late, rank = F.row_number().over(Window.orderBy("fold")), F.row_number().over(Window.orderBy("ir", "fold"))
    rows = folds.withColumns({"_f": late, "_r": rank})
    out = rows.agg(F.count("ir").alias("n"), F.avg("ir").alias("_m"), F.stddev_pop("ir").alias("_s"), F.avg((F.col("ir") > 0).cast("double")).alias("positive"), F.min("drawdown").alias("_w"), F.max("drawdown").alias("_b"), F.corr("_f", "_r").alias("_c"))
    spread = F.when(F.col("_m") != 0, F.col("_s") / F.abs("_m")).otherwise(1.0)
    trend = F.when(F.col("n") >= 3, F.coalesce("_c", F.lit(0.0))).otherwise(0.0)
    out = out.where("n >= 2").select("n", (1 - F.least(spread, F.lit(1.0))).alias("steady"), "positive", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs("_w") / (F.abs("_b") + 0.0001))).alias("drawdown"), trend.alias("trend"))
    calm = F.when(F.abs("trend") < MOST_TREND, 1.0).otherwise(0.0)
    parts = STABILITY["steady"] * F.col("steady") + STABILITY["positive"] * F.col("positive") + STABILITY["drawdown"] * F.col("drawdown") + STABILITY["trend"] * calm
    return out.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), parts)))


def counter_draws(trials: DataFrame, counters: DataFrame, seed: int, block: int = 4) -> DataFrame:
    """(c, max_t): for each counter c the largest t of all trials in one circular block draw, trials demeaned and drawn alike; NULL where a trial has under two values or does not vary.

    trials: (trial, pos, x), pos numbered from 0. Counter c's block j starts at the first 32 bits of md5('seed:c:j') modulo the number of positions."""
    means = trials.groupBy("trial").agg(F.avg("x").alias("_m"))
    flat = trials.join(F.broadcast(means), "trial").select("trial", F.col("pos").alias("_p"), (F.col("x") - F.col("_m")).alias("x"))
    span = trials.agg((F.max("pos") + 1).alias("m"), F.countDistinct("trial").alias("k"))
    at = counters.join(F.broadcast(span), how="cross").select("c", "m", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long") - 1)).alias("i"))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("c").cast("string"), F.floor(F.col("i") / block).cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = at.select("c", "k", F.pmod(start + F.col("i") % block, F.col("m")).alias("_at"))
    sd, n = F.stddev_samp("x"), F.count("x")
    each = drawn.join(flat, F.col("_at") == F.col("_p")).groupBy("c", "k", "trial").agg(F.when((n >= 2) & (sd >= 1e-12), F.avg("x") / (sd / F.sqrt(n))).alias("t"))
    return each.groupBy("c", "k").agg(F.max("t").alias("t"), F.count("t").alias("_n")).select("c", F.when(F.col("_n") == F.col("k"), F.col("t")).alias("max_t"))


def family_draws(trials: DataFrame, draws: int, seed: int, block: int = 4, most_redraws: int = 10) -> DataFrame:
    """(b, max_t): `draws` valid draws of a family's largest t, numbered from 0.

    A draw in which a trial is degenerate is drawn anew: the valid draws are those of the first counters 0, 1, 2, ... that are
    valid, so any engine has the same. Counters are tried in batches, each as large as what is still missing at the share
    of valid ones so far. Beyond most_redraws invalid counters a draw the family is too sparse, an error. The drawn
    numbers, `draws` at most, are kept by the plan as rows."""
    spark = trials.sparkSession
    found: list[float] = []
    tried = invalid = 0
    while len(found) < draws:
        missing = draws - len(found)
        size = missing if not tried else min(int(missing * tried / max(1, len(found)) * 1.1) + 8, draws * (most_redraws + 1) + 1 - tried)
        rows = counter_draws(trials, spark.range(tried, tried + size).withColumnRenamed("id", "c"), seed, block).where("max_t is not null").toArrow().sort_by("c")
        before = tried
        for c, t in zip(rows.column("c").to_pylist(), rows.column("max_t").to_pylist(), strict=True):
            if len(found) < draws:
                found.append(t)
                before = c + 1
        tried += size
        invalid = (before if len(found) == draws else tried) - len(found)
        if invalid > draws * most_redraws:
            raise ValueError(f"{invalid} invalid draws for {len(found)} valid ones: a trial is too sparse or does not vary")
    return spark.createDataFrame(list(enumerate(found)), "b long, max_t double")


def adjudicated(trials: DataFrame, draws: DataFrame, quantile: float = 0.95, floor: float = 2.85) -> DataFrame:
    """(trial, n, t, bar, passed): a trial's own t against the family's bar and a fixed floor."""
    sd, n = F.stddev_samp("x"), F.count("x")
    own = trials.groupBy("trial").agg(n.alias("n"), F.when((n >= 2) & (sd >= 1e-12), F.avg("x") / (sd / F.sqrt(n))).alias("t"))
    bar = draws.agg(F.percentile("max_t", F.lit(quantile)).alias("bar"))
    return own.join(F.broadcast(bar), how="cross").withColumn("passed", F.coalesce((F.col("t") > F.col("bar")) & (F.col("t") >= floor), F.lit(False)))
