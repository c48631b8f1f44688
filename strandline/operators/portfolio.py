"""Positions (datetime, instrument, weight): limits, turnover, concentration, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def day(*more: str) -> Window:
    return Window.partitionBy("datetime", *more)


def violations(positions: DataFrame, group: str, per_name: float, per_group: float, cash: float, leverage: float) -> DataFrame:
    """(datetime, rule, what, actual, limit) of every limit that the weights as given break."""
    def rows(df: DataFrame, rule: str, what: Column, actual: Column, limit: float, bad: Column) -> DataFrame:
        return df.where(bad).select("datetime", F.lit(rule).alias("rule"), what.alias("what"), actual.alias("actual"), F.lit(limit).alias("limit"))

    w = F.col("weight")
    groups = positions.groupBy("datetime", group).agg(F.sum(w).alias("w"))
    days = positions.groupBy("datetime").agg((1 - F.sum(w)).alias("cash"), F.sum(F.abs(w)).alias("gross"))
    return (
        rows(positions, "per_name", F.col("instrument"), w, per_name, w > per_name)
        .union(rows(groups, "per_group", F.col(group), F.col("w"), per_group, F.col("w") > per_group))
        .union(rows(days, "cash", F.lit("cash"), F.col("cash"), cash, F.col("cash") < cash))
        .union(rows(days, "leverage", F.lit("portfolio"), F.col("gross"), leverage, F.col("gross") > leverage))
    )


def clipped(positions: DataFrame, group: str, per_name: float, per_group: float, cash: float, leverage: float) -> DataFrame:
    """Weights brought within the limits, in this order: each name, each group, all for cash, all for leverage."""
    out = positions.withColumn("weight", F.least("weight", F.lit(per_name)))
    total = F.sum("weight").over(day(group))
    out = out.withColumn("weight", F.col("weight") * F.when(total > per_group, per_group / total).otherwise(1.0))
    total = F.sum("weight").over(day())
    out = out.withColumn("weight", F.col("weight") * F.when((1 - total < cash) & (total > 0), (1 - cash) / total).otherwise(1.0))
    gross = F.sum(F.abs("weight")).over(day())
    return out.withColumn("weight", F.col("weight") * F.when(gross > leverage, leverage / gross).otherwise(1.0))


def group_turnover(positions: DataFrame, group: str) -> DataFrame:
    """(datetime, group, turnover): half the absolute change of weights against the holding day before; a name that is not held weighs nothing."""
    days = positions.select("datetime").distinct().withColumn("_next", F.lead("datetime").over(Window.orderBy("datetime")))
    placed = positions.join(F.broadcast(days), "datetime")
    now = placed.select("datetime", "instrument", group, F.col("weight").alias("d"))
    gone = placed.where("_next is not null").select(F.col("_next").alias("datetime"), "instrument", group, (-F.col("weight")).alias("d"))
    change = now.union(gone).groupBy("datetime", group, "instrument").agg(F.sum("d").alias("d"))
    out = change.groupBy("datetime", group).agg((F.sum(F.abs("d")) / 2).alias("turnover"))
    first = days.agg(F.min("datetime").alias("_first"))
    return out.join(F.broadcast(first), F.col("datetime") > F.col("_first")).drop("_first")


def concentration(positions: DataFrame) -> DataFrame:
    """One row: days, median and fewest holdings, median share of the ten largest, largest weight, median sum of squares."""
    place = F.row_number().over(day().orderBy(F.desc("weight"), "instrument"))
    days = positions.withColumn("_p", place).groupBy("datetime").agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(F.when(F.col("_p") <= 10, F.col("weight"))), F.sum("weight")).alias("top10"), F.max("weight").alias("most"), F.sum(F.col("weight") * F.col("weight")).alias("hhi")
    )
    return days.agg(F.count(F.lit(1)).alias("days"), F.median("n").alias("median_n"), F.min("n").alias("min_n"), F.median("top10").alias("median_top10"), F.max("most").alias("max_weight"), F.median("hhi").alias("median_hhi"))


def average_weights(positions: DataFrame) -> DataFrame:
    """(instrument, weight): mean over the holding days, rescaled to sum to 1; none where the sum is not positive."""
    sums = positions.groupBy("instrument").agg(F.sum("weight").alias("w"))
    total = F.sum("w").over(Window.partitionBy())
    return sums.withColumn("_t", total).where("_t > 0").select("instrument", (F.col("w") / F.col("_t")).alias("weight"))


def implied_weights(predictions: DataFrame) -> DataFrame:
    """(instrument, weight): mean score, none below 0, rescaled to sum to 1."""
    means = predictions.groupBy("instrument").agg(F.greatest(F.avg("score"), F.lit(0.0)).alias("w"))
    return means.withColumn("_t", F.sum("w").over(Window.partitionBy())).where("_t > 0").select("instrument", (F.col("w") / F.col("_t")).alias("weight"))


def period_returns(panel: DataFrame) -> DataFrame:
    """(instrument, ret): last over first close, less 1, of names with two closes at least."""
    there = panel.where("close is not null").groupBy("instrument").agg(F.min_by("close", "datetime").alias("a"), F.max_by("close", "datetime").alias("b"), F.count(F.lit(1)).alias("n"))
    return there.where((F.col("n") >= 2) & (F.col("a") != 0)).select("instrument", (F.col("b") / F.col("a") - 1).alias("ret"))


def attribution(groups: DataFrame, weights: DataFrame, bench_weights: DataFrame, returns: DataFrame, bench_total: DataFrame) -> DataFrame:
    """Brinson-Fachler effects per group. groups: (instrument, group); weights and bench_weights: (instrument, weight);
    returns: (instrument, ret); bench_total: one row (total). A group's return is 0 where it has no weight."""
    rows = groups.join(weights.withColumnRenamed("weight", "p"), "instrument", "left").join(bench_weights.withColumnRenamed("weight", "b"), "instrument", "left").join(returns, "instrument", "left")
    sums = rows.groupBy("group").agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(n) for n, x in {"w_p": F.col("p"), "w_b": F.col("b"), "s_p": F.col("p") * F.col("ret"), "s_b": F.col("b") * F.col("ret")}.items()])
    for side in "pb":
        sums = sums.withColumn(f"r_{side}", F.when(F.col(f"w_{side}") > 1e-9, F.col(f"s_{side}") / F.col(f"w_{side}")).otherwise(0.0))
    over, better = F.col("w_p") - F.col("w_b"), F.col("r_p") - F.col("r_b")
    out = sums.join(F.broadcast(bench_total), how="cross").select("group", "w_p", "w_b", "r_p", "r_b", (over * (F.col("r_b") - F.col("total"))).alias("allocation"), (F.col("w_b") * better).alias("selection"), (over * better).alias("interaction"))
    return out.withColumn("total", F.col("allocation") + F.col("selection") + F.col("interaction"))


def monthly(returns: DataFrame, bench: DataFrame) -> DataFrame:
    """(month, ret, bench): compounded per month; bench is NULL in a month without one. Both inputs: (datetime, ret)."""
    def by_month(df: DataFrame, name: str) -> DataFrame:
        return df.where("ret is not null").groupBy(F.trunc("datetime", "month").alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias(name))

    return by_month(returns, "ret").join(by_month(bench, "bench"), "month", "left")


def ranked(positions: DataFrame) -> DataFrame:
    """positions with `rank`, the place in the day by weight, ties by instrument."""
    return positions.withColumn("rank", F.row_number().over(day().orderBy(F.desc("weight"), "instrument")))


def nav(returns: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """(datetime, ret, nav, drawdown, bench, bench_nav, bench_drawdown) of returns (datetime, ret): the value of one unit and its distance
    from the highest so far; the benchmark (datetime, ret) on the same days, a missing return being 0. A series is as long
    as the calendar, so one task carries it."""
    so_far = Window.orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.where("ret is not null").select("datetime", "ret")
    rows = rows.join(bench.select("datetime", F.col("ret").alias("bench")), "datetime", "left") if bench is not None else rows.withColumn("bench", F.lit(None).cast("double"))
    other = F.product(1 + F.coalesce("bench", F.lit(0.0))).over(so_far)
    out = rows.withColumns({"nav": F.product(1 + F.col("ret")).over(so_far), "bench_nav": other if bench is not None else F.lit(None).cast("double")})
    out = out.withColumns({"drawdown": F.col("nav") / F.max("nav").over(so_far) - 1, "bench_drawdown": F.col("bench_nav") / F.max("bench_nav").over(so_far) - 1})
    return out.select("datetime", "ret", "nav", "drawdown", "bench", "bench_nav", "bench_drawdown")


def held_within(positions: DataFrame, group: str, limits: dict[str, float], scope: DataFrame | None = None, mode: str = "clip") -> DataFrame:
    """positions (datetime, instrument, group, weight) held within the limits of violations() on the days of scope (datetime; all without it).

    mode "clip": weights on these days as clipped() has them, others as they are; "raise": as they are, and the job that
    reads them fails on the first limit that a day of the scope breaks."""
    if mode not in ("clip", "raise"):
        raise ValueError(f"no mode {mode!r}")
    days = None if scope is None else F.broadcast(scope.select("datetime").distinct())
    inside = positions if days is None else positions.join(days, "datetime", "left_semi")
    if mode == "clip":
        out = clipped(inside, group, **limits)
        return out if days is None else out.unionByName(positions.join(days, "datetime", "left_anti"))
    first = violations(inside, group, **limits).agg(F.min(F.struct("datetime", "rule", "what", "actual")).alias("x"))
    told = F.concat_ws(" ", F.lit("limit broken:"), *[F.col(f"x.{c}").cast("string") for c in ("datetime", "rule", "what", "actual")])
    fine = first.select(F.when(F.col("x").isNotNull(), F.raise_error(told).cast("boolean")).otherwise(F.lit(True)).alias("_fine"))
    return positions.crossJoin(F.broadcast(fine)).where("_fine").drop("_fine")


def given_weights(weights: DataFrame, names: DataFrame) -> DataFrame:
    """(instrument, weight) of explicit weights (instrument, weight) over the given names: others count for nothing, names without a weight have 0, and all add up to 1. A weight that is negative or no finite number is an error, as are weights none of which is positive among the names."""
    w = F.col("weight").cast("double")
    fine = (w >= 0) & (w < float("inf"))
    checked = weights.select("instrument", F.when(F.coalesce(fine, F.lit(False)), w).otherwise(F.raise_error(F.concat(F.lit("a weight that is no finite non-negative number: "), F.col("instrument"))).cast("double")).alias("weight"))
    rows = names.select("instrument").distinct().join(checked, "instrument", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = rows.agg(F.sum("weight").alias("_sum"))
    share = F.when(F.col("_sum") > 0, F.col("weight") / F.col("_sum")).otherwise(F.raise_error(F.lit("no positive weight among the names")).cast("double"))
    return rows.join(F.broadcast(total), how="cross").select("instrument", share.alias("weight"))
