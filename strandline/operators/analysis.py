"""Analyses in one call: of factors, and of a signal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.factors import TINY
from strandline.operators import correlations
from strandline.operators.signal import daily_ic, forward_return, ic_summary
from strandline.sources.shared import kept_table, new_path


@dataclass(frozen=True)
class FactorAnalysis:
    """Tables of one analysis. ic: (factor, days, mean_ic, std_ic, ir, positive, place), place by falling absolute mean;
    correlation: (a, b, n, corr) of the best factors, both ways and with themselves; decay: (factor, lag, days, mean_ic) of the best;
    best: their names; path: where the table that all were taken from lies."""

    ic: DataFrame
    correlation: DataFrame
    decay: DataFrame
    best: tuple[str, ...]
    path: str


def cells(wide: DataFrame, names: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """(datetime, factor, lag, score, ret) of a wide table with factors and returns _r<lag>, where both are there: one explode, no join."""
    factor = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("score")) for n in names]))
    ret = F.explode(F.array(*[F.struct(F.lit(h).alias("lag"), F.col(f"_r{h}").alias("ret")) for h in lags]))
    out = wide.select("datetime", factor.alias("f"), *[f"_r{h}" for h in lags]).where("f.score is not null")
    return out.select("datetime", "f.factor", "f.score", ret.alias("r")).where("r.ret is not null").select("datetime", "factor", "r.lag", "score", "r.ret")


def factor_analysis(panel: DataFrame, factors: Mapping[str, Column], forward: int = 1, top: int = 10, most_lag: int = 5, method: str = "rank", price: str = "close", path: str | None = None) -> FactorAnalysis:
    """Information, correlation and decay of factors over a dense panel, in one call.

    The panel is scanned once: factors and the returns of all lags (from the day's own price) are worked out in one sort by
    name and written as a wide table, from which each result reads its columns. Information is at the lag `forward`,
    correlation and decay (lags 1 to most_lag) are of the `top` factors with the largest absolute mean, ties by name; a
    factor without a day is last. path: a new folder, by default in the shared folder; it stays, as results read it.
    """
    if forward < 1 or most_lag < 1 or top < 1:
        raise ValueError("forward, most_lag and top must be at least 1")
    if not factors:
        raise ValueError("no factors")
    spark = panel.sparkSession
    path = path or new_path(spark, "factor-analysis")
    lags = sorted({forward, *range(1, most_lag + 1)})
    own = {n: c.cast("double") for n, c in factors.items()}
    fine = {n: F.when(F.abs(c) < F.lit(float("inf")), c).alias(n) for n, c in own.items()}
    wide = kept_table(panel.select("datetime", "instrument", *fine.values(), *[forward_return(F.col(price), h, 0).alias(f"_r{h}") for h in lags]), f"{path}/wide")
    daily = daily_ic(cells(wide, list(factors), [forward]), "factor", "datetime", method=method)
    ic = ic_summary(daily, "factor").withColumn("ir", F.when(F.col("std_ic") > TINY, F.col("ir")))
    ic = spark.createDataFrame([(n,) for n in factors], "factor string").join(ic, "factor", "left").na.fill(0, ["days"])
    ic = kept_table(ic, f"{path}/ic")
    # A row for each factor; the plans of the other results are made from the names.
    order = [F.abs("mean_ic").desc_nulls_last(), "factor"]
    ranked = [r["factor"] for r in ic.orderBy(*order).select("factor").collect()]
    best = tuple(ranked[:top])
    place = F.array_position(F.array(*map(F.lit, ranked)), F.col("factor")).cast("int")
    pairs = correlations.spearman(wide, best) if len(best) > 1 else spark.createDataFrame([], "a string, b string, n long, corr double")
    same = wide.agg(*[F.count(n).alias(n) for n in best]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("a"), F.lit(n).alias("b"), F.col(n).alias("n")) for n in best])).alias("x")).select("x.*", F.lit(1.0).alias("corr"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "corr")).unionByName(same)
    decay = daily_ic(cells(wide, best, range(1, most_lag + 1)), "factor", "lag", "datetime", method=method)
    decay = ic_summary(decay, "factor", "lag").select("factor", "lag", "days", "mean_ic")
    return FactorAnalysis(ic.withColumn("place", place), both, decay, best, path)
