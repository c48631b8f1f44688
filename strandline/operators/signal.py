"""Signals: forward returns, information coefficients, decay, turnover, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.factors import by_time, div_safe, safe_corr


def forward_return(price: Column, horizon: int, entry: int = 1) -> Column:
    """price[t + entry + horizon] / price[t + entry] - 1 over dense rows."""
    return div_safe(F.lead(price, entry + horizon).over(by_time()), F.lead(price, entry).over(by_time())) - 1


def average_rank(x: str, *keys: str) -> Column:
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2


def daily_ic(rows: DataFrame, *keys: str, method: str = "rank", least: int = 3) -> DataFrame:
    """Per keys: n and ic of (score, ret) where both are there; NULL under `least` names or where a side is flat."""
    rows = rows.where("score is not null and ret is not null")
    if method == "rank":
        rows = rows.withColumns({"_x": average_rank("score", *keys), "_y": average_rank("ret", *keys)})
    else:
        day = Window.partitionBy(*keys)
        rows = rows.withColumns({"_x": F.col("score") - F.avg("score").over(day), "_y": F.col("ret") - F.avg("ret").over(day)})
    x, y = F.col("_x"), F.col("_y")
    n = F.count(F.lit(1)).cast("double")
    ic = safe_corr(n, F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, ic).alias("ic"))


def signal_summary(daily: DataFrame, *keys: str, least: int = 10) -> DataFrame:
    """ic_summary of a signal, all but the days NULL under `least` days with an IC; per keys, or one row."""
    out = ic_summary(daily, *keys)
    return out.select(*keys, "days", *[F.when(F.col("days") >= least, F.col(c)).alias(c) for c in out.columns if c not in ("days", *keys)])


def ic_summary(daily: DataFrame, *keys: str) -> DataFrame:
    """Days, mean, sample deviation, mean over deviation and share of positive days; one of 1e-12 or less is a zero, whatever the order of its sums."""
    sd = F.stddev_samp("ic")
    return daily.where("ic is not null").groupBy(*keys).agg(F.count("ic").alias("days"), F.avg("ic").alias("mean_ic"), sd.alias("std_ic"), F.when(sd > 0, F.avg("ic") / sd).alias("ir"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("positive"))


def top_names(predictions: DataFrame, k: int) -> DataFrame:
    """The k best names of each day; ties by instrument."""
    rank = F.row_number().over(Window.partitionBy("datetime").orderBy(F.desc("score"), "instrument"))
    return predictions.where("score is not null").withColumn("rank", rank).where(F.col("rank") <= k)


def name_turnover(predictions: DataFrame, k: int) -> DataFrame:
    """(datetime, turnover): share of a day's names that the signal day before had not."""
    top = top_names(predictions, k).select("datetime", "instrument")
    days = top.select("datetime").distinct().withColumn("_before", F.lag("datetime").over(Window.orderBy("datetime")))
    own = top.join(F.broadcast(days), "datetime").where("_before is not null")
    old = top.select(F.col("datetime").alias("_before"), "instrument", F.lit(1).alias("_old"))
    return own.join(old, ["_before", "instrument"], "left").groupBy("datetime").agg(F.avg(F.when(F.col("_old").isNull(), 1.0).otherwise(0.0)).alias("turnover"))


def turnover_summary(predictions: DataFrame, k: int) -> DataFrame:
    """One row: days, mean and population deviation of the daily turnover of the k best names."""
    return name_turnover(predictions, k).agg(F.count("turnover").alias("days"), F.avg("turnover").alias("mean"), F.stddev_pop("turnover").alias("std"))


def returns_by_lag(dense: DataFrame, lags: tuple[int, ...], entry: int = 0) -> DataFrame:
    """(datetime, instrument, lag, ret): all lags from one sort, then unpivoted."""
    columns = {f"_r{h}": forward_return(F.col("close"), h, entry) for h in lags}
    wide = dense.select("datetime", "instrument", *[c.alias(a) for a, c in columns.items()])
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("lag"), F.col(f"_r{h}").alias("ret")) for h in lags]))
    return wide.select("datetime", "instrument", cells.alias("x")).select("datetime", "instrument", "x.lag", "x.ret")


def equal_weight_returns(predictions: DataFrame, dense: DataFrame, k: int) -> DataFrame:
    """(datetime, ret, n): mean return of the day's k best, entered the day after and held one day."""
    moved = dense.select("datetime", "instrument", forward_return(F.col("close"), 1).alias("ret"))
    return top_names(predictions, k).join(moved, ["datetime", "instrument"]).groupBy("datetime").agg(F.avg("ret").alias("ret"), F.count("ret").alias("n"))


def signal_analysis(predictions: DataFrame, dense: DataFrame, k: int, lags: tuple[int, ...], entry: int = 1, least: int = 10) -> DataFrame:
    """(lag, days, mean_ic, std_ic, ir, positive, turnover, turnover_std) of predictions: the IC by lag, from prices `entry` days later,
    NULL under `least` days, and the daily turnover of the k best names with its deviation, the same in each row."""
    daily = daily_ic(returns_by_lag(dense, lags, entry).join(predictions, ["datetime", "instrument"]), "lag", "datetime")
    turned = turnover_summary(predictions, k).select(F.col("mean").alias("turnover"), F.col("std").alias("turnover_std"))
    return signal_summary(daily, "lag", least=least).crossJoin(F.broadcast(turned))
