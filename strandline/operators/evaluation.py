"""Factors side by side: information tables, correlations, quality figures, buckets, tied scores.

Long factors: (datetime, instrument, factor, value). One job serves all factors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.factors import TINY
from strandline.operators import correlations
from strandline.operators.signal import average_rank, daily_ic, ic_summary


def unpivoted(panel: DataFrame, factors: dict[str, Column]) -> DataFrame:
    """Long factors from a dense panel; the rolling ones share one sort."""
    wide = panel.select("datetime", "instrument", *[c.cast("double").alias(name) for name, c in factors.items()])
    return wide.unpivot(["datetime", "instrument"], list(factors), "factor", "value")


def ic_table(factors: DataFrame, returns: DataFrame) -> DataFrame:
    """Per factor: days, mean_ic, std_ic, ir, positive. returns: (datetime, instrument, ret)."""
    joined = factors.withColumnRenamed("value", "score").join(returns, ["datetime", "instrument"])
    out = ic_summary(daily_ic(joined, "factor", "datetime"), "factor")
    return out.withColumn("ir", F.when(F.col("std_ic") > 1e-9, F.col("ir")))


def floor_ic(rows: DataFrame, *keys: str, least: int, method: str = "rank") -> DataFrame:
    """(keys, days, dropped, flat, mean_ic) of rows (keys, datetime, score, ret): the mean IC of days with at least `least` joint names,
    how many days had fewer (but one) and were dropped, and on how many of the others a side does not vary."""
    daily = daily_ic(rows, *keys, "datetime", method=method, least=least)
    thin = F.col("n") < least
    return daily.groupBy(*keys).agg(F.count("ic").alias("days"), F.count_if(thin).alias("dropped"), F.count_if(~thin & F.col("ic").isNull()).alias("flat"), F.avg("ic").alias("mean_ic"))


def t_summary(daily: DataFrame, *keys: str) -> DataFrame:
    """n, mean, std, ir and t of the column ic."""
    n, sd = F.count("ic"), F.stddev_samp("ic")
    out = daily.groupBy(*keys).agg(n.alias("n"), F.avg("ic").alias("mean"), sd.alias("std"))
    ir = F.when(F.col("std") > TINY, F.col("mean") / F.col("std"))
    return out.withColumn("ir", ir).withColumn("t", F.col("ir") * F.sqrt("n"))


def pooled_rank(rows: DataFrame, keys: tuple[str, ...], value: str, name: str, buckets: int = 64) -> DataFrame:
    """Average rank of value among all rows of the keys, though one key may hold the whole panel.

    Rows are counted per distinct value; values are dealt by approximate quantiles into buckets that are
    numbered apart, and the counts of the buckets before are added. The result is exact whatever the quantiles."""
    edges = rows.groupBy(*keys).agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 10_000).alias("_edges"))
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).join(edges, list(keys))
    counts = counts.withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    sums = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.join(sums, [*keys, "_b"]).withColumn(name, F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + (F.col("_n") + 1) / 2)
    return rows.join(ranks.select(*keys, value, name), [*keys, value])


def factor_correlation(wide: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(a, b, n, corr): Spearman over all cells where both factors of a pair are there, ranked within these cells."""
    return correlations.spearman(wide, names)


def factor_quality(factors: DataFrame, returns: DataFrame, least_std: float = TINY, most_abs: float = 10.0) -> DataFrame:
    """Per factor: coverage, mean absolute change, fewest joint names of a day, share of days that vary, share of outliers, valid."""
    moved = Window.partitionBy("factor", "instrument").orderBy("datetime")
    rows = factors.withColumn("_change", F.abs(F.col("value") - F.lag("value").over(moved))).join(returns, ["datetime", "instrument"], "left")
    there = F.col("value").isNotNull()
    days = rows.groupBy("factor", "datetime").agg(
        F.count(F.lit(1)).alias("cells"), F.count("value").alias("n"), F.sum("_change").alias("change"), F.count("_change").alias("changes"),
        F.count_if(there & F.col("ret").isNotNull()).alias("joint"), F.stddev_samp("value").alias("sd"), F.count_if(F.abs("value") > most_abs).alias("far"),
    )
    out = days.groupBy("factor").agg(
        (F.sum("n") / F.sum("cells")).alias("coverage"), F.coalesce(F.sum("change") / F.nullif(F.sum("changes"), F.lit(0)), F.lit(0.0)).alias("mean_abs_change"), F.min("joint").alias("min_joint"),
        F.avg(F.coalesce((F.col("sd") > least_std).cast("double"), F.lit(0.0))).alias("varying_days"), F.coalesce(F.sum("far") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("outliers"),
    )
    return out.withColumn("valid", (F.col("coverage") >= 0.8) & (F.col("varying_days") >= 0.7) & (F.col("outliers") <= 0.05))


def buckets(rows: DataFrame, value: str, n: int, name: str = "bucket") -> DataFrame:
    """Cuts each day's names in n buckets by quantiles of their order (value, instrument): the smallest b with rank <= 1 + (m - 1)(b + 1) / n."""
    day = Window.partitionBy("datetime", F.col(value).isNull())
    rank, m = F.row_number().over(day.orderBy(value, "instrument")), F.count(F.lit(1)).over(day)
    cut = F.when(m > 1, F.greatest(F.floor(((rank - 1) * n + m - 2) / (m - 1)) - 1, F.lit(0))).otherwise(0)
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), cut).cast("int"))


def bucket_returns(rows: DataFrame, n: int) -> DataFrame:
    """(bucket, n, mean_ret) of rows (datetime, instrument, score, ret)."""
    return buckets(rows.where("score is not null and ret is not null"), "score", n).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret"))


def rank_in_bucket(rows: DataFrame, value: str, bucket: str = "bucket") -> DataFrame:
    """Average rank of value over (names + 1) within a day's bucket."""
    rows = rows.where(F.col(value).isNotNull() & F.col(bucket).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy("datetime", bucket))
    return rows.withColumn("rank", average_rank(value, "datetime", bucket) / (n + 1))


def tied_scores(predictions: DataFrame, k: int) -> DataFrame:
    """Per day: n, n_unique, tie_density, n_tied_at_cutoff and tie_filled_slots, the picks that only the tie-break decides."""
    place = F.row_number().over(Window.partitionBy("datetime").orderBy(F.desc("score")))
    cutoff = F.min(F.when(F.col("_p") <= k, F.col("score"))).over(Window.partitionBy("datetime"))
    rows = predictions.where("score is not null").withColumn("_p", place).withColumn("_cut", cutoff)
    out = rows.groupBy("datetime").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("score").alias("n_unique"), F.count_if(F.col("score") > F.col("_cut")).alias("_above"), F.count_if(F.col("score") == F.col("_cut")).alias("_at"))
    inside = (F.col("n") > k) & (F.col("_above") + F.col("_at") > k)
    return out.select("datetime", "n", "n_unique", (1 - F.col("n_unique") / F.col("n")).alias("tie_density"), F.when(inside, F.col("_at")).otherwise(0).alias("n_tied_at_cutoff"), F.when(inside, k - F.col("_above")).otherwise(0).alias("tie_filled_slots"))


def recommended(scores: DataFrame, reasons: DataFrame, priority: tuple[str, ...], k: int) -> DataFrame:
    """All names of each day by score with their reason against trading, the first in priority; the first k tradable ones are picked.

    reasons: (datetime, instrument, reason), several a name; reasons outside priority come last, as they are."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("reason")), F.lit(0)), F.lit(len(priority) + 1))
    first = reasons.groupBy("datetime", "instrument").agg(F.min(F.struct(order.alias("o"), "reason"))["reason"].alias("reason"))
    rows = scores.where("score is not null").join(first, ["datetime", "instrument"], "left").withColumn("tradable", F.col("reason").isNull())
    best = [F.desc("score"), F.asc("instrument")]
    rank = F.row_number().over(Window.partitionBy("datetime").orderBy(*best))
    place = F.row_number().over(Window.partitionBy("datetime", "tradable").orderBy(*best))
    return rows.withColumn("rank", rank).withColumn("picked", F.col("tradable") & (place <= k))


def blended(members: DataFrame) -> DataFrame:
    """(datetime, instrument, score, n): mean score over the members that have one."""
    return members.groupBy("datetime", "instrument").agg(F.avg("score").alias("score"), F.count("score").alias("n"))


