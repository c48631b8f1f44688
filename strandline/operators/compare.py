"""Two runs side by side: paired differences, their memory and a circular block bootstrap.

Series (datetime, ret) are as long as the calendar, so their numbering and broadcasts stay small; draws spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.sources.shared import kept_table, new_path

MOST_LAG = 40
#: Share of the shorter run's days, days and draws that a comparison needs at least, and the narrowest interval that may decide.
LEAST_SHARE, LEAST_DAYS, LEAST_DRAWS, LEAST_WIDTH = 0.9, 20, 1000, 1e-6


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(datetime, idx, x): a less b on the days that both have."""
    both = a.where("ret is not null").join(b.where("ret is not null").withColumnRenamed("ret", "_b"), "datetime")
    return both.select("datetime", (F.row_number().over(Window.orderBy("datetime")) - 1).alias("idx"), (F.col("ret") - F.col("_b")).alias("x"))


def annual_ir(series: DataFrame, column: str = "x", periods: int = 252) -> DataFrame:
    """One row: n, mean, std, ir (mean over sample deviation, a year); NULL under two values or where nothing varies."""
    sd = F.stddev_samp(column)
    return series.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), sd.alias("std"), F.when(sd > 1e-15, F.avg(column) / sd * F.sqrt(F.lit(float(periods)))).alias("ir"))


def block_length(series: DataFrame) -> DataFrame:
    """One row (n, block): the first lag at which the autocorrelation falls under 2 / sqrt(n); the longest where it never
    does; 1 under eight days or where nothing varies."""
    stats = series.agg(F.count("x").alias("n"), F.avg("x").alias("_m"))
    centred = series.join(F.broadcast(stats), how="cross").select("idx", "n", (F.col("x") - F.col("_m")).alias("x"))
    total = centred.agg(F.max("n").alias("n"), F.sum(F.col("x") * F.col("x")).alias("_ss"))
    lags = centred.select("n", "x", F.explode(F.sequence(F.lit(1), F.lit(MOST_LAG - 1))).alias("lag"), "idx").where(F.col("lag") < F.floor(F.col("n") / 2))
    shifted = centred.select(F.col("idx").alias("_i"), F.col("x").alias("_y"))
    products = lags.join(F.broadcast(shifted), F.col("_i") == F.col("idx") + F.col("lag")).groupBy("lag").agg(F.sum(F.col("x") * F.col("_y")).alias("_p"))
    short = products.join(F.broadcast(total), how="cross").where(F.abs(F.try_divide("_p", "_ss")) < 2 / F.sqrt("n")).agg(F.min("lag").alias("_lag"))
    block = F.when((F.col("n") < 8) | (F.col("_ss") == 0), F.lit(1)).otherwise(F.coalesce("_lag", F.least(F.floor(F.col("n") / 2), F.lit(MOST_LAG)))).cast("int")
    return total.join(short, how="cross").select("n", block.alias("block"))


def block_bootstrap(series: DataFrame, block: DataFrame, draws: int, seed: int, scale: float = 252.0) -> DataFrame:
    """One row: n, block, point, se, lo, hi of the mean times scale, from circular blocks.

    Block j of draw b starts at the first 32 bits of md5('seed:b:j') modulo n, so any engine draws the same."""
    spark = series.sparkSession
    at = spark.range(draws).select(F.col("id").alias("b")).join(F.broadcast(block), how="cross").select("b", "n", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    j = F.floor(F.col("pos") / F.col("block"))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), j.cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = at.select("b", F.pmod(start + F.col("pos") % F.col("block"), F.col("n")).alias("_i"))
    means = drawn.join(F.broadcast(series.select("idx", "x")), F.col("_i") == F.col("idx")).groupBy("b").agg((F.avg("x") * scale).alias("m"))
    spread = means.agg(F.stddev_pop("m").alias("se"), F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    point = series.agg((F.avg("x") * scale).alias("point"))
    return block.join(point, how="cross").join(spread, how="cross")


def verdict(result: DataFrame) -> DataFrame:
    """Adds `verdict`: which side the interval lies on, or neither."""
    return result.withColumn("verdict", F.when(F.col("lo") > 0, "a").when(F.col("hi") < 0, "b").otherwise("undecided"))


def seam(run: DataFrame, column: str = "excess") -> DataFrame:
    """One row (incl, excl, impact): the yearly ratio of a run (datetime, column, boundary) with the days where folds meet, without them, and what leaving them out changes."""
    def ir(x: Column) -> Column:
        sd = F.stddev_samp(x)
        return F.when(sd > 1e-15, F.avg(x) / sd * F.sqrt(F.lit(252.0)))

    out = run.agg(ir(F.col(column)).alias("incl"), ir(F.when(~F.coalesce("boundary", F.lit(False)), F.col(column))).alias("excl"))
    return out.withColumn("impact", F.col("excl") - F.col("incl"))


def compared_runs(a: DataFrame, b: DataFrame, draws: int, seed: int, least_share: float = LEAST_SHARE, least_days: int = LEAST_DAYS, least_draws: int = LEAST_DRAWS) -> DataFrame:
    """One row: is run b better than run a? Runs: (datetime, excess, gross, ic, boundary), one row a day; ic and gross may be NULL.

    n_a, n_b, n_shared, overlap (shared days over the shorter run's); block, point, se, lo, hi of the yearly mean difference
    b - a from a paired circular block bootstrap, and verdict (treatment_better, treatment_worse or indistinguishable: by the interval
    alone); over the shared days gross_ir_a, gross_ir_b, and over those with both coefficients n_ic, mean_ic_a, mean_ic_b, ic_lo, ic_hi and
    ic_verdict (treatment, baseline or indistinguishable; that too under least_days of them); contradiction, where the coefficient's
    verdict is directional and the return's is not the same; seam_a, seam_b: what leaving out the days where folds meet
    changes in each run's own yearly ratio. Refused, by failing the job that reads the row: too little overlap, too few
    shared days, a direction that rests on an interval without width.
    """
    if draws < least_draws:
        raise ValueError(f"{draws} draws give no stable interval; {least_draws} at least")
    # Series are read by many small jobs, so they are written once; they are as long as the calendar.
    path = new_path(a.sparkSession, "compared-runs")
    own = {k: kept_table(r.where("excess is not null and not isnan(excess)").select("datetime", "excess", "gross", "ic", "boundary"), f"{path}/{k}") for k, r in (("a", a), ("b", b))}
    both = own["a"].join(own["b"].select("datetime", *[F.col(c).alias(f"_{c}") for c in ("excess", "gross", "ic")]), "datetime")
    order = F.row_number().over(Window.orderBy("datetime")) - 1
    net = both.select("datetime", order.alias("idx"), (F.col("_excess") - F.col("excess")).alias("x"))
    main = block_bootstrap(net, block_length(net), draws, seed).drop("n")
    has_ic = both.where("ic is not null and _ic is not null")
    ics = has_ic.select("datetime", order.alias("idx"), (F.col("_ic") - F.col("ic")).alias("x"))
    ic_row = block_bootstrap(ics, block_length(ics), draws, seed, 1.0).select(F.col("lo").alias("ic_lo"), F.col("hi").alias("ic_hi"))

    def ir(x: str) -> Column:
        sd = F.stddev_samp(x)
        return F.when(sd > 1e-15, F.avg(x) / sd * F.sqrt(F.lit(252.0)))

    facts = both.agg(F.count(F.lit(1)).alias("n_shared"), ir("gross").alias("gross_ir_a"), ir("_gross").alias("gross_ir_b"))
    means = has_ic.agg(F.count(F.lit(1)).alias("n_ic"), F.avg("ic").alias("mean_ic_a"), F.avg("_ic").alias("mean_ic_b"))
    out = own["a"].agg(F.count(F.lit(1)).alias("n_a"))
    for one in (own["b"].agg(F.count(F.lit(1)).alias("n_b")), facts, means, main, ic_row, *(seam(own[k]).select(F.col("impact").alias(f"seam_{k}")) for k in "ab")):
        out = out.join(F.broadcast(one), how="left", on=F.lit(True))
    side = F.when(F.col("lo") > 0, "treatment_better").when(F.col("hi") < 0, "treatment_worse").otherwise("indistinguishable")
    out = out.withColumn("overlap", F.try_divide("n_shared", F.least("n_a", "n_b"))).withColumn("verdict", side)
    enough = F.col("n_ic") >= least_days
    out = out.withColumn("ic_verdict", F.when(enough & (F.col("ic_lo") > 0), "treatment").when(enough & (F.col("ic_hi") < 0), "baseline").otherwise("indistinguishable"))
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in ("ic_lo", "ic_hi")})
    against = ((F.col("ic_verdict") == "baseline") & (F.col("verdict") != "treatment_worse")) | ((F.col("ic_verdict") == "treatment") & (F.col("verdict") != "treatment_better"))
    out = out.withColumn("contradiction", against)
    fault = (
        F.when(F.coalesce(F.col("overlap") < least_share, F.lit(True)), "the runs share too few of their days").when(F.col("n_shared") < least_days, "too few shared days")
        .when((F.col("verdict") != "indistinguishable") & (F.col("hi") - F.col("lo") <= LEAST_WIDTH), "a direction on an interval without width")
    )
    return out.withColumn("verdict", F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.col("verdict")))
