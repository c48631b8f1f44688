"""Plans of rebalance stamps by fold, with slices cut out, longer histories and longer holdings; date slices made clean.

A calendar is (datetime, idx); folds are (fold, start, end), the first and last date of a test window. All are small: dates
of windows are met by equality and no table of rows is involved until the plan is joined to a panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators.panel import on_days

#: Shared days that a paired comparison needs at least, and their share of the shorter run.
LEAST_DAYS, LEAST_SHARE = 20, 0.9


def merged_slices(slices: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, end) of date ranges, both ends included: those that overlap or touch become one, by the largest end so far. Ranges that end before they start, or lack an end, go."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    rows = slices.where("start <= end").select(*keys, "start", "end")
    rows = rows.withColumn("_new", F.coalesce((F.col("start") > F.date_add(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), 1)).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def sliced_out(slices: DataFrame, *keys: str) -> DataFrame:
    """(keys, datetime): the dates inside the slices, each once."""
    return merged_slices(slices, *keys).select(*keys, F.explode(F.sequence("start", "end")).alias("datetime"))


def outside(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """rows (datetime, ...) without those of the slices' dates, met by equality; a null datetime stays."""
    return rows.join(sliced_out(slices), "datetime", "left_anti")


def earlier_folds(folds: DataFrame, n: int, months: int = 3) -> DataFrame:
    """folds and n windows of so many months right before the first, numbered -1 (the nearest) to -n."""
    first = folds.agg(F.min("start").alias("_s"))
    back = first.select("_s", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k"))
    start = F.add_months("_s", -F.col("_k") * months)
    more = back.select((-F.col("_k")).cast(folds.schema["fold"].dataType).alias("fold"), start.alias("start"), F.date_sub(F.add_months("_s", (1 - F.col("_k")) * months), 1).alias("end"))
    return folds.select("fold", "start", "end").union(more)


def window_days(folds: DataFrame, days: DataFrame, last: str, removed: DataFrame | None = None) -> DataFrame:
    """(fold, part, datetime, pos, n): the calendar's days of each fold up to `last`, less those of removed slices (start, end).

    A removed slice parts a fold: what is left on either side is a part of its own, numbered by its first place, whose days are
    counted from 0 to n - 1.
    """
    inside = on_days(folds, days, F.col("start"), F.least(F.col("end"), F.to_date(F.lit(last)))).select("fold", "datetime").join(F.broadcast(days), "datetime")
    if removed is not None:
        inside = outside(inside, removed)
    rows = inside.withColumn("_run", F.col("idx") - F.row_number().over(Window.partitionBy("fold").orderBy("idx")))
    own = Window.partitionBy("fold", "_run")
    rows = rows.withColumns({"pos": F.row_number().over(own.orderBy("idx")) - 1, "n": F.count(F.lit(1)).over(own)})
    return rows.withColumn("part", F.dense_rank().over(Window.partitionBy("fold").orderBy("_run")) - 1).select("fold", "part", "datetime", "pos", "n")


def scheduled(placed: DataFrame, cadence: int, phase: int) -> DataFrame:
    """(fold, part, signal, execution, horizon_end): days phase, phase + cadence, ... of each part but its last day, filled the day after, held to the next fill or the part's last day. Those held no day are among them, with execution = horizon_end."""
    own = Window.partitionBy("fold", "part").orderBy("pos")
    near = placed.withColumns({"execution": F.lead("datetime").over(own), "_end": F.max("datetime").over(Window.partitionBy("fold", "part"))})
    due = near.where((F.col("pos") >= phase) & ((F.col("pos") - phase) % cadence == 0) & (F.col("pos") < F.col("n") - 1))
    return due.select("fold", "part", F.col("datetime").alias("signal"), "execution", F.coalesce(F.lead("execution").over(own), "_end").alias("horizon_end"))


def stamp_plan(folds: DataFrame, days: DataFrame, last: str, cadence: int, phase: int, removed: DataFrame | None = None) -> DataFrame:
    """(fold, kind, signal, execution, horizon_end) of all folds; a fold's first is "primary", others "tail". The phase starts anew in each fold and after each removed slice."""
    kept = scheduled(window_days(folds, days, last, removed), cadence, phase).where("horizon_end > execution")
    nth = F.row_number().over(Window.partitionBy("fold").orderBy("signal"))
    return kept.select("fold", F.when(nth == 1, "primary").otherwise("tail").alias("kind"), "signal", "execution", "horizon_end")


def stamp_counts(folds: DataFrame, days: DataFrame, last: str, cadence: int, phase: int, removed: DataFrame | None = None) -> DataFrame:
    """(fold, n_days, n_stamps, n_zero, fault) of each fold: days left, stamps kept, stamps held no day (dropped), and what makes the fold unusable:
    'too few days' (under 3 in all), 'no stamp can be filled', 'all are held no day', or NULL."""
    placed = window_days(folds, days, last, removed)
    due = scheduled(placed, cadence, phase).groupBy("fold").agg(F.count_if(F.col("horizon_end") > F.col("execution")).alias("n_stamps"), F.count_if(F.col("horizon_end") <= F.col("execution")).alias("n_zero"))
    out = folds.select("fold").join(placed.groupBy("fold").agg(F.count(F.lit(1)).alias("n_days")), "fold", "left").join(due, "fold", "left").na.fill(0, ["n_days", "n_stamps", "n_zero"])
    fault = F.when(F.col("n_days") < 3, "too few days").when(F.col("n_stamps") + F.col("n_zero") == 0, "no stamp can be filled").when(F.col("n_stamps") == 0, "all are held no day")
    return out.withColumn("fault", fault)


def held_over(folds: DataFrame, days: DataFrame, last: str, span: int) -> DataFrame:
    """(fold, kind, signal, execution, horizon_end): one stamp at the begin of every span-th fold, held to the last day of the span's last fold; spans that the folds do not fill go, and those without a day to hold."""
    order = Window.orderBy("start")
    chains = folds.select("fold", "start", (F.row_number().over(order) - 1).alias("_i"), F.lead("end", span - 1).over(order).alias("_e")).where((F.col("_i") % span == 0) & F.col("_e").isNotNull())
    inside = on_days(chains, days, F.col("start"), F.least(F.col("_e"), F.to_date(F.lit(last))))
    nth = F.row_number().over(Window.partitionBy("fold").orderBy("datetime"))
    ends = inside.withColumn("_n", nth).groupBy("fold").agg(F.min("datetime").alias("signal"), F.max(F.when(F.col("_n") == 2, F.col("datetime"))).alias("execution"), F.max("datetime").alias("horizon_end"))
    return ends.where("horizon_end > execution").select("fold", F.lit("primary").alias("kind"), "signal", "execution", "horizon_end")


def slice_checks(a: DataFrame, b: DataFrame, slices: DataFrame, least_days: int = LEAST_DAYS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(slices, n_a, n_b, n_shared, n_out, fault) of two runs' days (datetime) without each named set of slices (slices, start, end).

    fault: 'nothing removed' (no shared day is in the slices, so the set would repeat the full comparison), 'too few days'
    (under least_days shared ones left), 'too little overlap' (shared under least_share of the shorter run's days), else NULL.
    Both runs meet all sets by date, a row for each set and day.
    """
    names = slices.select("slices").distinct()
    gone = sliced_out(slices, "slices").withColumn("_gone", F.lit(True))
    each = a.select("datetime").distinct().withColumn("_a", F.lit(1)).join(b.select("datetime").distinct().withColumn("_b", F.lit(1)), "datetime", "full")
    rows = each.crossJoin(F.broadcast(names)).join(F.broadcast(gone), ["slices", "datetime"], "left")
    left, both = F.col("_gone").isNull(), F.col("_a").isNotNull() & F.col("_b").isNotNull()
    out = rows.groupBy("slices").agg(
        F.count_if(left & F.col("_a").isNotNull()).alias("n_a"), F.count_if(left & F.col("_b").isNotNull()).alias("n_b"), F.count_if(left & both).alias("n_shared"), F.count_if(~left & both).alias("n_out")
    )
    fault = F.when(F.col("n_out") == 0, "nothing removed").when(F.col("n_shared") < least_days, "too few days").when(F.col("n_shared") < least_share * F.least("n_a", "n_b"), "too little overlap")
    return out.withColumn("fault", fault)
