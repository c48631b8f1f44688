"""Trading days: cadence, lags, stamps, windows. A calendar (datetime, idx) is small and broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def every_nth(days: DataFrame, n: int, phase: int = 0) -> DataFrame:
    """Days whose index is phase, phase + n, ...; never the last, which cannot be filled."""
    last = F.max("idx").over(Window.partitionBy())
    return days.withColumn("_last", last).where((F.col("idx") >= phase) & ((F.col("idx") - phase) % n == 0) & (F.col("idx") < F.col("_last"))).drop("_last")


def first_of_weeks(days: DataFrame) -> DataFrame:
    """(datetime): first day of each ISO week, but for the last day of all."""
    week = [F.extract(F.lit("YEAROFWEEK"), "datetime"), F.weekofyear("datetime")]
    first = days.groupBy(*[w.alias(f"_w{i}") for i, w in enumerate(week)]).agg(F.min("datetime").alias("datetime")).select("datetime")
    return first.join(F.broadcast(days.agg(F.max("datetime").alias("_last"))), F.col("datetime") < F.col("_last")).drop("_last")


def thinned(signals: DataFrame, kept_days: DataFrame) -> DataFrame:
    """Signals of the kept days."""
    return signals.join(F.broadcast(kept_days.select("datetime")), "datetime", "left_semi")


def lagged(signals: DataFrame, k: int) -> DataFrame:
    """Signals stamped k signal days later; those past the end go."""
    days = signals.select("datetime").distinct()
    moved = days.select("datetime", F.lead("datetime", k).over(Window.orderBy("datetime")).alias("_to")).where("_to is not null")
    return signals.join(F.broadcast(moved), "datetime").drop("datetime").withColumnRenamed("_to", "datetime")


def moved_days(rows: DataFrame, days: DataFrame, by: int) -> DataFrame:
    """rows (datetime, ...) stamped `by` calendar days later (earlier if negative)."""
    step = F.lead("datetime", by) if by >= 0 else F.lag("datetime", -by)
    to = days.select("datetime", step.over(Window.orderBy("datetime")).alias("_to")).where("_to is not null")
    return rows.join(F.broadcast(to), "datetime").drop("datetime").withColumnRenamed("_to", "datetime")


def days_between(days: DataFrame, a: str, b: str, spans: DataFrame) -> DataFrame:
    """spans with `n_days`: trading days in the dates [a, b], the difference of two places in the calendar; spans with a null end go.

    A small table has the number of days before each date, from the first day to the date after the last."""
    own = days.select("datetime").distinct()
    edge = own.agg(F.min("datetime").alias("_lo"), F.date_add(F.max("datetime"), 1).alias("_hi"))
    ends = own.union(edge.select("_hi")).where("datetime is not null")
    order = Window.orderBy("datetime")
    runs = ends.select("datetime", F.coalesce(F.date_add(F.lag("datetime").over(order), 1), "datetime").alias("_from"), (F.row_number().over(order) - 1).cast("long").alias("_n"))
    before = runs.select(F.explode(F.sequence("_from", "datetime")).alias("_d"), "_n")
    one, two = (before.select(F.col("_d").alias(f"_d{i}"), F.col("_n").alias(f"_n{i}")) for i in "ab")
    at = spans.where(F.col(a).isNotNull() & F.col(b).isNotNull()).join(F.broadcast(edge), how="cross")
    at = at.withColumns({"_a": F.least(F.greatest(F.col(a), F.col("_lo")), F.col("_hi")), "_b": F.least(F.greatest(F.date_add(b, 1), F.col("_lo")), F.col("_hi"))})
    found = at.join(F.broadcast(one), F.col("_a") == F.col("_da"), "left").join(F.broadcast(two), F.col("_b") == F.col("_db"), "left")
    n = F.coalesce(F.greatest(F.col("_nb") - F.col("_na"), F.lit(0)), F.lit(0)).cast("long")
    return found.withColumn("n_days", n).drop("_lo", "_hi", "_a", "_b", "_da", "_na", "_db", "_nb")


def window_overlaps(windows: DataFrame) -> DataFrame:
    """windows (id, start, end) by start, with the days left open before each and the days it shares with those before."""
    before = Window.orderBy("start", "id").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.datediff("start", F.max("end").over(before)) - 1
    return windows.withColumn("gap_days", F.coalesce(F.greatest(apart, F.lit(0)), F.lit(0))).withColumn("overlap_days", F.coalesce(F.least(F.greatest(-apart, F.lit(0)), F.datediff("end", "start") + 1), F.lit(0)))


def depth(windows: DataFrame, *keys: str) -> DataFrame:
    """Most windows (start, end) open on one day, per keys, from a running sum of openings and closings."""
    events = F.explode(F.array(F.struct(F.col("start").alias("d"), F.lit(1).alias("s")), F.struct(F.date_add("end", 1).alias("d"), F.lit(-1).alias("s"))))
    steps = windows.select(*keys, events.alias("e")).groupBy(*keys, "e.d").agg(F.sum("e.s").alias("s"))
    return steps.withColumn("n", F.sum("s").over(Window.partitionBy(*keys).orderBy("d"))).groupBy(*keys).agg(F.max("n").alias("depth"))


def rolling_windows(days: DataFrame, train: int, valid: int, test: int, step: int, embargo: int) -> DataFrame:
    """(fold, train_start, train_end, valid_start, valid_end, test_start, test_end) over a calendar, in trading days.

    The ends of train and valid are pulled back by the embargo; a fold needs its whole test window and one day after it."""
    n = F.max("idx").over(Window.partitionBy()) + 1
    starts = days.withColumn("_n", n).where((F.col("idx") % step == 0) & (F.col("idx") + train + valid + test < F.col("_n")))
    at: dict[str, Column] = {
        "train_start": F.col("idx"), "train_end": F.col("idx") + train - 1 - embargo, "valid_start": F.col("idx") + train, "valid_end": F.col("idx") + train + valid - 1 - embargo,
        "test_start": F.col("idx") + train + valid, "test_end": F.col("idx") + train + valid + test - 1,
    }
    folds = starts.select((F.col("idx") / step).cast("long").alias("fold"), F.explode(F.array(*[F.struct(F.lit(k).alias("edge"), i.alias("i")) for k, i in at.items()])).alias("e"))
    placed = folds.join(F.broadcast(days.select(F.col("idx").alias("_i"), F.col("datetime").alias("_d"))), F.col("e.i") == F.col("_i"))
    return placed.groupBy("fold").agg(*[F.max(F.when(F.col("e.edge") == k, F.col("_d"))).alias(k) for k in at])


def stamps(days: DataFrame, n: int, phase: int = 0) -> DataFrame:
    """(signal, execution, horizon_end): every nth day but the last, filled a day later, held to the next fill or the last
    day; those held no day go."""
    later = days.select("idx", F.lead("datetime").over(Window.orderBy("datetime")).alias("execution"), F.max("datetime").over(Window.partitionBy()).alias("_last"))
    out = every_nth(days, n, phase).join(F.broadcast(later), "idx").withColumnRenamed("datetime", "signal")
    out = out.withColumn("horizon_end", F.coalesce(F.lead("execution").over(Window.orderBy("signal")), "_last"))
    return out.where("horizon_end > execution").select("signal", "execution", "horizon_end")
