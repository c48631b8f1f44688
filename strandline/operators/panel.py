"""Panels: calendar, densification, adjustment, masks, membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.factors import by_time


def calendar(panel: DataFrame) -> DataFrame:
    """(datetime, idx): the distinct days, numbered from 0. Days are few however long the panel is."""
    return panel.select("datetime").distinct().withColumn("idx", F.row_number().over(Window.orderBy("datetime")) - 1)


def densify(panel: DataFrame, days: DataFrame) -> DataFrame:
    """A row for each day and instrument; NULL where the panel has none. days: (datetime, idx)."""
    grid = panel.select("instrument").distinct().crossJoin(F.broadcast(days))
    return grid.join(panel, ["datetime", "instrument"], "left")


def aligned(panel: DataFrame, days: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(datetime, instrument, start_index, fields): each name's rows on every day of the calendar from its own first day to
    the calendar's last, whatever its last day is. days: (datetime, idx); start_index is the first day's idx. A field
    that is no number, or that the panel lacks, is NULL. Rows off the calendar go; of repeated days the least row stays. A name whose first day is off the calendar starts on the next."""
    there = [c for c in fields if c in panel.columns]
    own = panel.where("instrument is not null").groupBy("datetime", "instrument").agg(F.min(F.struct(F.lit(0).alias("_"), *[F.col(c).try_cast("double").alias(c) for c in there])).alias("_x")).select("datetime", "instrument", *[f"_x.{c}" for c in there])
    first = own.groupBy("instrument").agg(F.min("datetime").alias("first"))
    grid = on_days(first, days, F.col("first"), F.to_date(F.lit("9999-12-31"))).select("datetime", "instrument")
    start = F.min("idx").over(Window.partitionBy("instrument")).alias("start_index")
    rows = grid.join(own, ["datetime", "instrument"], "left").join(F.broadcast(days.select("datetime", "idx")), "datetime")
    return rows.select("datetime", "instrument", start, *[(F.col(c) if c in there else F.lit(None).cast("double")).alias(c) for c in fields])


def adjusted(dense: DataFrame, factors: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """Prices times the adjustment factor, which holds until the next one and is 1 before the first. A factor that is not a positive number is an error."""
    raw = F.col("adj_factor").cast("double")
    fine = raw.isNull() | ((raw > 0) & ~F.isnan(raw) & (raw < float("inf")))
    factors = factors.withColumn("adj_factor", F.when(fine, raw).otherwise(F.raise_error(F.lit("adjustment factor that is not a positive number")).cast("double")))
    held = F.coalesce(F.last("adj_factor", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    out = dense.join(factors, ["datetime", "instrument"], "left").withColumn("_held", held)
    return out.withColumns({c: F.col(c) * F.col("_held") for c in columns}).drop("_held", "adj_factor")


def after_delisting(dense: DataFrame, registry: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """All fields NULL after the delisting day; rows stay. registry: (instrument, delist_date), a row an instrument."""
    known = registry.select(F.col("instrument").alias("_i"), F.col("delist_date").alias("_d"))
    out = dense.join(known, dense["instrument"] == known["_i"], "left")
    return out.withColumns({c: F.when(F.col("_d").isNull() | (F.col("datetime") <= F.col("_d")), F.col(c)) for c in fields}).drop("_i", "_d")


def clipped_at_delisting(panel: DataFrame, registry: DataFrame) -> DataFrame:
    """Without rows after the delisting day."""
    known = registry.select(F.col("instrument").alias("_i"), F.col("delist_date").alias("_d"))
    return panel.join(known, (panel["instrument"] == known["_i"]) & (panel["datetime"] > known["_d"]), "left_anti")


def suspended() -> Column:
    return F.coalesce(F.col("volume") < 1, F.lit(True)) | F.col("close").isNull()


def one_price() -> Column:
    return ~suspended() & F.coalesce(F.col("high") == F.col("low"), F.lit(False))


def unavailable(dense: DataFrame) -> DataFrame:
    """(datetime, instrument, reason) of suspended and one-price rows."""
    reason = F.when(suspended(), "suspended").when(one_price(), "one_price")
    return dense.select("datetime", "instrument", reason.alias("reason")).where("reason is not null")


def limit_blocked(most: float) -> tuple[Column, Column]:
    """Whether buying and selling are blocked by the day's move against the row before; no row before blocks both."""
    move = F.col("close") / F.lag("close").over(by_time()) - 1
    return F.coalesce(~(move <= most), F.lit(True)), F.coalesce(~(move >= -most), F.lit(True))


def membership_runs(snapshots: DataFrame) -> DataFrame:
    """(instrument, start, end) from snapshots (datetime, instrument): a span for each run of consecutive snapshots; end is
    2099-12-31 where the run reaches the last one. Days are numbered through their own small table."""
    days = calendar(snapshots)
    last = days.agg(F.max("idx").alias("_last"))
    placed = snapshots.distinct().join(F.broadcast(days), "datetime").withColumn("run", F.col("idx") - F.row_number().over(by_time()))
    runs = placed.groupBy("instrument", "run").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end"), F.max("idx").alias("_idx"))
    return runs.join(F.broadcast(last), how="cross").select("instrument", "start", F.when(F.col("_idx") == F.col("_last"), F.to_date(F.lit("2099-12-31"))).otherwise(F.col("end")).alias("end"))


def on_days(rows: DataFrame, days: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """rows with `datetime`, a row for each day of the calendar from the date lo to the date hi; rows with a null end go.

    Dates between both, inside the calendar, are exploded and met by equality, so work follows the result."""
    edge = days.agg(F.min("datetime").alias("_a"), F.max("datetime").alias("_b"))
    inside = rows.where(lo.isNotNull() & hi.isNotNull()).join(F.broadcast(edge), how="cross").withColumns({"_lo": F.greatest(lo, F.col("_a")), "_hi": F.least(hi, F.col("_b"))}).where("_lo <= _hi")
    each = inside.withColumn("datetime", F.explode(F.sequence("_lo", "_hi"))).drop("_a", "_b", "_lo", "_hi")
    return each.join(F.broadcast(days.select("datetime").distinct()), "datetime")


def following(dates: DataFrame, days: DataFrame, name: str, gap: int) -> DataFrame:
    """dates (d, a date) with `name`, the first of the days at least `gap` days after d; NULL past the end.

    A small table has a row for each date between the first day and the last, so dates meet it by equality; those before it
    count as its first."""
    before = F.lag("datetime").over(Window.orderBy("datetime"))
    runs = days.select("datetime").distinct().select("datetime", F.coalesce(F.date_sub(before, gap - 1), F.date_sub("datetime", gap)).alias("_from"))
    each = runs.select(F.explode(F.sequence("_from", F.date_sub("datetime", gap))).alias("_d"), F.col("datetime").alias(name))
    first = days.agg(F.date_sub(F.min("datetime"), gap).alias("_first"))
    key = F.when(F.col("d") < F.col("_first"), F.col("_first")).otherwise(F.to_date("d"))
    return dates.join(F.broadcast(first), how="cross").withColumn("_key", key).join(F.broadcast(each), F.col("_key") == F.col("_d"), "left").drop("_first", "_key", "_d")


def members_at(days: DataFrame, spans: DataFrame) -> DataFrame:
    """(datetime, instrument): members of each day, both ends included."""
    return on_days(spans.select("instrument", "start", "end"), days, F.col("start"), F.col("end")).select("datetime", "instrument").distinct()


def next_day(dates: DataFrame, days: DataFrame) -> DataFrame:
    """dates (d) with `next`, the first calendar day after d; NULL past the end."""
    return following(dates, days, "next", 1)
