"""Universes: who belongs when, how large a name was, which fields are there.

Calendars, spans of one universe and as-of days are small and broadcast; panels and sizes are not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import stamps
from strandline.operators.panel import members_at


def alive_members(days: DataFrame, spans: DataFrame, registry: DataFrame) -> DataFrame:
    """(datetime, instrument): members of each day without those delisted before it."""
    m = members_at(days, spans)
    gone = registry.select(F.col("instrument").alias("_i"), F.col("delist_date").alias("_d"))
    return m.join(gone, (m["instrument"] == gone["_i"]) & (gone["_d"] < m["datetime"]), "left_anti")


def listed_spans(active: DataFrame, delisted: DataFrame) -> DataFrame:
    """(instrument, start, end) of all names ever listed. active: (instrument, list_date); delisted: with delist_date too.
    A name on both lists keeps both spans."""
    still = active.select("instrument", F.col("list_date").alias("start"), F.to_date(F.lit("2099-12-31")).alias("end"))
    return still.unionByName(delisted.select("instrument", F.col("list_date").alias("start"), F.col("delist_date").alias("end")))


def first_of_lists(key: str, *lists: DataFrame) -> DataFrame:
    """All lists with each key once, from the first list that has it; of several in one list the least row."""
    marked = [df.select(F.col(key).alias("_key"), F.struct(F.lit(i).alias("_i"), F.struct(*df.columns).alias("row")).alias("x")) for i, df in enumerate(lists)]
    return reduce(DataFrame.unionByName, marked).groupBy("_key").agg(F.min("x").alias("x")).select("x.row.*")


def ever_members(spans: DataFrame) -> DataFrame:
    return spans.select("instrument").distinct()


def marked_out(mask: DataFrame, excluded: DataFrame) -> DataFrame:
    """mask (datetime, instrument, inside) with `inside` false for the excluded instruments; no row goes."""
    out = excluded.select(F.col("instrument").alias("_i"), F.lit(True).alias("_out")).distinct()
    return mask.join(out, mask["instrument"] == out["_i"], "left").withColumn("inside", F.col("inside") & F.col("_out").isNull()).drop("_i", "_out")


def overlaid(rows: DataFrame, replaced: DataFrame) -> DataFrame:
    """rows with whole days replaced by those of `replaced`."""
    days = replaced.select("datetime").distinct()
    return rows.join(days, "datetime", "left_anti").unionByName(replaced)


def common_days(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("datetime").intersect(b.select("datetime"))


def tail_months(rows: DataFrame, months: int) -> DataFrame:
    """Rows of the last months, counted back from the last day."""
    last = rows.agg(F.add_months(F.max("datetime"), -months).alias("_from"))
    return rows.join(F.broadcast(last), F.col("datetime") >= F.col("_from")).drop("_from")


def without_slices(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """rows outside all slices (start, end), both ends included. Overlapping slices are merged and rows meet their dates by equality."""
    return stamps.outside(rows, slices)


def sizes_as_of(sizes: DataFrame, at: DataFrame, days: DataFrame, most_sessions: int = 21) -> DataFrame:
    """(datetime, instrument, size, age): on each trading day of `at`, the last size that is there and at most
    most_sessions trading days old; names without one have no row. sizes: (datetime, instrument, size).

    A size row meets the days of `at` that it can serve in a table of the calendar's size, by the day's equality."""
    placed = days.join(at.select("datetime").distinct(), "datetime", "left_semi").select(F.col("datetime").alias("_on"), F.col("idx").alias("_at"))
    reach = days.select(F.col("datetime").alias("_d"), "idx", F.explode(F.sequence("idx", F.col("idx") + most_sessions)).alias("_at")).join(placed, "_at")
    own = sizes.where("size is not null").select("instrument", "size", "datetime")
    hits = own.join(F.broadcast(reach), own["datetime"] == F.col("_d")).select("instrument", "size", "idx", "_at", F.col("_on").alias("datetime"))
    return hits.groupBy("datetime", "instrument").agg(F.max_by("size", "idx").alias("size"), (F.max("_at") - F.max("idx")).alias("age"))


def market_weights(sizes: DataFrame, names: DataFrame, start: str, lookback_days: int) -> DataFrame:
    """(instrument, weight): share of the last size in the lookback up to `start`. One name without a positive size
    leaves all weights NULL, as shares of the rest would be wrong."""
    day = F.to_date(F.lit(start))
    last = sizes.where("size is not null").where(F.col("datetime").between(F.date_sub(day, lookback_days), day)).groupBy("instrument").agg(F.max_by("size", "datetime").alias("size"))
    rows = names.select("instrument").distinct().join(last, "instrument", "left")
    total = rows.agg(F.sum("size").alias("_sum"), F.count_if(F.coalesce(F.col("size") <= 0, F.lit(True))).alias("_bad"))
    return rows.join(F.broadcast(total), how="cross").select("instrument", F.when(F.col("_bad") == 0, F.col("size") / F.col("_sum")).alias("weight"))


def size_holes(sizes: DataFrame, spans: DataFrame, first: str, last: str) -> DataFrame:
    """(instrument, start, end) of the spans that reach into first..last but have no size inside both."""
    lo, hi = F.greatest("start", F.to_date(F.lit(first))), F.least("end", F.to_date(F.lit(last)))
    inside = spans.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi")
    there = sizes.where("size is not null").select(F.col("instrument").alias("_i"), F.col("datetime").alias("_d"))
    return inside.join(there, (inside["instrument"] == there["_i"]) & there["_d"].between(F.col("_lo"), F.col("_hi")), "left_anti").select("instrument", "start", "end")


def field_coverage(grid: DataFrame, served: DataFrame, fields: tuple[str, ...], anchor: str | None = None) -> DataFrame:
    """(datetime, field, names, there, coverage): on each day the share of the grid's names (datetime, code) that serve
    the field; with an anchor, of those that serve the anchor."""
    rows = grid.join(served, ["datetime", "code"], "left")
    if anchor is not None:
        rows = rows.where(F.col(anchor).isNotNull())
    sums = rows.groupBy("datetime").agg(F.count(F.lit(1)).alias("names"), *[F.count(c).alias(f"_n_{c}") for c in fields])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_n_{c}").alias("there")) for c in fields]))
    return sums.select("datetime", "names", cells.alias("x")).select("datetime", "x.field", "names", "x.there", (F.col("x.there") / F.col("names")).alias("coverage"))


def yearly_coverage(coverage: DataFrame) -> DataFrame:
    """(year, field, snapshots, coverage): mean over the year's snapshots."""
    return coverage.groupBy(F.year("datetime").alias("year"), "field").agg(F.count(F.lit(1)).alias("snapshots"), F.avg("coverage").alias("coverage"))


def below_floors(coverage: DataFrame, floors: dict[str, float]) -> DataFrame:
    """The rows of fields that are under their floor."""
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv]), F.col("field"))
    return coverage.withColumn("floor", floor).where("coverage < floor")


def position_weights(rows: DataFrame, cash: DataFrame) -> DataFrame:
    """(datetime, instrument, weight) of holdings (datetime, instrument, amount, price): value over the day's values and
    cash (datetime, cash), 0 where a day has none. Values that are no numbers go."""
    value: Column = F.col("amount") * F.col("price")
    held = rows.select("datetime", "instrument", value.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    total = held.groupBy("datetime").agg(F.sum("_v").alias("_s")).join(cash, "datetime", "left").select("datetime", (F.col("_s") + F.coalesce("cash", F.lit(0.0))).alias("_t"))
    return held.join(total, "datetime").where("_t > 0").select("datetime", "instrument", (F.col("_v") / F.col("_t")).alias("weight"))
