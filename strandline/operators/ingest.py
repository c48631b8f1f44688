"""From raw vendor tables to panels, registries, benchmarks and industry maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.factors import by_time
from strandline.operators import panel

#: Industries whose issuers file statements without operating cost.
FINANCIAL_INDUSTRIES = ("银行", "证券", "保险", "多元金融", "信托", "金融")


def first_of_each(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row of each key, the first by order; the others of a key go."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_p", place).where("_p = 1").drop("_p")


def in_units(bars: DataFrame, lot: int = 100, money: int = 1000) -> DataFrame:
    """Volume from lots to shares, money from thousands to units."""
    return bars.withColumns({"volume": F.col("volume") * lot, "money": F.col("money") * money})


def with_basics(bars: DataFrame, basics: DataFrame | None, fields: Sequence[str]) -> DataFrame:
    """bars with the daily fields of basics; NULL where there is no row, no such column or no table."""
    there = [c for c in fields if basics is not None and c in basics.columns]
    out = bars if not there else bars.join(basics.select("datetime", "instrument", *there), ["datetime", "instrument"], "left")
    return out.withColumns({c: F.lit(None).cast("double") for c in fields if c not in there})


def from_first_day(dense: DataFrame, column: str = "close") -> DataFrame:
    """Without the days before an instrument's first."""
    seen = F.max(F.col(column).isNotNull()).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    return dense.withColumn("_s", seen).where("_s").drop("_s")


def build_panel(bars: DataFrame, factors: DataFrame, basics: DataFrame | None, registry: DataFrame, fields: Sequence[str], *order: str) -> DataFrame:
    """The whole market's panel: the first bar of each day and name in units and adjusted, basics joined, clipped at
    delisting, aligned to the calendar of all bars from each name's first day. factors: (datetime, instrument, adj_factor).
    order: columns by which the first of repeated bars is told, by default source_order as vendor.read_bars has it."""
    order = order or tuple(c for c in bars.columns if c == "source_order")
    if not order:
        raise ValueError("name the columns that order repeated bars")
    own = in_units(first_of_each(bars, ("instrument", "datetime"), *order)).drop(*order)
    days = panel.calendar(own)
    whole = panel.densify(with_basics(own, basics, fields), days)
    adjusted = panel.adjusted(whole, factors)
    return from_first_day(panel.clipped_at_delisting(adjusted, registry))


def feature_query(bars: DataFrame, registry: DataFrame, fields: Sequence[str], start: str, end: str, instruments: DataFrame | None = None) -> DataFrame:
    """(datetime, instrument, fields) of a range of days, NULL after delisting; of the given instruments, or all."""
    own = bars.where(F.col("datetime").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).select("datetime", "instrument", *fields)
    own = own if instruments is None else own.join(instruments.select("instrument").distinct(), "instrument", "left_semi")
    return panel.after_delisting(own, registry, tuple(fields))


def wide(long: DataFrame, field: str, instruments: Sequence[str]) -> DataFrame:
    """One row a day, a column for each of the named instruments."""
    return long.groupBy("datetime").agg(*[F.max(F.when(F.col("instrument") == i, F.col(field))).alias(i) for i in instruments])


def issuers_of(stocks: DataFrame, industries: Sequence[str] = FINANCIAL_INDUSTRIES) -> DataFrame:
    """Instruments whose industry is in the list."""
    return stocks.where(F.col("industry").isin(*industries)).select("instrument").distinct()


def current_members(members: DataFrame) -> DataFrame:
    """(index_code, instrument) of rows still in force (is_new = 'Y') with both codes."""
    return members.where("is_new = 'Y' and index_code is not null and instrument is not null").select("index_code", "instrument")


def of_level(classes: DataFrame, level: str) -> DataFrame:
    """(index_code, industry) of one level of a classification, with code and name."""
    return classes.where((F.col("level") == level) & F.col("index_code").isNotNull() & F.col("industry").isNotNull()).select("index_code", "industry")


def industry_map(classes: DataFrame, members: DataFrame, level: str = "L2") -> DataFrame:
    """(instrument, industry, n): the industry of each current member; n counts the industries that claim it, so n > 1 is a defect."""
    pairs = of_level(classes, level).join(current_members(members), "index_code").select("instrument", "industry").distinct()
    return pairs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("instrument")))


def one_industry_each(mapped: DataFrame) -> DataFrame:
    """(instrument, industry) of industry_map(); the job that reads it fails on a name that several industries claim."""
    told = F.raise_error(F.concat(F.lit("claimed by several industries: "), F.col("instrument"))).cast("string")
    return mapped.select("instrument", F.when(F.col("n") > 1, told).otherwise(F.col("industry")).alias("industry"))


def build_registry(delisted: DataFrame, reasons: DataFrame, overrides: DataFrame) -> DataFrame:
    """(instrument, delist_date, reason, defect): vendor reasons mapped, overrides (instrument, delist_date, reason) applied.
    defect: 'no date', or 'unknown override' for one whose instrument is not listed; else NULL."""
    named = delisted.join(reasons, "code", "left").select("instrument", "delist_date", F.coalesce("reason", F.lit("other")).alias("reason"))
    over = overrides.select("instrument", F.col("delist_date").alias("_d"), F.col("reason").alias("_r"), F.lit(True).alias("_o"))
    both = named.withColumn("_n", F.lit(True)).join(over, "instrument", "full")
    day = F.coalesce("_d", "delist_date")
    defect = F.when(F.col("_n").isNull(), "unknown override").when(day.isNull(), "no date")
    return both.select("instrument", day.alias("delist_date"), F.coalesce("_r", "reason").alias("reason"), defect.alias("defect"))


def membership(snapshots: DataFrame) -> DataFrame:
    """(index_code, instrument, start, end, covered_to): runs of membership of every index at once, open-ended in the last
    snapshot, which covered_to names. snapshots: (index_code, instrument, datetime)."""
    days = snapshots.select("index_code", "datetime").distinct()
    by_index = Window.partitionBy("index_code")
    days = days.withColumn("i", F.row_number().over(by_index.orderBy("datetime"))).withColumn("covered_to", F.max("datetime").over(by_index))
    placed = snapshots.distinct().join(days, ["index_code", "datetime"])
    run = F.col("i") - F.row_number().over(Window.partitionBy("index_code", "instrument").orderBy("datetime"))
    runs = placed.withColumn("_run", run).groupBy("index_code", "instrument", "_run").agg(F.min("datetime").alias("start"), F.max("datetime").alias("_e"), F.max("covered_to").alias("covered_to"))
    return runs.select("index_code", "instrument", "start", F.when(F.col("_e") == F.col("covered_to"), F.to_date(F.lit("2099-12-31"))).otherwise(F.col("_e")).alias("end"), "covered_to")


def on_calendar(series: DataFrame, days: DataFrame) -> DataFrame:
    """A row for each calendar day from the series' first in-calendar day to its last; NULL where it has none, days outside the calendar go."""
    inside = series.join(days.select("datetime"), "datetime", "left_semi")
    edge = inside.agg(F.min("datetime").alias("_a"), F.max("datetime").alias("_b"))
    return days.select("datetime").join(edge, F.col("datetime").between(F.col("_a"), F.col("_b"))).drop("_a", "_b").join(inside, "datetime", "left")


def benchmark_bars(rows: DataFrame, days: DataFrame) -> DataFrame:
    """(datetime, open, high, low, close) on the calendar: other prices filled from the close. A null close or a day found twice is an error."""
    n = F.count(F.lit(1)).over(Window.partitionBy("datetime"))
    close = F.when(n > 1, F.raise_error(F.concat(F.lit("day found twice: "), F.col("datetime").cast("string"))).cast("double")).when(F.col("close").isNull(), F.raise_error(F.lit("null close")).cast("double")).otherwise(F.col("close"))
    checked = rows.withColumn("close", close)
    return on_calendar(checked.select("datetime", *[F.coalesce(F.col(c), F.col("close")).alias(c) for c in ("open", "high", "low")], "close"), days)


def value_defects(series: DataFrame) -> DataFrame:
    """One row: how many closes are null or not a number, and how many are zero or less."""
    bad = F.col("close").isNull() | F.isnan("close")
    return series.agg(F.count_if(bad).alias("n_missing"), F.count_if(~bad & (F.col("close") <= 0)).alias("n_not_positive"))


def return_deficit(price: DataFrame, total: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: shared days, the largest lead of the price index over the total-return index since the first, and its verdict."""
    both = price.select("datetime", F.col("close").alias("p")).join(total.select("datetime", F.col("close").alias("t")), "datetime")
    sums = both.agg(F.count(F.lit(1)).alias("n"), F.min_by("p", "datetime").alias("p0"), F.min_by("t", "datetime").alias("t0"), F.min(F.least("p", "t")).alias("least"), F.count_if(F.col("p").isNull() | F.col("t").isNull() | F.isnan("p") | F.isnan("t")).alias("bad"))
    worst = both.join(F.broadcast(sums), how="cross").agg(F.max(F.col("p") / F.col("p0") - F.col("t") / F.col("t0")).alias("worst"))
    out = sums.join(worst, how="cross")
    skipped = (F.col("n") < 2) | (F.col("bad") > 0) | (F.col("least") <= 0)
    return out.select("n", F.when(~skipped, F.col("worst")).alias("worst"), F.when(skipped, "skipped").when(F.col("worst") > tolerance, "below price").otherwise("ok").alias("verdict"))


def snapshot_date(rows: DataFrame, column: str = "snapshot_date") -> DataFrame:
    """One row: the only date that all rows carry as yyyyMMdd, NULL unless there is exactly one, valid and without gaps."""
    day = F.try_to_timestamp(F.col(column).cast("string"), F.lit("yyyyMMdd")).cast("date")
    sums = rows.agg(F.count_distinct(column).alias("n"), F.count_if(F.col(column).isNull()).alias("gaps"), F.max(day).alias("day"))
    return sums.select("n", "gaps", F.when((F.col("n") == 1) & (F.col("gaps") == 0), F.col("day")).alias("snapshot_date"))


def artifact_state(rows: DataFrame, days: DataFrame, start: str, end: str) -> DataFrame:
    """One row: distinct dates, trading days of the range, their ratio (1 at most), days from the last date to the range's end."""
    lo, hi = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    own = rows.where(F.col("datetime").between(lo, hi)).agg(F.count_distinct("datetime").alias("n_dates"), F.max("datetime").alias("_last"))
    due = days.where(F.col("datetime").between(lo, hi)).agg(F.count(F.lit(1)).alias("n_days"))
    return own.join(due, how="cross").select("n_dates", "n_days", F.least(F.lit(1.0), F.try_divide(F.col("n_dates"), F.col("n_days"))).alias("coverage"), F.date_diff(hi, "_last").alias("stale_days"))


def extended(ends: DataFrame, days: DataFrame, n: int) -> DataFrame:
    """ends (datetime, ...) with `extended`: the nth trading day after, or 3 n calendar days where the calendar is too short."""
    base = F.max(F.when(F.col("_own"), F.col("_idx"))).over(Window.orderBy("datetime").rangeBetween(Window.unboundedPreceding, 0))
    # Days and asked ends in one small ordered list: an end's place is the last trading day up to it.
    asked = ends.select("datetime").distinct().select("datetime", F.lit(None).cast("int").alias("_idx"), F.lit(False).alias("_own"))
    marked = days.select("datetime", F.col("idx").cast("int").alias("_idx"), F.lit(True).alias("_own")).union(asked).withColumn("_at", F.coalesce(base, F.lit(-1))).where("not _own")
    later = marked.join(days.select(F.col("idx").alias("_i"), F.col("datetime").alias("_d")), F.col("_at") + n == F.col("_i"), "left").select("datetime", F.coalesce("_d", F.date_add("datetime", 3 * n)).alias("extended"))
    return ends.join(later, "datetime")


def scope_days(stamps: DataFrame, days: DataFrame, lag: int) -> DataFrame:
    """Days on which signals of the given days are traded: lag places on in the calendar; those beyond its end go."""
    at = stamps.select("datetime").distinct().join(days, "datetime").select((F.col("idx") + lag).alias("_i"))
    return at.join(days, at["_i"] == days["idx"]).select("datetime")


def panel_subset(long: DataFrame, scores: DataFrame, benchmarks: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(datetime, instrument, fields) of the instruments that have scores, and of the benchmarks."""
    wanted = scores.select("instrument").union(long.where(F.col("instrument").isin(*benchmarks)).select("instrument")).distinct()
    return long.join(wanted, "instrument", "left_semi").select("datetime", "instrument", *fields)


def delistings_in_folds(registry: DataFrame, folds: DataFrame, members: DataFrame, lookback: int) -> DataFrame:
    """(fold, instrument, delist_date) of names that a fold holds and that delist in it or up to lookback days before.
    folds: (fold, start, end); members: (fold, instrument)."""
    near = members.join(folds, "fold").join(registry, "instrument")
    return near.where(F.col("delist_date").between(F.date_sub("start", lookback), F.col("end"))).select("fold", "instrument", "delist_date").distinct()


def shortfalls(last_days: DataFrame, expected: DataFrame, ratio: float, least: int) -> DataFrame:
    """(year, n_short, n_names, systemic): names whose last day of a year lies before the expected one; systemic from both a share and a number on.
    last_days: (year, instrument, last); expected: (year, end)."""
    sums = last_days.join(expected, "year").groupBy("year").agg(F.count_if(F.col("last") < F.col("end")).alias("n_short"), F.count(F.lit(1)).alias("n_names"))
    return sums.withColumn("systemic", (F.col("n_short") >= least) & (F.col("n_short") > F.col("n_names") * ratio))


def merged_holes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Manifests (key, hole, attempts, first, last) of two runs in one: the new run's hole counts where it has the key, attempts add, coverage widens."""
    n = new.select("key", *[F.col(c).alias(f"_{c}") for c in ("hole", "attempts", "first", "last")], F.lit(True).alias("_new"))
    both = old.join(n, "key", "full")
    return both.select("key", F.when(F.col("_new"), F.col("_hole")).otherwise(F.col("hole")).alias("hole"), (F.coalesce("attempts", F.lit(0)) + F.coalesce("_attempts", F.lit(0))).alias("attempts"), F.least("first", "_first").alias("first"), F.greatest("last", "_last").alias("last"))


def flattened(df: DataFrame) -> DataFrame:
    """Leaves of nested structs as columns of dotted names."""
    def leaves(schema, path: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        for f in schema.fields:
            here = (*path, f.name)
            out += leaves(f.dataType, here) if hasattr(f.dataType, "fields") else [F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here))]
        return out

    return df.select(*leaves(df.schema, ()))
