"""Files of the panel world, read and written by Spark: calendars, spans, fold reports, journals, positions, panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.factors import by_time
from strandline.operators.panel import aligned, calendar

SPAN = "instrument string, start date, end date"
DAY_VALUES = "map<string,double>"
FOLD = f"schema_version string, fold_index int, daily_series struct<excess_return: {DAY_VALUES}, components: struct<return: {DAY_VALUES}, bench: {DAY_VALUES}, cost: {DAY_VALUES}>, ic: map<string,{DAY_VALUES}>>"
JOURNAL = "trade_date string, code string, action string, decided_at timestamp, nonce string, _bad string"


def refuse(bad: DataFrame, why: str) -> None:
    """Raises where bad has a row; one row is fetched at most."""
    if (found := bad.limit(1).collect()):
        raise ValueError(f"{why}: {found[0].asDict()}")


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """(datetime, idx) from one ISO day a line; blank lines and repeats go, a line that is no day refuses."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''").distinct()
    days = lines.select("line", F.try_to_timestamp("line", F.lit("yyyy-MM-dd")).cast("date").alias("datetime"))
    refuse(days.where("datetime is null"), "not a day")
    return calendar(days)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """(instrument, start, end) from three tab-separated columns; a span that ends before it starts refuses."""
    spans = spark.read.csv(path, sep="\t", schema=SPAN)
    refuse(spans.where("start is null or end is null or start > end"), "not a span")
    return spans


def write_spans(spans: DataFrame, path: str) -> None:
    """Sorted by instrument and start, through a range shuffle, so the parts follow one another."""
    spans.select("instrument", "start", "end").orderBy("instrument", "start").write.csv(path, sep="\t", mode="overwrite")


def read_fold_reports(spark: SparkSession, path: str) -> DataFrame:
    """(fold, datetime, excess, gross, ic) of fold reports, a JSON document a file; a day in two folds refuses."""
    folds = spark.read.json(path, schema=FOLD, multiLine=True)
    value = F.explode("daily_series.excess_return").alias("day", "excess")
    rows = folds.select(F.col("fold_index").alias("fold"), value, F.col("daily_series.components.return").alias("r"), F.element_at("daily_series.ic", "1").alias("i")).where("excess is not null")
    out = rows.select("fold", F.to_date("day").alias("datetime"), "excess", F.element_at("r", F.col("day")).alias("gross"), F.element_at("i", F.col("day")).alias("ic"))
    refuse(out.groupBy("datetime").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "a day in two folds")
    return out


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal lines with the column _bad, which holds a malformed line; such lines are kept, to be counted."""
    return spark.read.json(path, schema=JOURNAL, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(datetime, instrument, weight) from documents {day: {instrument: weight}}, one a file."""
    text = spark.read.text(path, wholetext=True)
    days = text.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("day", "names"))
    return days.select(F.to_date("day").alias("datetime"), F.explode("names").alias("instrument", "weight")).where("weight is not null")


def write_positions(positions: DataFrame, path: str) -> None:
    """A document {day: {instrument: weight}} a line, a day each."""
    names = F.map_from_entries(F.array_sort(F.collect_list(F.struct("instrument", "weight"))))
    positions.groupBy("datetime").agg(names.alias("names")).select(F.to_json(F.create_map(F.col("datetime").cast("string"), F.col("names"))).alias("value")).write.text(path)


def read_wide(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """Long rows of a wide Parquet table: datetime and a column an instrument; empty cells go."""
    wide = spark.read.parquet(path)
    return wide.unpivot("datetime", [c for c in wide.columns if c != "datetime"], "instrument", value).where(F.col(value).isNotNull())


def read_industries(spark: SparkSession, path: str) -> DataFrame:
    """(instrument, industry) from CSV with a header in any case; a blank field or a repeated instrument refuses."""
    raw = spark.read.csv(path, header=True)
    names = {c.strip().lower(): c for c in raw.columns}
    out = raw.select(*[F.trim(raw[names[c]]).alias(c) for c in ("instrument", "industry")])
    refuse(out.where("coalesce(instrument, '') = '' or coalesce(industry, '') = ''"), "a blank field")
    refuse(out.groupBy("instrument").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "a repeated instrument")
    return out


def write_panel(panel: DataFrame, path: str) -> None:
    """Parquet by year, rows of a year dealt by instrument and sorted, so scans prune years and skip row groups."""
    rows = panel.withColumn("year", F.year("datetime"))
    rows.repartition("year", F.pmod(F.xxhash64("instrument"), F.lit(32))).sortWithinPartitions("year", "instrument", "datetime").write.partitionBy("year").parquet(path, mode="overwrite")


def write_aligned(panel: DataFrame, days: DataFrame, path: str, fields: Sequence[str] = ("open", "high", "low", "close", "volume", "money")) -> None:
    """The panel aligned to the calendar from each name's first day, every field a FLOAT, missing ones NULL; files as write_panel's."""
    write_panel(aligned(panel, days, fields).select("datetime", "instrument", "start_index", *[F.col(c).cast("float") for c in fields]), path)


def random_panel(spark: SparkSession, instruments: int, days: int, seed: int) -> DataFrame:
    """A log-normal walk a name: (datetime, instrument, close, volume), made where it is read; a row a weekday."""
    cells = spark.range(instruments * days).select(F.floor(F.col("id") / days).alias("i"), (F.col("id") % days).cast("int").alias("t"))
    day = F.date_add(F.to_date(F.lit("2015-01-05")), (F.floor(F.col("t") / 5) * 7 + F.col("t") % 5).cast("int"))
    rows = cells.select(day.alias("datetime"), F.format_string("T%04d", "i").alias("instrument"), (F.randn(seed) * 0.02).alias("step"), F.floor(F.exp(F.randn(seed + 1)) * 1000).cast("double").alias("volume"))
    return rows.select("datetime", "instrument", (F.exp(F.sum("step").over(by_time())) * 10).alias("close"), "volume")
