"""The panel views over the test tables, for Spark and as the same text for SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import panel

ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")

SQL = f"""
li as (select concat('I', lpad(cast(l_suppkey % 40 as varchar), 2, '0')) as instrument, cast(date_trunc('week', l_shipdate) as date) as datetime,
  l_extendedprice / l_quantity as p, l_quantity as q, l_extendedprice as e, row({", ".join(ORDER)}) as o from lineitem),
bars as (select instrument, datetime, arg_min(p, o) as open, max(p) as high, min(p) as low, arg_max(p, o) as close, sum(q) as volume, sum(e) as money from li group by all),
cal as (select datetime, cast(row_number() over (order by datetime) - 1 as int) as idx from (select distinct datetime from bars)),
dense as (select c.datetime, c.idx, i.instrument, b.open, b.high, b.low, b.close, b.volume, b.money from cal c cross join (select distinct instrument from bars) i
  left join bars b on b.datetime = c.datetime and b.instrument = i.instrument),
predictions as (select datetime, instrument, cast(cast(concat('0x', substr(md5(concat(instrument, ':', cast(datetime as varchar))), 1, 8)) as ubigint) as double) / 4294967296.0 as score from bars)
"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price, order = F.col("l_extendedprice") / F.col("l_quantity"), F.struct(*ORDER)
    day = F.to_date(F.date_trunc("week", F.col("l_shipdate")))
    instrument = F.concat(F.lit("I"), F.lpad((F.col("l_suppkey") % 40).cast("string"), 2, "0"))
    return t.groupBy(instrument.alias("instrument"), day.alias("datetime")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("money")
    )


def scored(bars: DataFrame) -> DataFrame:
    """A score for each bar."""
    score = F.conv(F.substring(F.md5(F.concat("instrument", F.lit(":"), F.col("datetime").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return bars.select("datetime", "instrument", score.alias("score"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return panel.densify(b, panel.calendar(b))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(bars(spark, sf_dir))


#: A panel whose names grow with the data: every supplier is one.
MANY = f"""
mli as (select concat('S', cast(l_suppkey as varchar)) as instrument, cast(date_trunc('week', l_shipdate) as date) as datetime, l_extendedprice / l_quantity as p, l_quantity as q, l_extendedprice as e, row({", ".join(ORDER)}) as o from lineitem),
mbars as (select instrument, datetime, max(p) as high, min(p) as low, arg_max(p, o) as close, sum(q) as volume from mli group by all),
many as (select c.datetime, i.instrument, b.high, b.low, b.close, b.volume from (select distinct datetime from mbars) c cross join (select distinct instrument from mbars) i left join mbars b on b.datetime = c.datetime and b.instrument = i.instrument)"""


def many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel of every supplier's weeks."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price, order = F.col("l_extendedprice") / F.col("l_quantity"), F.struct(*ORDER)
    rows = t.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("instrument"), F.to_date(F.date_trunc("week", F.col("l_shipdate"))).alias("datetime"))
    b = rows.agg(F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum("l_quantity").alias("volume"))
    return panel.densify(b, panel.calendar(b))
