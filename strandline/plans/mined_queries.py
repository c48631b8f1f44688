"""Queries over mined factors, with SQL that spells each nested factor out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import mined
from strandline.plans import testviews as v
from strandline.plans.registry import off_ties, query

MEAN, STEP = ("ts_mean", "close", 5), ("ts_delta", "close", 1)
#: (expression, fitness), in falling order of fitness.
POOL = [
    (("cs_rank", MEAN), 0.9), (("ts_mean", STEP, 5), 0.8), (("cs_zscore", ("ts_std", ("ts_pctchange", "close", 1), 5)), 0.7), (("ts_max", ("ts_min", "close", 5), 10), 0.6),
    (("cs_rank", ("div_safe", "volume", ("ts_mean", "volume", 5))), 0.5), (("ts_sum", ("ts_max", "close", 5), 5), 0.4), (("sub", ("cs_rank", MEAN), ("cs_rank", "volume")), 0.3),
    (("neg", ("ts_delta", MEAN, 5)), 0.2), (("where", STEP, "close", MEAN), 0.1), (("cs_demean", ("ts_sum", "volume", 5)), 0.05),
]
#: Of a factor that goes back and forth between days and names.
DEEP = ("ts_mean", ("cs_zscore", ("ts_mean", ("cs_demean", "volume"), 5)), 5)

FIVE = "case when count({0}) over w = 5 then {1}({0}) over w end"
PARTS = f""", p0 as (select datetime, idx, instrument, close, volume, {FIVE.format("close", "avg")} as mean5, close - lag(close) over wi as step, case when abs(lag(close) over wi) > 1e-12 then close / lag(close) over wi end - 1 as pct,
{FIVE.format("close", "min")} as low5, {FIVE.format("close", "max")} as high5, {FIVE.format("volume", "avg")} as vol5, {FIVE.format("volume", "sum")} as volsum, lead(close, 2) over wi / lead(close, 1) over wi - 1 as label
from dense window wi as (partition by instrument order by datetime), w as (partition by instrument order by datetime rows between 4 preceding and current row)),
p1 as (select *, {FIVE.format("step", "avg")} as step5, {FIVE.format("pct", "stddev_samp")} as pctsd, case when count(low5) over t = 10 then max(low5) over t end as lowmax, {FIVE.format("high5", "sum")} as highsum, mean5 - lag(mean5, 5) over wi as meanstep, case when abs(vol5) > 1e-12 then volume / vol5 end as volratio
from p0 window wi as (partition by instrument order by datetime), w as (partition by instrument order by datetime rows between 4 preceding and current row), t as (partition by instrument order by datetime rows between 9 preceding and current row)),
p2 as (select *, {{rank_mean5}} as r_mean, {{rank_volume}} as r_vol, {{rank_volratio}} as r_ratio, case when pctsd is not null then case when stddev_samp(pctsd) over d > 1e-12 then (pctsd - avg(pctsd) over d) / stddev_samp(pctsd) over d else 0.0 end end as z, volsum - avg(volsum) over d as dm from p1 window d as (partition by datetime))"""
RANK = "case when {0} is not null then (rank() over (partition by datetime, {0} is null order by {0}) + (count({0}) over (partition by datetime, {0}) - 1) / 2.0) / count({0}) over (partition by datetime) - 0.5 end"
PARTS = PARTS.format(**{f"rank_{c}": RANK.format(c) for c in ("mean5", "volume", "volratio")}).lstrip(", ")
VALUES = ("r_mean", "step5", "z", "lowmax", "r_ratio", "highsum", "r_mean - r_vol", "-meanstep", "case when step > 0 then close when step <= 0 then mean5 end", "dm")
NAMES = [mined.column_name(x) for x, _ in POOL]


def rounded_all(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: off_ties(F.col(c)) for c in columns})


@query("mined_features", f"+ {PARTS} select datetime, instrument, {', '.join(f'round({x} + 1e-9, 6) as {n}' for x, n in zip(VALUES, NAMES, strict=True))}, round(label + 1e-9, 6) as LABEL0 from p2")
def mined_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(mined.feature_matrix(v.dense(spark, sf_dir), POOL), [*NAMES, "LABEL0"])


@query("base_with_mined", f"+ {PARTS} select b.datetime, b.instrument, b.volume, round(p.r_mean + 1e-9, 6) as {NAMES[0]}, round(p.step5 + 1e-9, 6) as {NAMES[1]} from bars b left join p2 p on p.datetime = b.datetime and p.instrument = b.instrument and p.idx % 2 = 0")
def base_with_mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.dense(spark, sf_dir)
    features = mined.feature_matrix(d, POOL[:2]).join(F.broadcast(d.where("idx % 2 = 0").select("datetime").distinct()), "datetime")
    return rounded_all(mined.with_mined(v.bars(spark, sf_dir).select("datetime", "instrument", "volume"), features), NAMES[:2])


@query("deep_mined_factor", f"""+ q0 as (select datetime, instrument, volume - avg(volume) over (partition by datetime) as x from dense),
q1 as (select *, {FIVE.format("x", "avg")} as y from q0 window w as (partition by instrument order by datetime rows between 4 preceding and current row)),
q2 as (select *, case when y is not null then case when stddev_samp(y) over d > 1e-12 then (y - avg(y) over d) / stddev_samp(y) over d else 0.0 end end as r from q1 window d as (partition by datetime)),
q3 as (select *, {FIVE.format("r", "avg")} as m from q2 window w as (partition by instrument order by datetime rows between 4 preceding and current row)) select datetime, instrument, round(m + 1e-9, 6) as m from q3""")
def deep_mined_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(mined.evaluated(v.dense(spark, sf_dir), {"m": DEEP}), ["m"])
