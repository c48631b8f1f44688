"""Queries over a panel whose names grow with the data, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import factors as f
from strandline.operators import correlations, mined, signal
from strandline.plans import testviews as v
from strandline.plans.registry import off_ties, query

#: Rolling windows of the factors, and the most weeks that a factor needs.
ROWS = (2, 3, 4, 5, 6, 8, 10, 15)


def over(n: int) -> str:
    return f"(partition by instrument order by datetime rows between {n - 1} preceding and current row)"


def full(column: str, sql: str, n: int) -> str:
    return f"case when count({column}) over {over(n)} = {n} then {sql}({column}) over {over(n)} end"


RANK_IC = f"""+ {v.MANY.strip()}, r as (select datetime, instrument, -(close / lag(close, 2) over w - 1) as score, lead(close, 2) over w / lead(close, 1) over w - 1 as ret from many window w as (partition by instrument order by datetime)),
k as (select datetime, rank() over (partition by datetime order by score) + (count(*) over (partition by datetime, score) - 1) / 2.0 as x, rank() over (partition by datetime order by ret) + (count(*) over (partition by datetime, ret) - 1) / 2.0 as y from r where score is not null and ret is not null)
select datetime, count(*) as n, round(case when count(*) >= 3 and var_pop(x) > 1e-9 and var_pop(y) > 1e-9 then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end, 6) as ic from k group by datetime"""


@query("many_rank_ic", RANK_IC)
def many_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.many(spark, sf_dir).select("datetime", "instrument", (-f.ts_pctchange(F.col("close"), 2)).alias("score"), signal.forward_return(F.col("close"), 1).alias("ret"))
    return signal.daily_ic(rows, "datetime").select("datetime", "n", F.round("ic", 6).alias("ic"))


Z = ("cs_zscore", ("ts_mean", ("div_safe", ("sub", "high", "low"), "close"), 4))
STEADY = ("ts_std", ("ts_mean", "close", 3), 4)


@query("many_mined_features", f"""+ {v.MANY.strip()}, a as (select *, case when abs(close) > 1e-12 then (high - low) / close end as spread, {full("close", "avg", 3)} as m3 from many), b as (select *, {full("spread", "avg", 4)} as s4, {full("m3", "stddev_samp", 4)} as d4 from a)
select datetime, instrument, round(case when s4 is not null then case when stddev_samp(s4) over d > 1e-12 then (s4 - avg(s4) over d) / stddev_samp(s4) over d else 0.0 end end + 1e-9, 6) as z, round(d4 + 1e-9, 6) as steady from b window d as (partition by datetime)""")
def many_mined_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mined.evaluated(v.many(spark, sf_dir), {"z": Z, "steady": STEADY})
    return out.withColumns({c: off_ties(F.col(c)) for c in ("z", "steady")})


FACTORS = {f"{name}_{n}": (name, x, n) for n in ROWS for name, x in (("ts_mean", "close"), ("ts_std", "close"), ("ts_delta", "close"), ("ts_sum", "volume"), ("ts_pctchange", "volume"))}


def sql_of(name: str, x: str, n: int) -> str:
    back = f"lag({x}, {n}) over (partition by instrument order by datetime)"
    return {
        "ts_mean": full(x, "avg", n), "ts_std": full(x, "stddev_samp", n), "ts_sum": full(x, "sum", n), "ts_delta": f"{x} - {back}", "ts_pctchange": f"case when abs({back}) > 1e-12 then {x} / {back} end - 1"
    }[name]


@query("many_factor_correlations", f"""+ {v.MANY.strip()}, wd as (select datetime, instrument, {", ".join(f"{sql_of(*e)} as {n}" for n, e in FACTORS.items())} from many),
lg as (select datetime, instrument, unnest([{", ".join(str(i) for i in range(len(FACTORS)))}]) as k, unnest([{", ".join(f"'{n}'" for n in FACTORS)}]) as f, unnest([{", ".join(FACTORS)}]) as x from wd)
select a.f as a, b.f as b, count(*) as n, round(case when count(*) >= 3 then corr(a.x, b.x) end, 4) as corr from lg a join lg b on a.datetime = b.datetime and a.instrument = b.instrument and a.k < b.k where a.x is not null and b.x is not null group by 1, 2""")
def many_factor_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty factors of every supplier's weeks, most with many missing cells."""
    wide = mined.evaluated(v.many(spark, sf_dir), FACTORS)
    return correlations.pearson(wide, list(FACTORS)).withColumn("corr", F.round("corr", 4))
