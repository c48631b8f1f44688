"""Queries over folds, schedules, sessions and reviews, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import compare, folds, panel, schedule
from strandline.plans import testviews as v
from strandline.plans.portfolio_queries import BENCH, DIFF, bench, difference
from strandline.plans.registry import query
from strandline.plans.signal_queries import SHIP, rounded, ship_days

YEARS = "+ z as (select 1)" + BENCH + """, f as (select year(datetime) as fold, min(datetime) as test_start, max(datetime) as test_end, product(1 + ret) - 1 as total, count(*) as n from bench where ret is not null group by 1),
yr as (select *, case when total > -1 and fold <> 1999 then pow(1 + total, 52.0 / n) - 1 end as annual from f)"""


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold for each year of the benchmark; that of 1999 has no yearly rate."""
    out = bench(spark, sf_dir).where("ret is not null").groupBy(F.year("datetime").alias("fold")).agg(F.min("datetime").alias("test_start"), F.max("datetime").alias("test_end"), (F.product(1 + F.col("ret")) - 1).alias("total"), F.count("ret").alias("n"))
    return out.withColumn("annual", F.when(F.col("fold") != 1999, folds.annualised(F.col("total"), F.col("n"), 52)))


@query("stitched_nav", YEARS + " select fold, test_start, test_end, round(annual, 6) as annual, round(exp(sum(ln(1 + annual) * (test_end - test_start) / 365) over (order by fold)), 6) as nav from yr where annual > -1 and test_end > test_start")
def stitched_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.stitched(years(spark, sf_dir)).select("fold", "test_start", "test_end", "annual", "nav"), "annual", "nav")


@query("fold_metrics", YEARS + " select 'total' as metric, round(avg(total), 6) as mean, round(stddev_pop(total), 6) as std, round(min(total), 6) as least, round(max(total), 6) as most, round(sum(total), 6) as total, count(total) as valid from yr union all select 'annual', round(avg(annual), 6), round(stddev_pop(annual), 6), round(min(annual), 6), round(max(annual), 6), round(sum(annual), 6), count(annual) from yr")
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.fold_metrics(years(spark, sf_dir), "total", "annual"), "mean", "std", "least", "most", "total")


@query("metric_differences", YEARS + """, r as (select cast(fold as varchar) as metric, case when fold = 1997 then 0.0::double else total end as baseline, annual as candidate from yr)
select metric, round(baseline, 6) as baseline, round(candidate, 6) as candidate, round(candidate - baseline, 6) as delta, case when candidate is null then 'candidate' end as missing, round(case when baseline <> 0 then (candidate - baseline) / abs(baseline) end, 4) as relative from r""")
def metric_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, name = years(spark, sf_dir), F.col("fold").cast("string").alias("metric")
    out = folds.differences(y.select(name, F.when(F.col("fold") == 1997, 0.0).otherwise(F.col("total")).alias("value")), y.where("fold <> 1999").select(name, F.col("annual").alias("value")))
    return rounded(rounded(out, "baseline", "candidate", "delta"), "relative", places=4)


@query("better_counts", YEARS + """, r as (select cast(fold as varchar) as metric, case when fold = 1997 then 0.0::double else total end as b, case when fold <> 1999 then annual end as c from yr)
select count(*) filter (c > b) as candidate_better, count(*) filter (c < b) as baseline_better, count(*) filter (c is null) as unavailable, max(case when metric = '1998' then c >= 1.1 * b end) as ratio_met from r""")
def better_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, name = years(spark, sf_dir), F.col("fold").cast("string").alias("metric")
    out = folds.differences(y.select(name, F.when(F.col("fold") == 1997, 0.0).otherwise(F.col("total")).alias("value")), y.where("fold <> 1999").select(name, F.col("annual").alias("value")))
    return folds.better_counts(out, "1998")


@query("mean_rate", "+ w as (select datetime, case when datetime < date '1997-03-01' then 20.0 when datetime < date '1999-09-15' then 10.0 else 5.0 end as r from cal where datetime between date '1996-01-01' and date '2000-12-31') select count(*) as days, round(avg(r), 6)::double as rate, count(distinct r) - 1 as changes from w")
def mean_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.sql("select * from values (date'1995-01-01', 20.0D), (date'1997-03-01', 10.0D), (date'1999-09-15', 5.0D) as t(start, rate)")
    return rounded(folds.mean_rate(steps, panel.calendar(v.bars(spark, sf_dir)), "1996-01-01", "2000-12-31"), "rate")


@query("first_session", "+ d as (select distinct cast(o_orderdate as date) as d from orders) select min(d) filter (where dayofweek(d) between 1 and 5 and d >= date '1998-08-01') as session, min(d) <= date '1998-08-01' as covered from d")
def first_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("day")).distinct()
    return folds.first_session(d.withColumn("is_open", F.dayofweek("day").between(2, 6).cast("int")), "1998-08-01")


@query("next_rebalance", SHIP + ", w as (select min(datetime) as datetime from sd group by isoyear(datetime), week(datetime)), k as (select datetime from w where datetime < (select max(datetime) from sd)) select d.d, (select min(k.datetime) from k where k.datetime >= d.d) as due from (select distinct cast(o_orderdate as date) as d from orders) d")
def next_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("d")).distinct()
    return folds.next_of(dates, schedule.first_of_weeks(ship_days(spark, sf_dir)))


@query("review_progress", "+ c as (select distinct cast(ts as date) as day, user_id from events), j as (select distinct cast(ts as date) as day, user_id, 1 as done from events where event_id % 3 = 0) select c.day, count(*) as candidates, count(j.done) as reviewed, count(*) - count(j.done) as missing from c left join j on j.day = c.day and j.user_id = c.user_id group by 1")
def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("day"), "user_id", "event_id")
    return folds.review_progress(t, t.where("event_id % 3 = 0"), "day", "user_id")


@query("iid_bootstrap", "+" + DIFF + """, nn as (select count(*) as n from df), dr as (select b, n, cast(concat('0x', substr(md5(concat('7:', cast(b as varchar), ':', cast(pos as varchar))), 1, 8)) as ubigint) as start from nn, (select unnest(range(0, 200)) as b), (select unnest(range(0, (select n from nn))) as pos)),
ms as (select dr.b, avg(df.x) as m from dr join df on df.idx = dr.start % dr.n group by dr.b) select n, 1 as block, round((select avg(x) from df), 8) as point, round((select stddev_pop(m) from ms), 8) as se, round((select quantile_cont(m, 0.025) from ms), 8) as lo, round((select quantile_cont(m, 0.975) from ms), 8) as hi from nn""")
def iid_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = difference(spark, sf_dir)
    single = diff.agg(F.count("x").alias("n"), F.lit(1).alias("block"))
    return rounded(compare.block_bootstrap(diff, single, 200, 7, 1.0), "point", "se", "lo", "hi", places=8)
