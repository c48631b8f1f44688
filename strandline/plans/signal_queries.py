"""Queries over factors, signals and trading days, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import factors as f
from strandline.operators import evaluation, panel, schedule, signal
from strandline.plans import testviews as v
from strandline.plans.queries import registry, spans
from strandline.plans.registry import query

FACTORS = """+ wide as (select datetime, instrument, -(close / lag(close, 4) over wi - 1) as reversal, volume, case when abs(close) > 1e-12 then (high - low) / close end as spread,
  lead(close, 2) over wi / lead(close, 1) over wi - 1 as ret from dense window wi as (partition by instrument order by datetime)),
fac as (select datetime, instrument, unnest(['reversal', 'volume', 'spread']) as factor, unnest([reversal, volume, spread]) as value, ret from wide)"""

IC = """, rk as (select factor, datetime, rank() over (partition by factor, datetime order by value) + (count(*) over (partition by factor, datetime, value) - 1) / 2.0 as x, rank() over (partition by factor, datetime order by ret) + (count(*) over (partition by factor, datetime, ret) - 1) / 2.0 as y from fac where value is not null and ret is not null),
daily as (select factor, datetime, case when count(*) >= 3 and var_pop(x) > 1e-9 and var_pop(y) > 1e-9 then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end as ic from rk group by all)"""


def columns() -> dict:
    return {"reversal": -f.ts_pctchange(F.col("close"), 4), "volume": F.col("volume"), "spread": f.div_safe(F.col("high") - F.col("low"), F.col("close"))}


def long_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.unpivoted(v.dense(spark, sf_dir), columns())


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.dense(spark, sf_dir).select("datetime", "instrument", signal.forward_return(F.col("close"), 1).alias("ret"))


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})


@query("factor_ic_table", FACTORS + IC + " select factor, count(ic) as days, round(avg(ic), 6) as mean_ic, round(stddev_samp(ic), 6) as std_ic, round(avg(ic) / stddev_samp(ic), 6) as ir, round(avg(case when ic > 1e-12 then 1.0 else 0.0 end), 6) as positive from daily where ic is not null group by factor")
def factor_ic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.ic_table(long_factors(spark, sf_dir), returns(spark, sf_dir)), "mean_ic", "std_ic", "ir", "positive")


@query("floor_ic", FACTORS + IC.replace("count(*) >= 3 and", "count(*) >= 39 and").replace("select factor, datetime, case", "select factor, datetime, count(*) as n, case") + " select factor, count(ic) as days, count(*) filter (n < 39) as dropped, count(*) filter (n >= 39 and ic is null) as flat, round(avg(ic), 6) as mean_ic from daily group by factor")
def floor_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = long_factors(spark, sf_dir).withColumnRenamed("value", "score").join(returns(spark, sf_dir), ["datetime", "instrument"])
    return rounded(evaluation.floor_ic(joined, "factor", least=39), "mean_ic")


@query("factor_t_summary", FACTORS + IC + " select factor, count(ic) as n, round(avg(ic), 6) as mean, round(stddev_samp(ic), 6) as std, round(avg(ic) / stddev_samp(ic), 6) as ir, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 6) as t from daily group by factor")
def factor_t_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = long_factors(spark, sf_dir).withColumnRenamed("value", "score").join(returns(spark, sf_dir), ["datetime", "instrument"])
    return rounded(evaluation.t_summary(signal.daily_ic(joined, "factor", "datetime"), "factor"), "mean", "std", "ir", "t")


@query("factor_correlation", FACTORS + """, p as (select 'reversal' as a, 'volume' as b, reversal as x, volume as y from wide union all select 'reversal', 'spread', reversal, spread from wide union all select 'volume', 'spread', volume, spread from wide),
r as (select a, b, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2.0 as x, rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2.0 as y from p where x is not null and y is not null)
select a, b, count(*) as n, round(corr(x, y), 4) as corr from r group by a, b""")
def factor_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = v.dense(spark, sf_dir).select("datetime", "instrument", *[c.cast("double").alias(n) for n, c in columns().items()])
    return rounded(evaluation.factor_correlation(wide, ("reversal", "volume", "spread")), "corr", places=4)


@query("factor_quality", FACTORS + """, ch as (select *, abs(value - lag(value) over (partition by factor, instrument order by datetime)) as c from fac),
d as (select factor, datetime, count(*) as cells, count(value) as n, sum(c) as c, count(c) as cn, count(*) filter (where value is not null and ret is not null) as joint, stddev_samp(value) as sd, count(*) filter (where abs(value) > 10) as far from ch group by all)
select factor, round(sum(n) / sum(cells), 6) as coverage, round(sum(c) / sum(cn), 6) as mean_abs_change, min(joint) as min_joint, round(avg(case when sd > 1e-12 then 1.0 else 0.0 end), 6) as varying_days, round(sum(far) / sum(n), 6) as outliers,
sum(n) / sum(cells) >= 0.8 and avg(case when sd > 1e-12 then 1.0 else 0.0 end) >= 0.7 and sum(far) / sum(n) <= 0.05 as valid from d group by factor""")
def factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.factor_quality(long_factors(spark, sf_dir), returns(spark, sf_dir)), "coverage", "mean_abs_change", "varying_days", "outliers")


@query("forward_return_cache", """select datetime, instrument, lag, round(ret + 1e-9, 6) as ret from (select datetime, instrument, unnest([1, 5, 10]) as lag, unnest([lead(close, 1) over wi / close - 1, lead(close, 5) over wi / close - 1, lead(close, 10) over wi / close - 1]) as ret from dense window wi as (partition by instrument order by datetime)) where ret is not null""")
def forward_return_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.returns_by_lag(v.dense(spark, sf_dir), (1, 5, 10)).where("ret is not null").withColumn("ret", F.round(F.col("ret") + 1e-9, 6))


BUCKETS = """, q as (select *, row_number() over (partition by datetime order by reversal, instrument) as r, count(*) over (partition by datetime) as m from wide where reversal is not null{also}),
b as (select *, cast(case when m > 1 then greatest(((r - 1) * 5 + m - 2) // (m - 1) - 1, 0) else 0 end as int) as bucket from q)"""


@query("signal_buckets", FACTORS + BUCKETS.format(also="") + " select datetime, instrument, bucket from b")
def signal_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.dense(spark, sf_dir).select("datetime", "instrument", columns()["reversal"].alias("score")).where("score is not null")
    return evaluation.buckets(rows, "score", 5).select("datetime", "instrument", "bucket")


@query("bucket_returns", FACTORS + BUCKETS.format(also=" and ret is not null") + " select bucket, count(*) as n, round(avg(ret), 6) as mean_ret from b group by bucket")
def bucket_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.dense(spark, sf_dir).select("datetime", "instrument", columns()["reversal"].alias("score"), signal.forward_return(F.col("close"), 1).alias("ret"))
    return rounded(evaluation.bucket_returns(rows, 5), "mean_ret")


@query("rank_in_bucket", FACTORS + BUCKETS.format(also="") + " select datetime, instrument, bucket, round((rank() over (partition by datetime, bucket order by volume) + (count(*) over (partition by datetime, bucket, volume) - 1) / 2.0) / (count(*) over (partition by datetime, bucket) + 1), 6) as rank from b where volume is not null")
def rank_in_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.dense(spark, sf_dir).select("datetime", "instrument", "volume", columns()["reversal"].alias("score"))
    out = evaluation.rank_in_bucket(evaluation.buckets(rows, "score", 5), "volume")
    return rounded(out.select("datetime", "instrument", "bucket", "rank"), "rank")


TIED = "+ p as (select datetime, instrument, floor(score * 8) as score from predictions)"


@query("tied_scores", TIED + """, r as (select *, row_number() over (partition by datetime order by score desc) as rn from p), c as (select *, min(case when rn <= 10 then score end) over (partition by datetime) as cut from r),
g as (select datetime, count(*) as n, count(distinct score) as u, count(*) filter (where score > cut) as above, count(*) filter (where score = cut) as level from c group by datetime)
select datetime, n, u as n_unique, round(1 - u / n, 6) as tie_density, case when n > 10 and above + level > 10 then level else 0 end as n_tied_at_cutoff, case when n > 10 and above + level > 10 then 10 - above else 0 end as tie_filled_slots from g""")
def tied_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rough = v.predictions(spark, sf_dir).withColumn("score", F.floor(F.col("score") * 8).cast("double"))
    return rounded(evaluation.tied_scores(rough, 10), "tie_density")


WHY = """+ reg as (select distinct instrument from bars where cast(substr(instrument, 2) as int) % 7 = 0),
why as (select datetime, instrument, case when volume < 1 or close is null then 1 when high = low then 2 end as o from bars),
rs as (select p.datetime, p.instrument, p.score, coalesce(w.o, case when r.instrument is not null then 3 end) as o from predictions p left join why w on w.datetime = p.datetime and w.instrument = p.instrument left join reg r on r.instrument = p.instrument)"""


@query("recommended", WHY + """ select datetime, instrument, round(score, 6) as score, case o when 1 then 'suspended' when 2 then 'one_price' when 3 then 'risk_name' end as reason, o is null as tradable, row_number() over (partition by datetime order by score desc, instrument) as rank,
o is null and row_number() over (partition by datetime, o is null order by score desc, instrument) <= 10 as picked from rs""")
def recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = v.predictions(spark, sf_dir)
    risky = scores.join(F.broadcast(registry(spark, sf_dir)), "instrument", "left_semi").select("datetime", "instrument", F.lit("risk_name").alias("reason"))
    out = evaluation.recommended(scores, panel.unavailable(v.bars(spark, sf_dir)).union(risky), ("suspended", "one_price", "risk_name"), 10)
    return rounded(out, "score").withColumn("rank", F.col("rank").cast("long"))


@query("blended_scores", """+ m as (select datetime, instrument, score from predictions union all select datetime, instrument, case when volume > 100 then 1.0 else 0.0 end from bars union all select datetime, instrument, case when high > low then (close - low) / (high - low) end from bars)
select datetime, instrument, round(avg(score) + 1e-9, 6) as score, count(score) as n from m group by all""")
def blended_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.bars(spark, sf_dir)
    place = F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low")))
    members = v.predictions(spark, sf_dir).union(b.select("datetime", "instrument", F.when(F.col("volume") > 100, 1.0).otherwise(0.0))).union(b.select("datetime", "instrument", place))
    return evaluation.blended(members).withColumn("score", F.round(F.col("score") + 1e-9, 6))


@query("thinned_signals", "select p.datetime, p.instrument, round(p.score, 6) as score from predictions p join cal c on c.datetime = p.datetime where c.idx >= 1 and (c.idx - 1) % 4 = 0 and c.idx < (select max(idx) from cal)")
def thinned_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = schedule.every_nth(panel.calendar(v.bars(spark, sf_dir)), 4, 1)
    return rounded(schedule.thinned(v.predictions(spark, sf_dir), kept), "score")


def ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return panel.calendar(t.select(F.to_date("l_shipdate").alias("datetime")).where("datetime is not null"))


SHIP = "+ sd as (select datetime, row_number() over (order by datetime) - 1 as idx from (select distinct cast(l_shipdate as date) as datetime from lineitem))"


@query("iso_week_days", SHIP + ", w as (select min(datetime) as datetime from sd group by isoyear(datetime), week(datetime)) select datetime from w where datetime < (select max(datetime) from sd)")
def iso_week_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.first_of_weeks(ship_days(spark, sf_dir))


@query("rebalance_stamps", SHIP + """, l as (select *, lead(datetime) over (order by datetime) as execution from sd), s as (select datetime as signal, execution, coalesce(lead(execution) over (order by datetime), (select max(datetime) from sd)) as horizon_end from l where idx >= 2 and (idx - 2) % 5 = 0 and execution is not null)
select * from s where horizon_end > execution""")
def rebalance_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.stamps(ship_days(spark, sf_dir), 5, 2)


@query("lagged_signals", "+ d as (select datetime, lead(datetime, 2) over (order by datetime) as t from (select distinct datetime from predictions)) select d.t as datetime, p.instrument, round(p.score, 6) as score from predictions p join d on d.datetime = p.datetime where d.t is not null")
def lagged_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(schedule.lagged(v.predictions(spark, sf_dir), 2), "score")


@query("pretrade_signals", """+ kept as (select p.* from predictions p join cal c on c.datetime = p.datetime where c.idx % 2 = 0 and c.idx < (select max(idx) from cal)),
d as (select datetime, lead(datetime) over (order by datetime) as t from (select distinct datetime from kept)), lg as (select d.t as datetime, k.instrument, k.score from kept k join d on d.datetime = k.datetime where d.t is not null),
bad as (select b.datetime, b.instrument from dense b where b.volume is null or b.volume < 1 or b.close is null or b.high = b.low), back as (select c.datetime, bad.instrument from bad join cal e on e.datetime = bad.datetime join cal c on c.idx = e.idx - 1)
select l.datetime, l.instrument, round(l.score, 6) as score from lg l where not exists (select 1 from back where back.datetime = l.datetime and back.instrument = l.instrument)""")
def pretrade_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinned to every second day, lagged one signal day, without names that the execution day's mask blocks."""
    dense = v.dense(spark, sf_dir)
    calendar = panel.calendar(v.bars(spark, sf_dir))
    signals = schedule.lagged(schedule.thinned(v.predictions(spark, sf_dir), schedule.every_nth(calendar, 2)), 1)
    mask = schedule.moved_days(panel.unavailable(dense), calendar, -1)
    return rounded(signals.join(mask, ["datetime", "instrument"], "left_anti").select("datetime", "instrument", "score"), "score")


@query("rolling_windows", SHIP + """, n as (select count(*) as n from sd), s as (select idx, idx // 60 as fold from sd, n where idx % 60 = 0 and idx + 500 + 60 + 60 < n)
select fold, (select datetime from sd d where d.idx = s.idx) as train_start, (select datetime from sd d where d.idx = s.idx + 497) as train_end, (select datetime from sd d where d.idx = s.idx + 500) as valid_start, (select datetime from sd d where d.idx = s.idx + 557) as valid_end,
(select datetime from sd d where d.idx = s.idx + 560) as test_start, (select datetime from sd d where d.idx = s.idx + 619) as test_end from s""")
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.rolling_windows(ship_days(spark, sf_dir), 500, 60, 60, 60, 2)


WINDOWS = "+ w as (select row_number() over (order by q) as id, q as start, q + 100 as \"end\" from (select distinct cast(date_trunc('quarter', datetime) as date) as q from bars))"


@query("window_overlaps", WINDOWS + """, b as (select *, max("end") over (order by start rows between unbounded preceding and 1 preceding) as e from w)
select id, start, "end", cast(coalesce(greatest(start - e - 1, 0), 0) as int) as gap_days, cast(coalesce(least(greatest(e + 1 - start, 0), "end" - start + 1), 0) as int) as overlap_days from b""")
def window_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = panel.calendar(v.bars(spark, sf_dir).select(F.trunc("datetime", "quarter").alias("datetime")))
    return schedule.window_overlaps(starts.select((F.col("idx") + 1).cast("long").alias("id"), F.col("datetime").alias("start"), F.date_add("datetime", 100).alias("end")))


@query("membership_days", """+ snap as (select distinct concat('I', lpad(cast(l_suppkey % 40 as varchar), 2, '0')) as instrument, cast(date_trunc('week', l_shipdate) as date) as datetime from lineitem where l_returnflag = 'R' and l_suppkey % 40 < 25),
sd as (select datetime, row_number() over (order by datetime) as i from (select distinct datetime from snap)), g as (select s.instrument, s.datetime, i, i - row_number() over (partition by s.instrument order by s.datetime) as run from snap s join sd on sd.datetime = s.datetime),
spans as (select instrument, min(datetime) as start, case when max(i) = (select max(i) from sd) then date '2099-12-31' else max(datetime) end as "end" from g group by instrument, run)
select s.instrument, s.start, s."end", count(c.datetime) as n_days from spans s left join cal c on c.datetime between s.start and s."end" group by all""")
def membership_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.days_between(panel.calendar(v.bars(spark, sf_dir)), "start", "end", spans(spark, sf_dir)).select("instrument", "start", "end", "n_days")
