"""Registered queries of the panel library, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import factors as f
from strandline.operators import panel, portfolio, signal
from strandline.plans import testviews as v
from strandline.plans.registry import FOUND, SQL, off_ties, query

OVER = "window w as (partition by instrument order by datetime rows between 4 preceding and current row), wi as (partition by instrument order by datetime)"


def factor(name: str, of: Callable[[Column, Column, Column], Column], sql: str, over: str = OVER) -> None:
    """A factor over the whole dense panel, rounded: (datetime, instrument, value)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return v.dense(spark, sf_dir).select("datetime", "instrument", off_ties(of(F.col("close"), F.col("volume"), F.col("money"))).alias("value"))

    FOUND[name] = run
    SQL[name] = f"with {v.SQL} select datetime, instrument, round({sql} + 1e-9, 6) as value from dense {over}"


def filled(sql: str) -> str:
    return f"case when count(close) over w = 5 then {sql} end"


factor("ts_mean", lambda close, volume, money: f.ts_mean(close, 5), filled("avg(close) over w"))
factor("ts_std", lambda close, volume, money: f.ts_std(close, 5), filled("stddev_samp(close) over w"))
factor("ts_max", lambda close, volume, money: f.ts_max(close, 5), filled("max(close) over w"))
factor("ts_min", lambda close, volume, money: f.ts_min(close, 5), filled("min(close) over w"))
factor("ts_sum", lambda close, volume, money: f.ts_sum(close, 5), filled("sum(close) over w"))
factor("ts_delta", lambda close, volume, money: f.ts_delta(close, 5), "close - lag(close, 5) over wi")
factor("ts_pctchange", lambda close, volume, money: f.ts_pctchange(close, 4), "case when abs(lag(close, 4) over wi) > 1e-12 then close / lag(close, 4) over wi end - 1")
factor("ts_rank", lambda close, volume, money: f.ts_rank(close, 5), filled("case when max(close) over w = min(close) over w then 0.5 else (len(list_filter(list(close) over w, lambda x: x <= close)) - 1) / 4.0 end"))
factor("ts_argmax", lambda close, volume, money: f.ts_argmax(close, 5), filled("cast(list_position(list(close) over w, max(close) over w) - 1 as double)"))
factor("ts_argmin", lambda close, volume, money: f.ts_argmin(close, 5), filled("cast(list_position(list(close) over w, min(close) over w) - 1 as double)"))
factor("ts_skew", lambda close, volume, money: f.ts_skew(close, 5), filled("coalesce(skewness(close) over w, 0.0)"))
factor("ts_kurt", lambda close, volume, money: f.ts_kurt(close, 5), filled("coalesce(kurtosis(close) over w, -3.0)"))
factor("ts_decay_linear", lambda close, volume, money: f.ts_decay_linear(close, 5), "(close * 5 + lag(close, 1) over wi * 4 + lag(close, 2) over wi * 3 + lag(close, 3) over wi * 2 + lag(close, 4) over wi) / 15.0")
factor("ts_corr", lambda close, volume, money: f.ts_corr(close, volume, 5), filled("case when not ((5 * sum(close * close) over w - power(sum(close) over w, 2)) <= 1e-9 * 5 * sum(close * close) over w or (5 * sum(volume * volume) over w - power(sum(volume) over w, 2)) <= 1e-9 * 5 * sum(volume * volume) over w) then (5 * sum(close * volume) over w - sum(close) over w * sum(volume) over w) / (sqrt(5 * sum(close * close) over w - power(sum(close) over w, 2)) * sqrt(5 * sum(volume * volume) over w - power(sum(volume) over w, 2))) end"))
factor("cs_rank", lambda close, volume, money: f.cs_rank(volume), "case when volume is not null then (rank() over (partition by datetime, volume is null order by volume) + (count(volume) over (partition by datetime, volume) - 1) / 2.0) / count(volume) over (partition by datetime) - 0.5 end", "")
factor("cs_zscore", lambda close, volume, money: f.cs_zscore(close), "case when close is not null then case when stddev_samp(close) over d > 1e-12 then (close - avg(close) over d) / stddev_samp(close) over d else 0.0 end end", "window d as (partition by datetime)")
factor("cs_demean", lambda close, volume, money: f.cs_demean(close), "close - avg(close) over (partition by datetime)", "")
factor("cs_winsorize", lambda close, volume, money: f.cs_winsorize(close), "case when close is not null then least(greatest(close, quantile_cont(close, 0.05) over d), quantile_cont(close, 0.95) over d) end", "window d as (partition by datetime)")
factor("scalar_div_safe", lambda close, volume, money: f.div_safe(money, volume - 20), "case when abs(volume - 20) > 1e-12 then money / (volume - 20) end", "")
factor("scalar_log_safe", lambda close, volume, money: f.log_safe(volume - 20), "case when volume > 20 then ln(volume - 20) end", "")
factor("scalar_sqrt_safe", lambda close, volume, money: f.sqrt_safe(volume - 20), "case when volume >= 20 then sqrt(volume - 20) end", "")
factor("scalar_where", lambda close, volume, money: f.where(volume - 60, F.col("high"), F.col("low")), "case when volume > 60 then high when volume <= 60 then low end", "")
factor("scalar_sign_abs", lambda close, volume, money: F.signum(volume - 60) * F.abs(volume - 60) + F.coalesce(close, F.lit(0.0)), "sign(volume - 60) * abs(volume - 60) + coalesce(close, 0.0)", "")
factor("forward_return", lambda close, volume, money: signal.forward_return(close, 5), "lead(close, 6) over wi / lead(close, 1) over wi - 1")


@query("dense_panel", "select datetime, idx, instrument, round(open + 1e-9, 6) as open, round(high + 1e-9, 6) as high, round(low + 1e-9, 6) as low, round(close + 1e-9, 6) as close, volume, round(money, 2) as money from dense")
def dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.dense(spark, sf_dir).select("datetime", "idx", "instrument", *[off_ties(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "volume", F.round("money", 2).alias("money"))


#: Rank IC of a four-bar reversal.
IC = """+ rows as (select datetime, instrument, -(close / lag(close, 4) over wi - 1) as score, lead(close, 2) over wi / lead(close, 1) over wi - 1 as ret from dense window wi as (partition by instrument order by datetime)),
ranks as (select datetime, rank() over (partition by datetime order by score) + (count(*) over (partition by datetime, score) - 1) / 2.0 as x, rank() over (partition by datetime order by ret) + (count(*) over (partition by datetime, ret) - 1) / 2.0 as y
  from rows where score is not null and ret is not null),
daily as (select datetime, count(*) as n, case when count(*) >= 3 and var_pop(x) > 1e-9 and var_pop(y) > 1e-9 then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end as ic from ranks group by datetime)
"""


def reversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.dense(spark, sf_dir).select("datetime", "instrument", (-f.ts_pctchange(F.col("close"), 4)).alias("score"), signal.forward_return(F.col("close"), 1).alias("ret"))


@query("daily_rank_ic", IC + "select datetime, n, round(ic, 6) as ic from daily")
def daily_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.daily_ic(reversal(spark, sf_dir), "datetime").select("datetime", "n", F.round("ic", 6).alias("ic"))


@query("rank_ic_summary", IC + "select count(ic) as days, round(avg(ic), 6) as mean_ic, round(stddev_samp(ic), 6) as std_ic, round(avg(ic) / stddev_samp(ic), 6) as ir, round(avg(case when ic > 1e-12 then 1.0 else 0.0 end), 6) as positive from daily where ic is not null")
def rank_ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.ic_summary(signal.daily_ic(reversal(spark, sf_dir), "datetime"))
    return out.select("days", *[F.round(c, 6).alias(c) for c in ("mean_ic", "std_ic", "ir", "positive")])


@query("ic_decay", """+ r as (select datetime, instrument, unnest([1, 2, 3, 4, 5]) as lag, unnest([lead(close, 1) over wi / close - 1, lead(close, 2) over wi / close - 1, lead(close, 3) over wi / close - 1, lead(close, 4) over wi / close - 1, lead(close, 5) over wi / close - 1]) as ret from dense window wi as (partition by instrument order by datetime)),
j as (select r.lag, r.datetime, rank() over (partition by r.lag, r.datetime order by p.score) + (count(*) over (partition by r.lag, r.datetime, p.score) - 1) / 2.0 as x, rank() over (partition by r.lag, r.datetime order by r.ret) + (count(*) over (partition by r.lag, r.datetime, r.ret) - 1) / 2.0 as y from r join predictions p on p.datetime = r.datetime and p.instrument = r.instrument where r.ret is not null),
daily as (select lag, datetime, case when count(*) >= 3 and var_pop(x) > 1e-9 and var_pop(y) > 1e-9 then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end as ic from j group by all)
select lag, count(ic) as days, round(avg(ic), 6) as mean_ic from daily where ic is not null group by lag""")
def ic_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = signal.returns_by_lag(v.dense(spark, sf_dir), (1, 2, 3, 4, 5))
    daily = signal.daily_ic(moved.join(v.predictions(spark, sf_dir), ["datetime", "instrument"]), "lag", "datetime")
    return signal.ic_summary(daily, "lag").select("lag", "days", F.round("mean_ic", 6).alias("mean_ic"))


TOP = "+ top as (select * from (select *, row_number() over (partition by datetime order by score desc, instrument) as rank from predictions) where rank <= 10)"


@query("top_names", TOP + " select datetime, instrument, round(score, 6) as score, rank from top")
def top_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.top_names(v.predictions(spark, sf_dir), 10).select("datetime", "instrument", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("signal_analysis", TOP + """, r as (select datetime, instrument, unnest([1, 2, 3]) as lag, unnest([lead(close, 1+1) over wi / lead(close, 1) over wi - 1, lead(close, 2+1) over wi / lead(close, 1) over wi - 1, lead(close, 3+1) over wi / lead(close, 1) over wi - 1]) as ret from dense window wi as (partition by instrument order by datetime)),
j as (select r.lag, r.datetime, rank() over (partition by r.lag, r.datetime order by p.score) + (count(*) over (partition by r.lag, r.datetime, p.score) - 1) / 2.0 as x, rank() over (partition by r.lag, r.datetime order by r.ret) + (count(*) over (partition by r.lag, r.datetime, r.ret) - 1) / 2.0 as y from r join predictions p on p.datetime = r.datetime and p.instrument = r.instrument where r.ret is not null),
daily as (select lag, datetime, case when count(*) >= 3 and var_pop(x) > 1e-9 and var_pop(y) > 1e-9 then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end as ic from j group by all),
d as (select datetime, lag(datetime) over (order by datetime) as b from (select distinct datetime from top)),
t as (select t.datetime, avg(case when o.instrument is null then 1.0 else 0.0 end) as turnover from top t join d on d.datetime = t.datetime left join top o on o.datetime = d.b and o.instrument = t.instrument where d.b is not null group by t.datetime)
select lag, count(ic) as days, case when count(ic) >= 10 then round(avg(ic), 6) end as mean_ic, case when count(ic) >= 10 then round(stddev_samp(ic), 6) end as std_ic, case when count(ic) >= 10 then round(avg(ic) / stddev_samp(ic), 6) end as ir, case when count(ic) >= 10 then round(avg(case when ic > 1e-12 then 1.0 else 0.0 end), 6) end as positive,
(select round(avg(turnover), 6) from t) as turnover, (select round(stddev_pop(turnover), 6) from t) as turnover_std from daily where ic is not null group by lag""")
def signal_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.signal_analysis(v.predictions(spark, sf_dir), v.dense(spark, sf_dir), 10, (1, 2, 3))
    return out.select("lag", "days", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("lag", "days")])


@query("short_signal_analysis", """+ few as (select * from predictions where datetime in (select datetime from cal where idx % 40 = 3)), r as (select datetime, instrument, unnest([1, 20]) as lag, unnest([lead(close, 2) over wi / lead(close, 1) over wi - 1, lead(close, 21) over wi / lead(close, 1) over wi - 1]) as ret from dense window wi as (partition by instrument order by datetime)),
j as (select r.lag, r.datetime, rank() over (partition by r.lag, r.datetime order by p.score) + (count(*) over (partition by r.lag, r.datetime, p.score) - 1) / 2.0 as x, rank() over (partition by r.lag, r.datetime order by r.ret) + (count(*) over (partition by r.lag, r.datetime, r.ret) - 1) / 2.0 as y from r join few p on p.datetime = r.datetime and p.instrument = r.instrument where r.ret is not null),
daily as (select lag, datetime, case when count(*) >= 3 and var_pop(x) > 1e-9 and var_pop(y) > 1e-9 then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end as ic from j group by all)
select lag, count(ic) as days, cast(null as double) as mean_ic, cast(null as double) as ir from daily where ic is not null group by lag having count(ic) < 10""")
def short_signal_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal of so few days that nothing but their number is told."""
    dense = v.dense(spark, sf_dir)
    few = v.predictions(spark, sf_dir).join(F.broadcast(dense.where("idx % 40 = 3").select("datetime").distinct()), "datetime")
    return signal.signal_analysis(few, dense, 10, (1, 20)).select("lag", "days", "mean_ic", "ir")


@query("name_turnover", TOP + """, d as (select datetime, lag(datetime) over (order by datetime) as b from (select distinct datetime from top))
select t.datetime, round(avg(case when o.instrument is null then 1.0 else 0.0 end), 6) as turnover from top t join d on d.datetime = t.datetime left join top o on o.datetime = d.b and o.instrument = t.instrument where d.b is not null group by t.datetime""")
def name_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.name_turnover(v.predictions(spark, sf_dir), 10).select("datetime", F.round("turnover", 6).alias("turnover"))


@query("turnover_summary", TOP + """, d as (select datetime, lag(datetime) over (order by datetime) as b from (select distinct datetime from top)),
t as (select t.datetime, avg(case when o.instrument is null then 1.0 else 0.0 end) as turnover from top t join d on d.datetime = t.datetime left join top o on o.datetime = d.b and o.instrument = t.instrument where d.b is not null group by t.datetime)
select count(*) as days, round(avg(turnover), 6) as mean, round(stddev_pop(turnover), 6) as std from t""")
def turnover_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.turnover_summary(v.predictions(spark, sf_dir), 10).select("days", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("equal_weight_returns", TOP + """, m as (select datetime, instrument, lead(close, 2) over wi / lead(close, 1) over wi - 1 as ret from dense window wi as (partition by instrument order by datetime))
select t.datetime, round(avg(m.ret), 6) as ret, count(m.ret) as n from top t join m on m.datetime = t.datetime and m.instrument = t.instrument group by t.datetime""")
def equal_weight_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.equal_weight_returns(v.predictions(spark, sf_dir), v.dense(spark, sf_dir), 10).select("datetime", F.round("ret", 6).alias("ret"), "n")


@query("unavailable_mask", "select * from (select datetime, instrument, case when volume is null or volume < 1 or close is null then 'suspended' when high = low then 'one_price' end as reason from dense) where reason is not null")
def unavailable_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.unavailable(v.dense(spark, sf_dir))


@query("limit_blocked", "select datetime, instrument, coalesce(not (close / lag(close) over wi - 1 <= 0.1), true) as buy, coalesce(not (close / lag(close) over wi - 1 >= -0.1), true) as sell from dense window wi as (partition by instrument order by datetime)")
def limit_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    buy, sell = panel.limit_blocked(0.1)
    return v.dense(spark, sf_dir).select("datetime", "instrument", buy.alias("buy"), sell.alias("sell"))


@query("adjusted_prices", """+ a as (select *, case when (cast(substr(instrument, 2) as int) + idx) % 13 = 0 then 1 + cast(substr(instrument, 2) as int) / 100.0 end as fct from dense)
select datetime, instrument, round(close * coalesce(last_value(fct ignore nulls) over (partition by instrument order by datetime rows between unbounded preceding and current row), 1.0) + 1e-9, 6) as close from a""")
def adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.dense(spark, sf_dir)
    number = F.substring("instrument", 2, 2).cast("int")
    factors = d.where((number + F.col("idx")) % 13 == 0).select("datetime", "instrument", (1 + number / 100.0).alias("adj_factor"))
    return panel.adjusted(d, factors, ("close",)).select("datetime", "instrument", off_ties(F.col("close")).alias("close"))


REGISTRY = "+ reg as (select instrument, date '1999-06-28' + 28 * cast(substr(instrument, 2) as int) as delist_date from (select distinct instrument from bars) where cast(substr(instrument, 2) as int) % 7 = 0)"


def registry(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    number = F.substring("instrument", 2, 2).cast("int")
    return (v.bars(spark, sf_dir) if bars is None else bars).select("instrument").distinct().where(number % 7 == 0).select("instrument", F.date_add(F.to_date(F.lit("1999-06-28")), 28 * number).alias("delist_date"))


@query("post_delist_mask", REGISTRY + " select d.datetime, d.instrument, round(case when r.delist_date is null or d.datetime <= r.delist_date then d.close end + 1e-9, 6) as close from dense d left join reg r on r.instrument = d.instrument")
def post_delist_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.after_delisting(v.dense(spark, sf_dir), registry(spark, sf_dir), ("close",)).select("datetime", "instrument", off_ties(F.col("close")).alias("close"))


@query("listing_clip", REGISTRY + " select b.datetime, b.instrument, b.volume from bars b left join reg r on r.instrument = b.instrument where r.delist_date is null or b.datetime <= r.delist_date")
def listing_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.clipped_at_delisting(v.bars(spark, sf_dir), registry(spark, sf_dir)).select("datetime", "instrument", "volume")


SPANS = """+ snap as (select distinct concat('I', lpad(cast(l_suppkey % 40 as varchar), 2, '0')) as instrument, cast(date_trunc('week', l_shipdate) as date) as datetime from lineitem where l_returnflag = 'R' and l_suppkey % 40 < 25),
sd as (select datetime, row_number() over (order by datetime) as i from (select distinct datetime from snap)),
g as (select s.instrument, s.datetime, i, i - row_number() over (partition by s.instrument order by s.datetime) as run from snap s join sd on sd.datetime = s.datetime),
spans as (select instrument, min(datetime) as start, case when max(i) = (select max(i) from sd) then date '2099-12-31' else max(datetime) end as "end" from g group by instrument, run)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R' and l_suppkey % 40 < 25")
    snapshots = t.select(F.to_date(F.date_trunc("week", "l_shipdate")).alias("datetime"), F.concat(F.lit("I"), F.lpad((F.col("l_suppkey") % 40).cast("string"), 2, "0")).alias("instrument"))
    return panel.membership_runs(snapshots)


@query("membership_runs", SPANS + ' select instrument, start, "end" from spans')
def membership_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir)


@query("members_at", SPANS + ' select distinct c.datetime, s.instrument from cal c join spans s on c.datetime between s.start and s."end"')
def members_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.members_at(panel.calendar(v.bars(spark, sf_dir)), spans(spark, sf_dir))


@query("next_trading_day", "select o.o_orderkey, (select min(c.datetime) from cal c where c.datetime > o.o_orderdate) as next from orders o")
def next_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return panel.next_day(orders, panel.calendar(v.bars(spark, sf_dir))).select("o_orderkey", "next")


@query("nav_and_drawdown", TOP + """, m as (select datetime, instrument, lead(close, 2) over wi / lead(close, 1) over wi - 1 as ret from dense window wi as (partition by instrument order by datetime)),
r as (select t.datetime, avg(m.ret) as ret from top t join m on m.datetime = t.datetime and m.instrument = t.instrument group by t.datetime),
e as (select datetime, avg(ret) as ret from m where ret is not null and month(datetime) <> 7 group by datetime),
n as (select r.datetime, product(1 + r.ret / 100) over o as nav, product(1 + coalesce(e.ret, 0) / 100) over o as bench_nav from r left join e on e.datetime = r.datetime where r.ret is not null window o as (order by r.datetime rows between unbounded preceding and current row))
select datetime, round(nav, 3) as nav, round(nav / max(nav) over o - 1, 6) as drawdown, round(bench_nav, 3) as bench_nav, round(bench_nav / max(bench_nav) over o - 1, 6) as bench_drawdown from n window o as (order by datetime rows between unbounded preceding and current row)""")
def nav_and_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the best ten names, beside all names, whose return is unknown in each July."""
    dense = v.dense(spark, sf_dir)
    r = signal.equal_weight_returns(v.predictions(spark, sf_dir), dense, 10).select("datetime", (F.col("ret") / 100).alias("ret"))
    every = dense.select("datetime", "instrument", signal.forward_return(F.col("close"), 1).alias("ret")).where("ret is not null and month(datetime) <> 7").groupBy("datetime").agg((F.avg("ret") / 100).alias("ret"))
    out = portfolio.nav(r, every)
    return out.select("datetime", F.round("nav", 3).alias("nav"), F.round("drawdown", 6).alias("drawdown"), F.round("bench_nav", 3).alias("bench_nav"), F.round("bench_drawdown", 6).alias("bench_drawdown"))


@query("factor_coverage", "select datetime, round(avg(case when close is not null then 1.0 else 0.0 end), 6) as coverage, count(close) as n from dense group by datetime")
def factor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.dense(spark, sf_dir).groupBy("datetime").agg(F.round(F.avg(F.when(F.col("close").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))), 6).alias("coverage"), F.count("close").alias("n"))


@query("event_bars", "select user_id, cast(ts as date) as day, round(arg_min(value, row(ts, value)), 6) as open, round(max(value), 6) as high, round(min(value), 6) as low, round(arg_max(value, row(ts, value)), 6) as close, count(*) as n from events group by all")
def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = F.struct("ts", "value")
    return t.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.min_by("value", order), 6).alias("open"), F.round(F.max("value"), 6).alias("high"), F.round(F.min("value"), 6).alias("low"), F.round(F.max_by("value", order), 6).alias("close"), F.count(F.lit(1)).alias("n"))
