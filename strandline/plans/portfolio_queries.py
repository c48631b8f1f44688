"""Queries over positions and runs, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators import compare, panel, portfolio, signal
from strandline.plans import testviews as v
from strandline.plans.registry import off_ties, query
from strandline.plans.signal_queries import rounded
from strandline.sources.shared import kept_table, new_path

POS = """+ ind as (select concat('I', lpad(cast(s_suppkey % 40 as varchar), 2, '0')) as instrument, min(r_name) as grp from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by 1),
pos as (select t.datetime, t.instrument, i.grp, case when cast(substr(t.instrument, 2) as int) % 2 = 0 then 0.05::double else 0.1::double end as weight from (select * from (select *, row_number() over (partition by datetime order by score desc, instrument) as rank from predictions) where rank <= 10) t join ind i on i.instrument = t.instrument)"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation", "region"))
    named = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return named.groupBy(F.concat(F.lit("I"), F.lpad((F.col("s_suppkey") % 40).cast("string"), 2, "0")).alias("instrument")).agg(F.min("r_name").alias("group"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = signal.top_names(v.predictions(spark, sf_dir), 10).select("datetime", "instrument")
    half = F.substring("instrument", 2, 2).cast("int") % 2 == 0
    return top.join(groups(spark, sf_dir), "instrument").select("datetime", "instrument", "group", F.when(half, 0.05).otherwise(0.1).alias("weight"))


LIMITS = dict(per_name=0.08, per_group=0.335, cash=0.352, leverage=0.56)


@query("limit_violations", POS + """ select datetime, 'per_name' as rule, instrument as what, round(weight, 6) as actual, 0.08::double as "limit" from pos where weight > 0.08
union all select datetime, 'per_group', grp, round(sum(weight), 6), 0.335::double from pos group by datetime, grp having sum(weight) > 0.335
union all select datetime, 'cash', 'cash', round(1 - sum(weight), 6), 0.352::double from pos group by datetime having 1 - sum(weight) < 0.352
union all select datetime, 'leverage', 'portfolio', round(sum(abs(weight)), 6), 0.56::double from pos group by datetime having sum(abs(weight)) > 0.56""")
def limit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.violations(positions(spark, sf_dir), "group", **LIMITS), "actual")


@query("clipped_positions", POS + """, a as (select *, least(weight, 0.08::double) as w from pos), g as (select *, sum(w) over (partition by datetime, grp) as s from a), b as (select datetime, instrument, w * case when s > 0.335 then 0.335 / s else 1 end as w from g),
t as (select *, sum(w) over (partition by datetime) as s from b), c as (select datetime, instrument, w * case when 1 - s < 0.352 and s > 0 then (1 - 0.352) / s else 1 end as w from t), u as (select *, sum(abs(w)) over (partition by datetime) as s from c)
select datetime, instrument, round(w * case when s > 0.56 then 0.56 / s else 1 end, 6) as weight from u""")
def clipped_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.clipped(positions(spark, sf_dir), "group", **LIMITS).select("datetime", "instrument", "weight"), "weight")


@query("group_turnover", POS + """, d as (select datetime, lag(datetime) over (order by datetime) as b from (select distinct datetime from pos)),
m as (select p.datetime, p.instrument, p.grp, p.weight as w from pos p union all select d.datetime, p.instrument, p.grp, -p.weight from pos p join d on d.b = p.datetime),
n as (select datetime, grp, instrument, sum(w) as w from m group by all) select n.datetime, n.grp as "group", round(sum(abs(w)) / 2, 6) as turnover from n join d on d.datetime = n.datetime where d.b is not null group by 1, 2""")
def group_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.group_turnover(positions(spark, sf_dir), "group"), "turnover")


@query("concentration", POS + """, d as (select datetime, count(*) as n, sum(weight) as s, max(weight) as m, sum(weight * weight) as h from pos group by datetime)
select count(*) as days, round(median(n), 6) as median_n, min(n) as min_n, round(median(s / s), 6) as median_top10, round(max(m), 6) as max_weight, round(median(h), 6) as median_hhi from d""")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.concentration(positions(spark, sf_dir)), "median_n", "median_top10", "max_weight", "median_hhi")


@query("average_weights", POS + " select instrument, round(sum(weight) / (select sum(weight) from pos), 6) as weight from pos group by instrument")
def average_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.average_weights(positions(spark, sf_dir)), "weight")


@query("implied_weights", "+ m as (select instrument, greatest(avg(score), 0) as w from predictions group by instrument) select instrument, round(w / (select sum(w) from m), 6) as weight from m")
def implied_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.implied_weights(v.predictions(spark, sf_dir)), "weight")


@query("period_returns", "select instrument, round(arg_max(close, datetime) / arg_min(close, datetime) - 1 + 1e-9, 6) as ret from bars group by instrument having count(*) >= 2")
def period_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.period_returns(v.bars(spark, sf_dir)).withColumn("ret", off_ties(F.col("ret")))


BENCH = """, lev as (select cast(date_trunc('week', o_orderdate) as date) as datetime, avg(o_totalprice) as level from orders group by 1), bench as (select datetime, level / lag(level) over (order by datetime) - 1 as ret from lev)"""


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly returns of the mean order price."""
    level = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("datetime")).agg(F.avg("o_totalprice").alias("level"))
    return level.select("datetime", (F.try_divide("level", F.lag("level").over(Window.orderBy("datetime"))) - 1).alias("ret"))


@query("attribution", POS + BENCH + """, w as (select instrument, sum(weight) / (select sum(weight) from pos) as p from pos group by instrument), bw as (select instrument, 1.0::double / (select count(distinct instrument) from bars) as b from bars group by instrument),
r as (select instrument, arg_max(close, datetime) / arg_min(close, datetime) - 1 as ret from bars group by instrument having count(*) >= 2),
s as (select i.grp, coalesce(sum(w.p), 0) as wp, coalesce(sum(bw.b), 0) as wb, coalesce(sum(w.p * r.ret), 0) as sp, coalesce(sum(bw.b * r.ret), 0) as sb from ind i left join w on w.instrument = i.instrument left join bw on bw.instrument = i.instrument left join r on r.instrument = i.instrument group by i.grp),
x as (select grp, wp, wb, case when wp > 1e-9 then sp / wp else 0 end as rp, case when wb > 1e-9 then sb / wb else 0 end as rb, (select product(1 + ret) - 1 from bench where ret is not null) as t from s)
select grp as "group", round(wp, 4) as w_p, round(wb, 4) as w_b, round(rp, 4) as r_p, round(rb, 4) as r_b, round((wp - wb) * (rb - t), 6) as allocation, round(wb * (rp - rb), 6) as selection, round((wp - wb) * (rp - rb), 6) as interaction, round((wp - wb) * (rb - t) + wb * (rp - rb) + (wp - wb) * (rp - rb), 6) as total from x""")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = v.bars(spark, sf_dir).select("instrument").distinct()
    equal = names.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy()))
    total = bench(spark, sf_dir).where("ret is not null").agg((F.product(1 + F.col("ret")) - 1).alias("total"))
    out = portfolio.attribution(groups(spark, sf_dir), portfolio.average_weights(positions(spark, sf_dir)), equal, portfolio.period_returns(v.bars(spark, sf_dir)), total)
    return rounded(rounded(out, "w_p", "w_b", "r_p", "r_b", places=4), "allocation", "selection", "interaction", "total")


RUNS = """ rets as (select datetime, instrument, lead(close, 2) over wi / lead(close, 1) over wi - 1 as ret from dense window wi as (partition by instrument order by datetime)),
ra as (select p.datetime, avg(m.ret) / 100 as ret from (select * from (select *, row_number() over (partition by datetime order by score desc, instrument) as k from predictions) where k <= 5) p join rets m on m.datetime = p.datetime and m.instrument = p.instrument group by p.datetime),
rb as (select p.datetime, avg(m.ret) / 100 as ret from (select * from (select *, row_number() over (partition by datetime order by -score desc, instrument) as k from predictions) where k <= 5) p join rets m on m.datetime = p.datetime and m.instrument = p.instrument group by p.datetime)"""
DIFF = RUNS + ", df as (select a.datetime, row_number() over (order by a.datetime) - 1 as idx, a.ret - b.ret as x from ra a join rb b on b.datetime = a.datetime where a.ret is not null and b.ret is not null)"


def run_returns(spark: SparkSession, sf_dir: str, sign: int, bars: DataFrame | None = None) -> DataFrame:
    bars = v.bars(spark, sf_dir) if bars is None else bars
    scores = v.scored(bars).withColumn("score", sign * F.col("score"))
    return signal.equal_weight_returns(scores, panel.densify(bars, panel.calendar(bars)), 5).select("datetime", (F.col("ret") / 100).alias("ret"))


def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = kept_table(v.bars(spark, sf_dir), new_path(spark, "difference"))
    return compare.paired(run_returns(spark, sf_dir, 1, bars), run_returns(spark, sf_dir, -1, bars))


@query("monthly_returns", "+" + RUNS + BENCH + """, a as (select cast(date_trunc('month', datetime) as date) as month, product(1 + ret) - 1 as ret from ra where ret is not null group by 1), b as (select cast(date_trunc('month', datetime) as date) as month, product(1 + ret) - 1 as bench from bench where ret is not null group by 1)
select a.month, round(a.ret, 6) as ret, round(b.bench, 6) as bench from a left join b on b.month = a.month""")
def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.monthly(run_returns(spark, sf_dir, 1), bench(spark, sf_dir)), "ret", "bench")


@query("paired_difference", "+" + DIFF + " select datetime, idx, round(x, 8) as x from df")
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(difference(spark, sf_dir), "x", places=8).withColumn("idx", F.col("idx").cast("long"))


@query("annual_ir", "+" + DIFF + " select count(x) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std, round(case when stddev_samp(x) > 1e-15 then avg(x) / stddev_samp(x) * sqrt(252) end, 6) as ir from df")
def annual_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.annual_ir(difference(spark, sf_dir)), "mean", "std", "ir")


BLOCK = DIFF + """, ct as (select idx, x - (select avg(x) from df) as x, (select count(*) from df) as n from df), ss as (select max(n) as n, sum(x * x) as ss from ct),
ac as (select l.lag, sum(a.x * b.x) as p from (select unnest(range(1, 40)) as lag) l join ct a on l.lag < a.n // 2 join ct b on b.idx = a.idx + l.lag group by l.lag),
bl as (select n, cast(case when n < 8 or ss = 0 then 1 else coalesce((select min(lag) from ac where abs(p / nullif(ss.ss, 0)) < 2 / sqrt(n)), least(n // 2, 40)) end as int) as block from ss)"""


@query("block_length", "+" + BLOCK + " select n, block from bl")
def block_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.block_length(difference(spark, sf_dir))


@query("block_bootstrap", "+" + BLOCK + """, dr as (select b, pos, n, block, cast(concat('0x', substr(md5(concat('7:', cast(b as varchar), ':', cast(pos // block as varchar))), 1, 8)) as ubigint) as start from bl, (select unnest(range(0, 500)) as b), (select unnest(range(0, (select n from bl))) as pos)),
ms as (select dr.b, avg(df.x) * 252 as m from dr join df on df.idx = (dr.start + dr.pos % dr.block) % dr.n group by dr.b)
select n, block, round((select avg(x) * 252 from df), 6) as point, round((select stddev_pop(m) from ms), 6) as se, round((select quantile_cont(m, 0.025) from ms), 6) as lo, round((select quantile_cont(m, 0.975) from ms), 6) as hi,
case when (select quantile_cont(m, 0.025) from ms) > 0 then 'a' when (select quantile_cont(m, 0.975) from ms) < 0 then 'b' else 'undecided' end as verdict from bl""")
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = difference(spark, sf_dir)
    return rounded(compare.verdict(compare.block_bootstrap(diff, compare.block_length(diff), 500, 7)), "point", "se", "lo", "hi")
