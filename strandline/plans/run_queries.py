"""Queries over compared runs, limits in a scope, explicit weights and residuals of sources, each with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import codes
from strandline.operators import compare, panel, portfolio, signal, statements
from strandline.plans import testviews as v
from strandline.plans.portfolio_queries import LIMITS, POS, RUNS, positions, run_returns
from strandline.plans.registry import query
from strandline.plans.served_queries import SOURCES
from strandline.plans.signal_queries import rounded
from strandline.plans.statement_queries import ST, days, raw
from strandline.sources.shared import kept_table, new_path

#: Runs of the five best and the five worst scores, a day in nine of the second missing, with rank coefficients and quarters' first weeks as seams.
ARMS = "+" + RUNS + """, rk as (select p.datetime, rank() over (partition by p.datetime order by p.score) + (count(*) over (partition by p.datetime, p.score) - 1) / 2.0 as x, rank() over (partition by p.datetime order by m.ret) + (count(*) over (partition by p.datetime, m.ret) - 1) / 2.0 as y from predictions p join rets m on m.datetime = p.datetime and m.instrument = p.instrument where m.ret is not null),
ic as (select datetime, case when count(*) >= 3 and var_pop(x) > 1e-9 and var_pop(y) > 1e-9 then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end as ic from rk group by datetime),
a as (select ra.datetime, ra.ret as excess, ra.ret * 2 as gross, ic.ic, day(ra.datetime) <= 7 and month(ra.datetime) % 3 = 1 as boundary from ra left join ic on ic.datetime = ra.datetime where ra.ret is not null),
b as (select rb.datetime, rb.ret as excess, rb.ret * 3 as gross, -ic.ic as ic, day(rb.datetime) <= 7 and month(rb.datetime) % 3 = 1 as boundary from rb left join ic on ic.datetime = rb.datetime where rb.ret is not null and day(rb.datetime) % 9 <> 4),
j as (select a.datetime, b.excess - a.excess as x, a.gross as ga, b.gross as gb, a.ic as ia, b.ic as ib from a join b on b.datetime = a.datetime)"""


def boot(series: str, name: str, scale: str) -> str:
    """SQL of block length and interval of a series (idx, x)."""
    return f""", {name}c as (select idx, x - (select avg(x) from {series}) as x, (select count(*) from {series}) as n from {series}), {name}s as (select max(n) as n, sum(x * x) as ss from {name}c),
{name}a as (select l.lag, sum(a.x * b.x) as p from (select unnest(range(1, 40)) as lag) l join {name}c a on l.lag < a.n // 2 join {name}c b on b.idx = a.idx + l.lag group by l.lag),
{name}b as (select n, cast(case when n < 8 or ss = 0 then 1 else coalesce((select min(lag) from {name}a where abs(p / nullif({name}s.ss, 0)) < 2 / sqrt(n)), least(n // 2, 40)) end as int) as block from {name}s),
{name}d as (select b, pos, n, block, cast(concat('0x', substr(md5(concat('7:', cast(b as varchar), ':', cast(pos // block as varchar))), 1, 8)) as ubigint) as start from {name}b, (select unnest(range(0, 1000)) as b), (select unnest(range(0, (select n from {name}b))) as pos)),
{name}m as (select d.b, avg(s.x) * {scale} as m from {name}d d join {series} s on s.idx = (d.start + d.pos % d.block) % d.n group by d.b),
{name} as (select (select block from {name}b) as block, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi, stddev_pop(m) as se from {name}m)"""


IR = "case when stddev_samp({0}) > 1e-15 then avg({0}) / stddev_samp({0}) * sqrt(252) end"
COMPARED = ARMS + ", nt as (select row_number() over (order by datetime) - 1 as idx, x from j), it as (select row_number() over (order by datetime) - 1 as idx, ib - ia as x from j where ia is not null and ib is not null)" + boot("nt", "net", "252") + boot("it", "coef", "1") + f""",
sa as (select {IR.format("excess")} as i, {IR.format("case when not boundary then excess end")} as e from a), sb as (select {IR.format("excess")} as i, {IR.format("case when not boundary then excess end")} as e from b),
r as (select (select count(*) from a) as n_a, (select count(*) from b) as n_b, (select count(*) from j) as n_shared, net.block, net.lo, net.hi, (select avg(x) * 252 from j) as point, (select {IR.format("ga")} from j) as ga, (select {IR.format("gb")} from j) as gb, (select count(*) from it) as n_ic,
  case when coef.lo > 0 then 'treatment' when coef.hi < 0 then 'baseline' else 'indistinguishable' end as ic_verdict, coef.lo as ic_lo, coef.hi as ic_hi, case when net.lo > 0 then 'treatment_better' when net.hi < 0 then 'treatment_worse' else 'indistinguishable' end as verdict, (select e - i from sa) as seam_a, (select e - i from sb) as seam_b from net, coef)
select n_a, n_b, n_shared, round(n_shared / least(n_a, n_b), 6) as overlap, block, round(point, 6) as point, round(lo, 6) as lo, round(hi, 6) as hi, verdict, round(ga, 6) as gross_ir_a, round(gb, 6) as gross_ir_b, n_ic, round(ic_lo, 6) as ic_lo, round(ic_hi, 6) as ic_hi, ic_verdict,
(ic_verdict = 'baseline' and verdict <> 'treatment_worse') or (ic_verdict = 'treatment' and verdict <> 'treatment_better') as contradiction, round(seam_a, 6) as seam_a, round(seam_b, 6) as seam_b from r"""


@query("compared_runs", COMPARED)
def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both runs and their coefficients come from the same bars, which are written once: they are far smaller than the rows they come from.
    path = new_path(spark, "runs")
    bars = kept_table(v.bars(spark, sf_dir), f"{path}/bars")
    moved = panel.densify(bars, panel.calendar(bars)).select("datetime", "instrument", signal.forward_return(F.col("close"), 1).alias("ret"))
    daily = kept_table(signal.daily_ic(moved.join(v.scored(bars), ["datetime", "instrument"]), "datetime").select("datetime", "ic"), f"{path}/daily")
    seam = (F.dayofmonth("datetime") <= 7) & (F.month("datetime") % 3 == 1)

    def run(sign: int, times: int) -> DataFrame:
        r = run_returns(spark, sf_dir, sign, bars).where("ret is not null").join(daily, "datetime", "left")
        return r.select("datetime", F.col("ret").alias("excess"), (F.col("ret") * times).alias("gross"), (F.col("ic") * sign).alias("ic"), seam.alias("boundary"))

    out = compare.compared_runs(run(1, 2), run(-1, 3).where("dayofmonth(datetime) % 9 <> 4"), 1000, 7)
    return rounded(out.drop("se", "mean_ic_a", "mean_ic_b"), "overlap", "point", "lo", "hi", "gross_ir_a", "gross_ir_b", "ic_lo", "ic_hi", "seam_a", "seam_b")


@query("held_within_limits", POS + """, sc as (select distinct datetime from pos where month(datetime) % 2 = 0), a as (select p.*, least(weight, 0.08::double) as w from pos p join sc using (datetime)), g as (select *, sum(w) over (partition by datetime, grp) as s from a), b as (select datetime, instrument, w * case when s > 0.335 then 0.335 / s else 1 end as w from g),
t as (select *, sum(w) over (partition by datetime) as s from b), c as (select datetime, instrument, w * case when 1 - s < 0.352 and s > 0 then (1 - 0.352) / s else 1 end as w from t), u as (select *, sum(abs(w)) over (partition by datetime) as s from c)
select datetime, instrument, round(w * case when s > 0.56 then 0.56 / s else 1 end, 6) as weight from u union all select datetime, instrument, round(weight, 6) from pos where month(datetime) % 2 = 1""")
def held_within_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped in even months alone."""
    p = positions(spark, sf_dir)
    out = portfolio.held_within(p, "group", LIMITS, p.where("month(datetime) % 2 = 0").select("datetime"))
    return rounded(out.select("datetime", "instrument", "weight"), "weight")


@query("given_weights", "+ n as (select distinct instrument from bars where cast(substr(instrument, 2) as int) % 3 <> 1), w as (select instrument, sum(volume) as weight from bars where cast(substr(instrument, 2) as int) % 4 <> 2 group by 1), j as (select n.instrument, coalesce(w.weight, 0) as weight from n left join w on w.instrument = n.instrument) select instrument, round(weight / sum(weight) over (), 9) as weight from j")
def given_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.bars(spark, sf_dir).withColumn("k", F.substring("instrument", 2, 2).cast("int"))
    out = portfolio.given_weights(b.where("k % 4 <> 2").groupBy("instrument").agg(F.sum("volume").alias("weight")), b.where("k % 3 <> 1").select("instrument"))
    return rounded(out, "weight", places=9)


SOURCED = ST.replace("select o_custkey % 40 as code", "select case o_orderkey % 3 when 0 then 'income' when 1 then 'balance' else 'cash' end as source, o_custkey % 40 as code").replace("partition by code,", "partition by source, code,")


@query("source_residuals", SOURCED + """, w as (select * from ver where not (source = 'cash' and code % 5 = 2)), p as (select source, code, period, max(case when update_flag = 0 then revenue end) as r0, max(case when update_flag = 1 then revenue end) as r1, max(case when update_flag = 0 then announced end) as a0, max(case when update_flag = 1 then announced end) as a1, count(distinct update_flag) as k from w group by all),
u as (select unnest(range(0, 45)) as code)
select source, 'revenue' as field, count(*) filter (k = 2) as compared, count(*) filter (k = 2 and r0 is distinct from r1) as differing, 45 - count(distinct code) as without_file from p group by source
union all select source, 'announced', count(*) filter (k = 2), count(*) filter (k = 2 and a0 is distinct from a1), 45 - count(distinct code) from p group by source""")
def source_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    filings = raw(spark, sf_dir).withColumn("_k", F.substring("batch", -9, 9).cast("long") % 3)
    known = days(spark, sf_dir)
    parts = [statements.version_record(statements.contract(filings.where(F.col("_k") == i).drop("_k"), known)).withColumn("source", F.lit(s)) for i, s in enumerate(SOURCES)]
    versions = reduce(DataFrame.unionByName, parts).where("not (source = 'cash' and code % 5 = 2)")
    return statements.residuals(versions, spark.range(45).withColumnRenamed("id", "code"), "revenue", "announced")


@query("statement_contract_frame", ST + """, h as (select *, sha256(concat('period=', cast(period as varchar), chr(31), 'revenue=', cast(o as varchar))) as h from (select *, cast(cast(revenue * 100 as bigint) as varchar) as o from st)),
o as (select code, period, arg_max(h, batch) as h from h where update_flag = 0 group by 1, 2)
select st.code, st.period, st.update_flag, st.batch, st.announced, st.available_from, case when st.update_flag = 1 then o.h end as original_hash from st left join o on o.code = st.code and o.period = st.period""")
def statement_contract_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir)
    whole = rows.withColumn("revenue", F.round(F.col("revenue") * 100).cast("long"))
    out = statements.contract_frame(whole, days(spark, sf_dir), codes.content_hash("period", "revenue"))
    return out.select("code", "period", "update_flag", "batch", "announced", "available_from", "original_hash")
