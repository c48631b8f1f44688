"""Queries that choose among factors, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import panel, schedule, selection, signal
from strandline.plans import testviews as v
from strandline.plans.registry import query
from strandline.plans.signal_queries import FACTORS, IC, columns, long_factors, returns, rounded

NAMES = ("reversal", "volume", "spread")


def ranked(keys: str, x: str, y: str) -> str:
    """SQL of average ranks x and y within keys."""
    return ", ".join(f"rank() over (partition by {keys} order by {c}) + (count(*) over (partition by {keys}, {c}) - 1) / 2.0 as {a}" for c, a in ((x, "x"), (y, "y")))


RANK_CORR = "case when count(*) >= 3 and var_pop(x) > 1e-9 and var_pop(y) > 1e-9 then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end"


@query("factor_ic_decay", FACTORS + f""", rl as (select datetime, instrument, unnest([1, 2, 3]) as lag, unnest([lead(close, 1) over wi / close - 1, lead(close, 2) over wi / close - 1, lead(close, 3) over wi / close - 1]) as r from dense window wi as (partition by instrument order by datetime)),
rk as (select factor, lag, datetime, {ranked("factor, lag, datetime", "value", "r")} from (select f.factor, f.datetime, f.value, l.lag, l.r from fac f join rl l on l.datetime = f.datetime and l.instrument = f.instrument where f.value is not null and l.r is not null)),
daily as (select factor, lag, datetime, {RANK_CORR} as ic from rk group by all) select factor, lag, count(ic) as days, round(avg(ic), 6) as mean_ic from daily where ic is not null group by factor, lag""")
def factor_ic_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.ic_decay(long_factors(spark, sf_dir), v.dense(spark, sf_dir), (1, 2, 3)), "mean_ic")


PAIRS = """, pc as (select 'reversal' as a, 'volume' as b, count(*) as n, corr(reversal, volume) as c from wide where reversal is not null and volume is not null union all
select 'reversal', 'spread', count(*), corr(reversal, spread) from wide where reversal is not null and spread is not null union all select 'volume', 'spread', count(*), corr(volume, spread) from wide where volume is not null and spread is not null),
lk as (select factor, max(abs(c)) as likeness from (select a as factor, c from pc union all select b, c from pc) group by 1)"""
BUNDLE = IC + """, nm as (select factor, datetime, case when count(*) >= 3 and var_pop(value) > 0 and var_pop(ret) > 0 then corr(value, ret) end as ic from fac where value is not null and ret is not null group by all),
ch as (select *, abs(value - lag(value) over (partition by factor, instrument order by datetime)) as c from fac),
dq as (select factor, datetime, count(*) as cells, count(value) as n, sum(c) as c, count(c) as cn, stddev_samp(value) as sd, count(*) filter (where abs(value) > 10) as far from ch group by all),
qu as (select factor, sum(c) / sum(cn) as change, sum(n) / sum(cells) as coverage, sum(n) / sum(cells) >= 0.8 and avg(case when sd > 1e-6 then 1.0 else 0.0 end) >= 0.7 and sum(far) / sum(n) <= 0.05 as valid from dq group by factor),
bu as (select qu.factor, qu.change, qu.coverage, qu.valid, n.ic, n.ir, n.days, r.ic as rank_ic from qu join (select factor, avg(ic) as ic, avg(ic) / stddev_samp(ic) as ir, count(ic) as days from nm group by 1) n on n.factor = qu.factor join (select factor, avg(ic) as ic from daily group by 1) r on r.factor = qu.factor)"""
BASE = f""", bk as (select factor, datetime, {ranked("factor, datetime", "value", "base")} from (select f.factor, f.datetime, f.value, w.volume as base from fac f join wide w on w.datetime = f.datetime and w.instrument = f.instrument where f.value is not null and w.volume is not null)),
bd as (select factor, datetime, {RANK_CORR} as ic from bk group by all), bl as (select factor, count(ic) as days, avg(abs(ic)) as likeness from bd group by 1)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.dense(spark, sf_dir).select("datetime", "instrument", *[c.cast("double").alias(n) for n, c in columns().items()])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.pair_correlations(wide(spark, sf_dir), NAMES)


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.bundle(long_factors(spark, sf_dir), returns(spark, sf_dir))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = v.bars(spark, sf_dir).select("datetime", "instrument", F.col("volume").cast("double").alias("baseline"))
    return selection.baseline_likeness(long_factors(spark, sf_dir).join(base, ["datetime", "instrument"]))


@query("factor_pairs", FACTORS + PAIRS + " select a, b, n, round(c, 6) as corr from pc")
def factor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs(spark, sf_dir), "corr")


@query("factor_likeness", FACTORS + PAIRS + " select factor, round(likeness, 6) as likeness, 0 as skipped from lk")
def factor_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.likeness(pairs(spark, sf_dir)), "likeness")


@query("factor_bundle", FACTORS + BUNDLE + " select factor, round(ic, 6) as ic, round(rank_ic, 6) as rank_ic, round(ir, 6) as ir, days, round(change, 6) as mean_abs_change, valid from bu")
def factor_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bundles(spark, sf_dir), "ic", "rank_ic", "ir", "mean_abs_change").select("factor", "ic", "rank_ic", "ir", "days", "mean_abs_change", "valid")


@query("baseline_likeness", FACTORS + BASE + " select factor, days, round(likeness, 6) as likeness from bl")
def baseline_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baseline(spark, sf_dir), "likeness")


@query("factor_scores", FACTORS + PAIRS + BUNDLE + BASE + """ select bu.factor, round(case when bu.coverage >= 0.9 then abs(bu.ic) + 0.5 * bu.ir + 0.5 * abs(bu.rank_ic) - 0.2 * bu.change * 252 * 0.003 - 0.8 * lk.likeness - 0.01 * 3 - 0.5 * greatest(0, bl.likeness - 0.05) end, 6) as score
from bu join lk on lk.factor = bu.factor join bl on bl.factor = bu.factor""")
def factor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores under a rule of coverage alone, as these factors all have outliers; NULL where the score is minus infinity."""
    rows = bundles(spark, sf_dir).join(selection.likeness(pairs(spark, sf_dir)), "factor").join(baseline(spark, sf_dir).select("factor", F.col("likeness").alias("base")), "factor")
    out = selection.scored(rows.withColumn("valid", F.col("coverage") >= 0.9), F.lit(3), F.col("likeness"), F.col("base"), 0.05, weights=selection.WEIGHTS | {"baseline": 0.5})
    return out.select("factor", F.when(F.col("score") > float("-inf"), F.round("score", 6)).alias("score"))


@query("kept_factors", FACTORS + PAIRS + IC + """, o as (select factor, row_number() over (order by abs(avg(ic)) desc, factor) as r from daily group by factor)
select o.factor, list_contains(z.kept, o.factor) as kept from o, (with recursive k(i, kept) as (select 0::bigint, []::varchar[] union all
select k.i + 1, case when exists (select 1 from pc where abs(c) > 0.005 and ((a = o.factor and list_contains(k.kept, b)) or (b = o.factor and list_contains(k.kept, a)))) then k.kept else list_append(k.kept, o.factor) end from k join o on o.r = k.i + 1) select kept from k order by i desc limit 1) z""")
def kept_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.kept_apart(bundles(spark, sf_dir).select("factor", F.abs("rank_ic").alias("score")), pairs(spark, sf_dir), 0.005)


@query("best_factors", FACTORS + IC + " select factor, round(avg(ic), 6) as rank_ic from daily group by 1 order by abs(avg(ic)) desc, factor limit 2")
def best_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.top_of_pool(bundles(spark, sf_dir).select("factor", "rank_ic"), F.abs("rank_ic"), "factor", 2), "rank_ic")


HELD = """+ e as (select datetime as signal, idx, lead(datetime) over (order by datetime) as execution, max(datetime) over () as last, max(idx) over () as m from cal), s0 as (select signal, execution, last from e where idx >= 2 and (idx - 2) % 26 = 0 and idx < m),
st as (select * from (select signal, execution, coalesce(lead(execution) over (order by signal), last) as horizon_end from s0) where horizon_end > execution),
h as (select s.signal, b.instrument, max(case when b.datetime = s.execution then b.close end) as i, arg_max(b.close, b.datetime) filter (where b.datetime > s.execution) as o, max(b.datetime) < max(s.horizon_end) as short from st s join bars b on b.datetime between s.execution and s.horizon_end group by 1, 2),
held as (select signal, instrument, coalesce(o, i) / i - 1 as ret, case when o is null then 'flat' when short then 'truncated' else 'held' end as state from h where i is not null)"""
FOLDS = HELD + f""", j as (select h.signal, p.score, h.ret from held h join predictions p on p.datetime = h.signal and p.instrument = h.instrument), rk as (select signal, score, ret, {ranked("signal", "score", "ret")} from j),
fi as (select signal, count(*) as n, {RANK_CORR} as rank_ic, case when count(*) >= 3 then corr(score, ret) end as ic from rk group by 1)"""


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.bars(spark, sf_dir)
    return selection.held_returns(b, schedule.stamps(panel.calendar(b), 26, 2))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = v.predictions(spark, sf_dir).withColumnRenamed("datetime", "signal")
    return selection.fold_ic(held(spark, sf_dir).join(scores, ["signal", "instrument"]), "signal", 3)


@query("held_returns", HELD + " select signal, instrument, round(ret + 1e-9, 6) as ret, state from held")
def held_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir).withColumn("ret", F.round(F.col("ret") + 1e-9, 6))


@query("fold_ic", FOLDS + " select signal, n, round(rank_ic, 6) as rank_ic, round(ic, 6) as ic from fi")
def fold_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds(spark, sf_dir), "rank_ic", "ic")


@query("fold_summary", FOLDS + " select count(rank_ic) as folds, round(avg(rank_ic), 6) as mean, round(stddev_samp(rank_ic), 6) as std, count(*) filter (where rank_ic > 0) as positive, round(avg(rank_ic) / stddev_samp(rank_ic), 6) as ir, round(avg(rank_ic) / stddev_samp(rank_ic) * sqrt(count(rank_ic)), 6) as t from fi")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.fold_summary(folds(spark, sf_dir)), "mean", "std", "ir", "t")


@query("segment_validation", FACTORS + f""", eg as (select min(idx) as e from cal where datetime >= date '1999-01-01'), sg as (select f.factor, f.datetime, f.value, f.ret, 'is' as segment from fac f join cal c on c.datetime = f.datetime, eg where c.idx < eg.e union all
select f.factor, f.datetime, f.value, case when c.idx >= eg.e then f.ret end, 'oos' from fac f join cal c on c.datetime = f.datetime, eg where c.idx >= eg.e - 10),
rk as (select factor, segment, datetime, {ranked("factor, segment, datetime", "value", "ret")} from sg where value is not null and ret is not null), d as (select factor, segment, datetime, count(*) as n, {RANK_CORR} as ic from rk group by all),
a as (select factor, segment, sum(n) as n, avg(ic) as rank_ic, case when stddev_samp(ic) >= 1e-9 then avg(ic) / stddev_samp(ic) end as rank_ir from d group by 1, 2)
select factor, segment, cast(n as bigint) as n, round(rank_ic, 6) as rank_ic, round(rank_ir, 6) as rank_ir, concat_ws(',', case when not coalesce(abs(rank_ic) >= 0.01, false) then 'rank_ic' end, case when not coalesce(abs(rank_ir) >= 0.05, false) then 'rank_ir' end, case when n < 6000 then 'n' end) as reasons from a""")
def segment_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_factors(spark, sf_dir).withColumnRenamed("value", "score").join(returns(spark, sf_dir), ["datetime", "instrument"])
    out = selection.validated(selection.segmented(rows, panel.calendar(v.bars(spark, sf_dir)), "1999-01-01", 10), 0.01, 0.05, 6000)
    return rounded(out.withColumn("reasons", F.array_join("reasons", ",")), "rank_ic", "rank_ir")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = long_factors(spark, sf_dir).withColumnRenamed("value", "score").join(returns(spark, sf_dir), ["datetime", "instrument"])
    return signal.daily_ic(joined, "factor", "datetime").where("ic is not null")


@query("metric_drift", FACTORS + IC + """, b as (select factor as metric, avg(ic) as baseline from daily where datetime < date '1998-06-01' group by 1), a as (select factor as metric, avg(ic) as actual from daily where factor <> 'spread' group by 1)
select b.metric, round(b.baseline, 6) as baseline, round(a.actual, 6) as actual, round(abs(a.actual - b.baseline) / abs(b.baseline), 6) as drift, case when a.metric is null then 'missing' else 'relative' end as why from b left join a on a.metric = b.metric where a.metric is null or abs(a.actual - b.baseline) / abs(b.baseline) > 0.1""")
def metric_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    actual = d.where("factor <> 'spread'").groupBy(F.col("factor").alias("metric")).agg(F.avg("ic").alias("value"))
    before = d.where("datetime < date'1998-06-01'").groupBy(F.col("factor").alias("metric")).agg(F.avg("ic").alias("value"))
    return rounded(selection.drifted(actual, before, 0.1), "baseline", "actual", "drift")


@query("run_stability", FACTORS + IC + """, fo as (select year(datetime) as fold, avg(ic) / stddev_samp(ic) as ir, min(ic) as drawdown from daily where factor = 'reversal' and ic is not null group by 1), rr as (select *, row_number() over (order by fold) as f, row_number() over (order by ir, fold) as r from fo),
g as (select count(ir) as n, avg(ir) as m, stddev_pop(ir) as s, avg(case when ir > 0 then 1.0 else 0.0 end) as positive, min(drawdown) as w, max(drawdown) as b, corr(f, r) as trend from rr),
p as (select n, 1 - least(s / abs(m), 1) as steady, positive, greatest(0, least(1, 1 - abs(w) / (abs(b) + 0.0001))) as drawdown, trend from g)
select n, round(steady, 6) as steady, round(positive, 6) as positive, round(drawdown, 6) as drawdown, round(trend, 6) as trend, round(0.4 * steady + 0.3 * positive + 0.2 * drawdown + case when abs(trend) < 0.3 then 0.1 else 0 end, 6) as score from p""")
def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = daily(spark, sf_dir).where("factor = 'reversal'").groupBy(F.year("datetime").alias("fold")).agg((F.avg("ic") / F.stddev_samp("ic")).alias("ir"), F.min("ic").alias("drawdown"))
    return rounded(selection.stability(years), "steady", "positive", "drawdown", "trend", "score")


FAMILY = IC + """, tr as (select d.factor as trial, c.idx as pos, d.ic as x from daily d join cal c on c.datetime = d.datetime where d.ic is not null), fm as (select trial, pos, x - avg(x) over (partition by trial) as x from tr), mm as (select max(pos) + 1 as m, count(distinct trial) as k from tr),
dr as (select b, i, m, k, cast(concat('0x', substr(md5(concat('7:', cast(b as varchar), ':', cast(i // 4 as varchar))), 1, 8)) as ubigint) as start from mm, (select unnest(range(0, 200)) as b), (select unnest(range(0, (select m from mm))) as i)),
tt as (select dr.b, dr.k, fm.trial, case when count(*) >= 2 and stddev_samp(fm.x) >= 1e-12 then avg(fm.x) / (stddev_samp(fm.x) / sqrt(count(*))) end as t from dr join fm on fm.pos = (dr.start + dr.i % 4) % dr.m group by 1, 2, 3),
mx as (select b, case when count(t) = max(k) then max(t) end as max_t from tt group by b)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).join(F.broadcast(panel.calendar(v.bars(spark, sf_dir))), "datetime").select(F.col("factor").alias("trial"), F.col("idx").alias("pos"), F.col("ic").alias("x"))


@query("family_draws", FACTORS + FAMILY + " select b, round(max_t, 6) as max_t from mx")
def family_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.family_draws(trials(spark, sf_dir), 200, 7), "max_t")


@query("family_verdict", FACTORS + FAMILY + """, q as (select quantile_cont(max_t, 0.95) as bar from mx), o as (select trial, count(x) as n, avg(x) / (stddev_samp(x) / sqrt(count(x))) as t from tr group by 1)
select trial, n, round(t, 6) as t, round(bar, 6) as bar, t > bar and t >= 2.85 as passed from o, q""")
def family_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir)
    return rounded(selection.adjudicated(t, selection.family_draws(t, 200, 7)), "t", "bar")
