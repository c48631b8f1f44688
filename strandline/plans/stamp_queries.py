"""Queries over stamp plans, slices, tradable signals and family draws, each with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import codes
from strandline.operators import panel, pretrade, selection, stamps, statements
from strandline.plans import testviews as v
from strandline.plans.registry import query
from strandline.plans.selection_queries import FACTORS, IC, trials
from strandline.plans.signal_queries import rounded

LAST = "2000-11-15"
#: Fold windows are the quarters of three years; the second cut splits one of them, the first two overlap.
CUTS = "(date '1998-03-02', date '1998-03-20'), (date '1998-03-16', date '1998-04-30'), (date '1999-07-20', date '1999-08-08'), (date '2000-01-01', date '1999-01-01')"
PLAN = f"""+ recursive fold as (select (year(q) - 1998) * 4 + quarter(q) - 1 as fold, q as start, cast(q + interval 3 month as date) - 1 as "end" from (select distinct cast(date_trunc('quarter', datetime) as date) as q from cal where year(datetime) between 1998 and 2000)),
old as (select -k as fold, cast((select min(start) from fold) - (3 * k) * interval 1 month as date) as start, cast((select min(start) from fold) - (3 * k - 3) * interval 1 month as date) - 1 as "end" from (select unnest([1, 2, 3, 4]) as k)),
cut as (select * from (values {CUTS}) t(s, e)),
every as (select 'canonical' as plan, * from fold union all select 'earlier', * from fold union all select 'earlier', * from old union all select 'cut', * from fold),
fd as (select f.plan, f.fold, c.datetime, c.idx from every f join cal c on c.datetime between f.start and least(f."end", date '{LAST}') where f.plan <> 'cut' or not exists (select 1 from cut where c.datetime between s and e)),
sg as (select *, idx - row_number() over (partition by plan, fold order by idx) as seg from fd),
pos as (select *, row_number() over (partition by plan, fold, seg order by idx) - 1 as pos, count(*) over (partition by plan, fold, seg) as n from sg),
walk as (select distinct plan, fold, seg, n, cast(1 as bigint) as pos from pos where 1 < n - 1 union all select plan, fold, seg, n, pos + 5 from walk where pos + 5 < n - 1),
due as (select w.plan, w.fold, p.datetime as signal, e.datetime as execution, h.datetime as horizon_end from walk w join pos p on p.plan = w.plan and p.fold = w.fold and p.seg = w.seg and p.pos = w.pos
  join pos e on e.plan = w.plan and e.fold = w.fold and e.seg = w.seg and e.pos = w.pos + 1 join pos h on h.plan = w.plan and h.fold = w.fold and h.seg = w.seg and h.pos = case when w.pos + 5 < w.n - 1 then w.pos + 6 else w.n - 1 end)"""


def fold_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    days = panel.calendar(v.bars(spark, sf_dir))
    start = days.where("year(datetime) between 1998 and 2000").select(F.to_date(F.trunc("datetime", "quarter")).alias("start")).distinct()
    fold = (F.year("start") - 1998) * 4 + F.quarter("start") - 1
    return start.select(fold.cast("long").alias("fold"), "start", F.date_sub(F.add_months("start", 3), 1).alias("end")), days


def cuts(spark: SparkSession) -> DataFrame:
    return spark.sql(f"select * from values {CUTS.replace('date ', 'date')} as t(start, end)")


@query("stamp_plans", PLAN + f""", chain as (select fold, start, lead("end", 1) over (order by start) as e2, lead("end", 3) over (order by start) as e4, row_number() over (order by start) - 1 as i from fold),
long as (select 'two folds' as plan, fold, start, e2 as e from chain where i % 2 = 0 and e2 is not null union all select 'four folds', fold, start, e4 from chain where i % 4 = 0 and e4 is not null),
held as (select plan, fold, (select min(datetime) from cal where datetime >= start) as signal, (select min(c.datetime) from cal c where c.datetime > (select min(datetime) from cal where datetime >= start)) as execution, (select max(datetime) from cal where datetime <= least(e, date '{LAST}')) as horizon_end from long)
select plan, fold, case when row_number() over (partition by plan, fold order by signal) = 1 then 'primary' else 'tail' end as kind, signal, execution, horizon_end from due where horizon_end > execution
union all select plan, fold, 'primary', signal, execution, horizon_end from held where horizon_end > execution""")
def stamp_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical plan, one over four more quarters, one with slices cut out, and holdings over two and four folds."""
    folds, days = fold_windows(spark, sf_dir)
    plans = {
        "canonical": stamps.stamp_plan(folds, days, LAST, 5, 1), "earlier": stamps.stamp_plan(stamps.earlier_folds(folds, 4), days, LAST, 5, 1), "cut": stamps.stamp_plan(folds, days, LAST, 5, 1, cuts(spark)),
        "two folds": stamps.held_over(folds, days, LAST, 2), "four folds": stamps.held_over(folds, days, LAST, 4),
    }
    return reduce(DataFrame.unionByName, [p.withColumn("plan", F.lit(n)) for n, p in plans.items()])


@query("stamp_counts", PLAN + """, c as (select f.plan, f.fold, (select count(*) from fd where fd.plan = f.plan and fd.fold = f.fold) as n_days, (select count(*) from due d where d.plan = f.plan and d.fold = f.fold and d.horizon_end > d.execution) as n_stamps, (select count(*) from due d where d.plan = f.plan and d.fold = f.fold and d.horizon_end <= d.execution) as n_zero from every f where f.plan = 'cut')
select fold, n_days, n_stamps, n_zero, case when n_days < 3 then 'too few days' when n_stamps + n_zero = 0 then 'no stamp can be filled' when n_stamps = 0 then 'all are held no day' end as fault from c""")
def stamp_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds, days = fold_windows(spark, sf_dir)
    return stamps.stamp_counts(folds, days, LAST, 5, 1, cuts(spark))


@query("merged_slices", """+ sl as (select o_custkey % 40 as code, cast(o_orderdate as date) as s, cast(o_orderdate as date) + cast(o_orderkey % 9 as int) - 1 as e from orders), d as (select distinct code, unnest(generate_series(s, e, interval 1 day)) as d from sl where s <= e),
r as (select code, cast(d as date) as d, cast(d as date) - cast(row_number() over (partition by code order by d) as int) as g from d) select code, min(d) as start, max(d) as "end" from r group by code, g""")
def merged_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of days from each order on, some of which end before they begin."""
    o, start = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.to_date("o_orderdate")
    return stamps.merged_slices(o.select((F.col("o_custkey") % 40).alias("code"), start.alias("start"), F.date_add(start, (F.col("o_orderkey") % 9).cast("int") - 1).alias("end")), "code")


SLICES = "('early', date '1996-01-01', date '1996-12-31'), ('early', date '1996-06-01', date '1997-03-31'), ('none', date '1980-01-01', date '1980-12-31'), ('most', date '1990-01-01', date '2001-10-01'), ('odd', date '1998-01-01', date '2001-12-31')"


@query("slice_checks", f"""+ sl as (select * from (values {SLICES}) t(slices, s, e)), a as (select datetime from cal where datetime < date '2001-01-01' or idx % 2 = 0), b as (select datetime from cal where idx % 9 <> 4 or datetime >= date '1997-06-30' ),
e as (select coalesce(a.datetime, b.datetime) as d, a.datetime as a, b.datetime as b from a full join b on a.datetime = b.datetime),
x as (select n.slices, e.*, exists (select 1 from sl where sl.slices = n.slices and e.d between sl.s and sl.e) as gone from e cross join (select distinct slices from sl) n),
c as (select slices, count(*) filter (not gone and a is not null) as n_a, count(*) filter (not gone and b is not null) as n_b, count(*) filter (not gone and a is not null and b is not null) as n_shared, count(*) filter (gone and a is not null and b is not null) as n_out from x group by slices)
select *, case when n_out = 0 then 'nothing removed' when n_shared < 20 then 'too few days' when n_shared < 0.9 * least(n_a, n_b) then 'too little overlap' end as fault from c""")
def slice_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = panel.calendar(v.bars(spark, sf_dir))
    named = spark.sql(f"select * from values {SLICES.replace('date ', 'date')} as t(slices, start, end)")
    return stamps.slice_checks(days.where("datetime < date '2001-01-01' or idx % 2 = 0"), days.where("idx % 9 <> 4 or datetime >= date '1997-06-30'"), named)


RISKY = """nm as (select concat('I', lpad(cast(o_custkey % 40 as varchar), 2, '0')) as instrument, cast(o_orderdate as date) as start, max(case when o_orderstatus = 'F' then 1 else 0 end) = 1 as is_risk from orders where o_custkey % 40 < 12 group by 1, 2),
sp as (select *, lead(start) over (partition by instrument order by start) as next from nm),"""
JUDGED = "+ " + RISKY + """ dd as (select distinct datetime from predictions where cast(substr(instrument, 2) as int) % 7 <> 3), due as (select dd.datetime, lead(dd.datetime) over (order by dd.datetime) as stamp from dd join cal c on c.datetime = dd.datetime where c.idx % 2 = 0 and c.idx < (select max(idx) from cal)),
nx as (select datetime as stamp, lead(datetime) over (order by datetime) as execution from cal),
j as (select p.datetime, p.instrument, p.score, d.stamp, nx.execution, case when d.datetime is null then 'unscheduled' when d.stamp is null then 'past the end'
  when nx.execution is not null and (b.volume is null or b.volume < 1 or b.close is null) then 'suspended' when nx.execution is not null and b.high = b.low then 'one_price' when s.is_risk then 'risk name' end as why
  from (select * from predictions where cast(substr(instrument, 2) as int) % 7 <> 3) p left join due d on d.datetime = p.datetime left join nx on nx.stamp = d.stamp left join dense b on b.datetime = nx.execution and b.instrument = p.instrument
  left join sp s on s.instrument = p.instrument and s.start <= nx.execution and (s.next is null or nx.execution < s.next))"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey % 40 < 12")
    history = o.select(F.concat(F.lit("I"), F.lpad((F.col("o_custkey") % 40).cast("string"), 2, "0")).alias("code"), F.to_date("o_orderdate").alias("start_date"), F.when(F.col("o_orderstatus") == "F", "*ST X").otherwise("X").alias("name"))
    spans = statements.name_spans(history, codes.is_risk_name(F.col("name")))
    signals = v.predictions(spark, sf_dir).where(F.substring("instrument", 2, 2).cast("int") % 7 != 3)
    return pretrade.judged_signals(signals, v.dense(spark, sf_dir), panel.calendar(v.bars(spark, sf_dir)), 2, 0, 1, spans)


@query("tradable_signals", JUDGED + " select stamp as datetime, instrument, execution, round(score, 6) as score from j where why is null")
def tradable_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pretrade.tradable(judged(spark, sf_dir)), "score").select("datetime", "instrument", "execution", "score")


@query("signal_drop_counts", JUDGED + " select count(*) as given, count(*) filter (why is null) as kept, count(*) filter (why = 'unscheduled') as unscheduled, count(*) filter (why = 'past the end') as past_the_end, count(*) filter (why = 'suspended') as suspended, count(*) filter (why = 'one_price') as one_price, count(*) filter (why = 'risk name') as risk_name from j")
def signal_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pretrade.drop_counts(judged(spark, sf_dir))


#: One trial of six positions among hundreds, so that most draws find under two of them.
SPARSE = IC + """, tr as (select d.factor as trial, c.idx as pos, d.ic as x from daily d join cal c on c.datetime = d.datetime where d.ic is not null and (d.factor <> 'volume' or c.idx % 60 = 7)), fm as (select trial, pos, x - avg(x) over (partition by trial) as x from tr), mm as (select max(pos) + 1 as m, count(distinct trial) as k from tr),
dr as (select b, i, m, k, cast(concat('0x', substr(md5(concat('11:', cast(b as varchar), ':', cast(i // 4 as varchar))), 1, 8)) as ubigint) as start from mm, (select unnest(range(0, 660)) as b), (select unnest(range(0, (select m from mm))) as i)),
tt as (select dr.b, dr.k, fm.trial, case when count(*) >= 2 and stddev_samp(fm.x) >= 1e-12 then avg(fm.x) / (stddev_samp(fm.x) / sqrt(count(*))) end as t from dr join fm on fm.pos = (dr.start + dr.i % 4) % dr.m group by 1, 2, 3),
mx as (select b as c, max(t) as max_t from tt group by b having count(t) = max(k))"""


@query("sparse_family_draws", FACTORS + SPARSE + " select row_number() over (order by c) - 1 as b, round(max_t, 6) as max_t from mx qualify row_number() over (order by c) <= 60")
def sparse_family_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = trials(spark, sf_dir).where("trial <> 'volume' or pos % 60 = 7")
    return rounded(selection.family_draws(sparse, 60, 11), "max_t")
