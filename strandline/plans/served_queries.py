"""Queries over what stores of disclosures serve, each with SQL that looks every day up on its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import served, statements
from strandline.plans.registry import query
from strandline.plans.statement_queries import ST, days, raw
from strandline.sources.shared import kept_table, new_path

SOURCES = ("income", "balance", "cash")
FIELDS = {"income": ("revenue",), "balance": ("total_assets",), "cash": ("oper_cost",)}

#: Each order is a filing of one of three sources; what is of record is settled source by source.
SRC = ST.replace("select o_custkey % 40 as code", "select case o_orderkey % 3 when 0 then 'income' when 1 then 'balance' else 'cash' end as source, o_custkey % 40 as code").replace("partition by code,", "partition by source, code,") + """,
late as (select source, code, period, (select c2.datetime from cal c1 join cal c2 on c2.idx = c1.idx + 3 where c1.datetime = rec.available_from) as available_from from rec),
asked as (select datetime from cal where idx % 4 = 1),
who as (select distinct source, code from rec),
served_base as (select w.source, w.code, a.datetime, (select max(r.period) from rec r where r.source = w.source and r.code = w.code and r.available_from <= a.datetime) as period from who w cross join asked a),
served_late as (select w.source, w.code, a.datetime, (select max(r.period) from late r where r.source = w.source and r.code = w.code and r.available_from <= a.datetime) as period from who w cross join asked a),
moves as (select b.source, b.code, b.datetime, b.period as base_period, l.period as shifted_period from served_base b join served_late l on l.source = b.source and l.code = b.code and l.datetime = b.datetime where b.period is distinct from l.period)"""


def by_source(spark: SparkSession, sf_dir: str, known: DataFrame) -> dict[str, DataFrame]:
    """What is of record in each source, by the calendar."""
    filings = raw(spark, sf_dir).withColumn("_k", F.substring("batch", -9, 9).cast("long") % 3)
    return {s: statements.of_record(statements.contract(filings.where(F.col("_k") == i).drop("_k"), known)) for i, s in enumerate(SOURCES)}


def together(records: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [r.withColumn("source", F.lit(s)) for s, r in records.items()])


def kept_record(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is of record in each source, and the calendar. Both are read many times and far smaller than what they come from, so they are written once."""
    path = new_path(spark, "served")
    known = kept_table(days(spark, sf_dir), f"{path}/days")
    kept = kept_table(together(by_source(spark, sf_dir, known)), f"{path}/record")
    return {s: kept.where(F.col("source") == s).drop("source") for s in SOURCES}, known


def sampled(known: DataFrame) -> DataFrame:
    return known.where("idx % 4 = 1").select("datetime")


def periods_served(records: dict[str, DataFrame], samples: DataFrame) -> DataFrame:
    """(source, code, datetime, period) as a builder would serve it from these records."""
    codes = together(records).select("code").distinct()
    panel = served.fundamental_panel(records, FIELDS, samples, codes)
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"{s}_period").alias("period")) for s in records]))
    return panel.select("code", "datetime", cells.alias("x")).select("x.source", "code", "datetime", "x.period")


@query("winner_moves", SRC + " select source, code, datetime, base_period, shifted_period from moves")
def winner_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, known = kept_record(spark, sf_dir)
    return served.winner_moves(together(records), known, sampled(known), 3)


#: A builder that follows announcements; one that ignores them (the same panel twice); one that goes by the period alone and leaves rows out; one asked before anything is known.
CASES = ("follows", "ignores", "by period", "too early")


@query("shift_verdict", SRC + """,
blind as (select source, code, datetime, (select max(r.period) from rec r where r.source = b.source and r.code = b.code and r.period <= b.datetime) as period from served_base b where code % 5 <> 0),
f as (select 'follows' as builder, m.*, true as has_b, b.period as got_b, true as has_l, l.period as got_l from moves m join served_base b using (source, code, datetime) join served_late l using (source, code, datetime)
union all select 'ignores', m.*, true, b.period, true, b.period from moves m join served_base b using (source, code, datetime)
union all select 'by period', m.*, b.source is not null, b.period, b.source is not null, b.period from moves m left join blind b using (source, code, datetime)),
v as (select builder, case when has_b then 0 else 1 end + case when has_l then 0 else 1 end + case when has_b and has_l and got_b is distinct from base_period then 1 else 0 end + case when has_b and has_l and got_l is distinct from shifted_period then 1 else 0 end as k from f)
select builder, count(*) as n_moves, cast(sum(k) as bigint) as n_violations, case when sum(k) > 0 then 'REFUSE' else 'OK' end as verdict from v group by builder
union all select 'too early', 0, 0, 'INCONCLUSIVE'""")
def shift_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, known = kept_record(spark, sf_dir)
    asked = sampled(known)
    moves = kept_table(served.winner_moves(together(records), known, asked, 3), new_path(spark, "moves"))
    base = periods_served(records, asked)
    later = periods_served({s: served.delayed(r, known, 3) for s, r in records.items()}, asked)
    by_period = periods_served({s: r.withColumn("available_from", F.col("period")) for s, r in records.items()}, asked).where("code % 5 <> 0")
    none = moves.where("datetime < date '1900-01-01'")
    judged = {"follows": (moves, base, later), "ignores": (moves, base, base), "by period": (moves, by_period, by_period), "too early": (none, base, later)}
    return reduce(DataFrame.unionByName, [served.shift_verdict(served.judged_moves(*judged[c])).withColumn("builder", F.lit(c)) for c in CASES])


#: Each field of each day is looked up by itself: the latest period that is available, then the quarter before it.
PANEL = SRC + """,
g as (select c.datetime, w.code from cal c cross join (select distinct code from rec) w),
p as (select g.datetime, g.code, s.source, (select max(r.period) from rec r where r.source = s.source and r.code = g.code and r.available_from <= g.datetime) as period from g cross join (select unnest(['income', 'balance', 'cash']) as source) s),
n as (select p.datetime, p.code, p.source, p.period, r.available_from, r.revenue, r.total_assets, r.oper_cost, o.period as old_period, o.available_from as old_available, o.revenue as old_revenue, o.total_assets as old_assets, o.oper_cost as old_cost
  from p left join rec r on r.source = p.source and r.code = p.code and r.period = p.period
  left join rec o on o.source = p.source and o.code = p.code and o.period = last_day(cast(p.period - interval 3 month as date)) and o.available_from <= p.datetime),
w as (select i.datetime, i.code, i.revenue, i.available_from as income_available, i.period as income_period, i.old_revenue as revenue_prior, i.old_available as income_prior_available, i.old_period as income_prior_period,
  b.total_assets, b.available_from as balance_available, b.period as balance_period, b.old_assets as total_assets_prior, b.old_available as balance_prior_available, b.old_period as balance_prior_period,
  c.oper_cost, c.available_from as cash_available, c.period as cash_period, c.old_cost as oper_cost_prior, c.old_available as cash_prior_available, c.old_period as cash_prior_period
  from n i join n b on b.datetime = i.datetime and b.code = i.code and b.source = 'balance' join n c on c.datetime = i.datetime and c.code = i.code and c.source = 'cash' where i.source = 'income')"""


def panel_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, known = kept_record(spark, sf_dir)
    return served.fundamental_panel(records, FIELDS, known, together(records).select("code"), prior=True)


@query("fundamental_panel", PANEL + " select * from w")
def fundamental_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_of_all(spark, sf_dir)


@query("fundamental_panel_defects", PANEL + """,
t as (select datetime, code, case when code % 4 = 0 then null else income_available end as income_available, income_period, revenue, case when code % 4 = 1 then income_available + 400 else balance_available end as balance_available, case when code % 4 = 2 then null else balance_period end as balance_period, total_assets from w),
u as (select *, lag(income_available) over o as i0, lag(balance_available) over o as b0 from t window o as (partition by code order by datetime))
select datetime, code, 'income' as source, 'no evidence' as defect from u where revenue is not null and income_available is null
union all select datetime, code, 'balance', 'no evidence' from u where total_assets is not null and balance_available is null
union all select datetime, code, 'income', 'after the day' from u where income_available > datetime union all select datetime, code, 'balance', 'after the day' from u where balance_available > datetime
union all select datetime, code, 'income', 'no period' from u where income_available is not null and income_period is null union all select datetime, code, 'balance', 'no period' from u where balance_available is not null and balance_period is null
union all select datetime, code, 'income', 'went back' from u where i0 > income_available union all select datetime, code, 'balance', 'went back' from u where b0 > balance_available""")
def fundamental_panel_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = panel_of_all(spark, sf_dir), F.col("code") % 4
    spoilt = p.withColumns({"balance_available": F.when(k == 1, F.date_add("income_available", 400)).otherwise(F.col("balance_available")), "balance_period": F.when(k != 2, F.col("balance_period")), "income_available": F.when(k != 0, F.col("income_available"))})
    return served.fundamental_defects(spoilt, {s: FIELDS[s] for s in ("income", "balance")})
