"""Queries over universes, sizes, coverage and checks, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import evaluation, panel, portfolio, statements, universe, validation
from strandline.plans import testviews as v
from strandline.plans.portfolio_queries import BENCH, POS, bench, positions
from strandline.plans.queries import REGISTRY, SPANS, registry, spans
from strandline.plans.registry import off_ties, query
from strandline.plans.signal_queries import rounded
from strandline.plans.statement_queries import ST, record

BOTH = SPANS + ", " + REGISTRY.lstrip().removeprefix("+")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.calendar(v.bars(spark, sf_dir))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.bars(spark, sf_dir).select("datetime", "instrument", F.col("money").cast("double").alias("size"))


@query("alive_members", BOTH + """ select distinct c.datetime, s.instrument from cal c join spans s on c.datetime between s.start and s."end" left join reg r on r.instrument = s.instrument where r.delist_date is null or r.delist_date >= c.datetime""")
def alive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.alive_members(days(spark, sf_dir), spans(spark, sf_dir), registry(spark, sf_dir))


@query("ever_members", SPANS + " select distinct instrument from spans")
def ever_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.ever_members(spans(spark, sf_dir))


@query("marked_out", REGISTRY + " select p.datetime, p.instrument, p.score > 0.5 and r.instrument is null as inside from predictions p left join reg r on r.instrument = p.instrument")
def marked_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = v.predictions(spark, sf_dir).select("datetime", "instrument", (F.col("score") > 0.5).alias("inside"))
    return universe.marked_out(mask, registry(spark, sf_dir))


@query("listed_spans", REGISTRY + """, f as (select instrument, min(datetime) as start from bars group by 1) select f.instrument, f.start, coalesce(r.delist_date, date '2099-12-31') as "end" from f left join reg r on r.instrument = f.instrument""")
def listed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = v.bars(spark, sf_dir).groupBy("instrument").agg(F.min("datetime").alias("list_date"))
    gone = registry(spark, sf_dir)
    return universe.listed_spans(first.join(gone, "instrument", "left_anti"), first.join(gone, "instrument"))


AS_OF = """+ sz as (select c.datetime, b.instrument, arg_max(b.money, e.idx) as size, max(c.idx) - max(e.idx) as age from cal c join cal e on e.idx between c.idx - 3 and c.idx join bars b on b.datetime = e.datetime where c.idx % 4 = 0 group by 1, 2)"""


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir)
    return universe.sizes_as_of(sizes(spark, sf_dir), d.where("idx % 4 = 0"), d, 3)


@query("sizes_as_of", AS_OF + " select datetime, instrument, round(size, 2) as size, age from sz")
def sizes_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(as_of(spark, sf_dir), "size", places=2)


@query("size_buckets", AS_OF + """, q as (select *, round(size, 2) as s, row_number() over (partition by datetime order by round(size, 2), instrument) as r, count(*) over (partition by datetime) as m from sz)
select datetime, instrument, cast(case when m > 1 then greatest(((r - 1) * 5 + m - 2) // (m - 1) - 1, 0) else 0 end as int) as bucket from q""")
def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.buckets(rounded(as_of(spark, sf_dir), "size", places=2), "size", 5).select("datetime", "instrument", "bucket")


@query("market_weights", """+ l as (select instrument, arg_max(money, datetime) as size from bars where datetime between date '1998-06-01' - 120 and date '1998-06-01' group by 1), j as (select n.instrument, l.size from (select distinct instrument from bars) n left join l on l.instrument = n.instrument)
select instrument, round(case when (select count(*) from j where coalesce(size <= 0, true)) = 0 then size / (select sum(size) from j) end, 6) as weight from j""")
def market_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(universe.market_weights(sizes(spark, sf_dir), v.bars(spark, sf_dir), "1998-06-01", 120), "weight")


@query("size_holes", SPANS + """ select s.instrument, s.start, s."end" from spans s where s.start <= date '2000-12-31' and s."end" >= date '1996-01-01'
and not exists (select 1 from bars b where b.instrument = s.instrument and b.volume > 150 and b.datetime between greatest(s.start, date '1996-01-01') and least(s."end", date '2000-12-31'))""")
def size_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = v.bars(spark, sf_dir).where("volume > 150").select("datetime", "instrument", F.col("money").alias("size"))
    return universe.size_holes(large, spans(spark, sf_dir), "1996-01-01", "2000-12-31")


COVERAGE = ST + """, q as (select distinct cast(date_trunc('quarter', datetime) + interval 3 month - interval 1 day as date) as datetime from cal), g as (select q.datetime, u.code from q cross join (select distinct code from raw) u),
sv as (select q.datetime, r.code, arg_max(r.revenue, r.period) as revenue, arg_max(r.total_assets, r.period) as total_assets from q join rec r on r.available_from <= q.datetime group by 1, 2),
k as (select g.datetime, g.code, s.revenue, case when s.total_assets > 700000 then s.total_assets end as large from g left join sv s on s.datetime = g.datetime and s.code = g.code),
cov as (select datetime, 'revenue' as field, count(*) as names, count(revenue) as there, count(revenue) / count(*) as coverage from k group by 1 union all select datetime, 'large', count(*), count(large), count(large) / count(*) from k group by 1)"""


def coverage(spark: SparkSession, sf_dir: str, anchor: str | None = None) -> DataFrame:
    rec = record(spark, sf_dir)
    quarters = days(spark, sf_dir).select(F.last_day(F.add_months(F.trunc("datetime", "quarter"), 2)).alias("datetime")).distinct()
    served = statements.as_of_panel(rec, quarters, "revenue", "total_assets").withColumn("large", F.when(F.col("total_assets") > 700000, F.col("total_assets")))
    return universe.field_coverage(rec.select("code").distinct().crossJoin(F.broadcast(quarters)), served, ("revenue", "large"), anchor)


@query("field_coverage", COVERAGE + " select datetime, field, names, there, round(coverage, 6) as coverage from cov")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coverage(spark, sf_dir), "coverage")


@query("yearly_coverage", COVERAGE + " select year(datetime) as year, field, count(*) as snapshots, round(avg(coverage), 6) as coverage from cov group by 1, 2")
def yearly_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(universe.yearly_coverage(coverage(spark, sf_dir)), "coverage")


@query("reporter_coverage", COVERAGE + " select datetime, 'large' as field, count(*) as names, count(large) as there, round(count(large) / count(*), 6) as coverage from k where revenue is not null group by 1 union all select datetime, 'revenue', count(*), count(*), 1.0 from k where revenue is not null group by 1")
def reporter_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coverage(spark, sf_dir, "revenue"), "coverage")


@query("below_floors", COVERAGE + " select datetime, field, round(coverage, 6) as coverage, 0.95::double as floor from cov where field = 'revenue' and coverage < 0.95 union all select datetime, field, round(coverage, 6), 0.6::double from cov where field = 'large' and coverage < 0.6")
def below_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(universe.below_floors(coverage(spark, sf_dir), {"revenue": 0.95, "large": 0.6}), "coverage").select("datetime", "field", "coverage", "floor")


@query("tail_months", "+ z as (select 1)" + BENCH + " select datetime, round(ret, 6) as ret from bench where datetime >= (select max(datetime) from bench) - interval 6 month")
def tail_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(universe.tail_months(bench(spark, sf_dir), 6), "ret")


@query("without_slices", "+ z as (select 1)" + BENCH + " select datetime, round(ret, 6) as ret from bench where datetime not between date '1996-01-01' and date '1996-12-31' and datetime not between date '1999-03-01' and date '1999-05-31'")
def without_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = spark.sql("select * from values (date'1996-01-01', date'1996-12-31'), (date'1999-03-01', date'1999-05-31') as t(start, end)")
    return rounded(universe.without_slices(bench(spark, sf_dir), slices), "ret")


@query("common_days", "+ z as (select 1)" + BENCH + " select datetime from bench intersect select datetime from cal")
def common_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.common_days(bench(spark, sf_dir), v.bars(spark, sf_dir))


@query("position_weights", "+ h as (select datetime, instrument, volume * close as x from bars), t as (select datetime, sum(x) + 1000 as t from h group by 1) select h.datetime, h.instrument, round(h.x / t.t + 1e-9, 6) as weight from h join t on t.datetime = h.datetime")
def position_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.bars(spark, sf_dir)
    held = b.select("datetime", "instrument", F.col("volume").cast("double").alias("amount"), F.col("close").alias("price"))
    out = universe.position_weights(held, b.select("datetime").distinct().withColumn("cash", F.lit(1000.0)))
    return out.withColumn("weight", off_ties(F.col("weight")))


@query("holding_ranks", POS + " select datetime, instrument, weight, row_number() over (partition by datetime order by weight desc, instrument) as rank from pos")
def holding_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.ranked(positions(spark, sf_dir)).select("datetime", "instrument", "weight", "rank")


LATE = REGISTRY + ", k as (select r.* from reg r where r.delist_date between (select min(datetime) from bars) and (select max(datetime) from bars))"


@query("closes_after_delisting", LATE + " select b.instrument, k.delist_date, count(*) as n_after, max(b.datetime) as last from bars b join k on k.instrument = b.instrument and b.datetime > k.delist_date where b.close is not null group by 1, 2")
def closes_after_delisting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.closes_after_delisting(v.bars(spark, sf_dir), registry(spark, sf_dir))


@query("delisting_boundaries", LATE + """, l as (select k.instrument, k.delist_date, max(b.datetime) as last_close from k left join bars b on b.instrument = k.instrument and b.datetime between k.delist_date - 30 and k.delist_date + 10 group by 1, 2)
select instrument, delist_date, last_close, case when last_close > delist_date then 'look_ahead' when coalesce(delist_date - last_close > 7, true) then 'suspended' else 'ok' end as state from l""")
def delisting_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.delisting_boundaries(v.bars(spark, sf_dir), registry(spark, sf_dir))


@query("members_after_delisting", BOTH + """, m as (select distinct c.datetime, s.instrument from cal c join spans s on c.datetime between s.start and s."end")
select m.datetime, count(*) as names, count(*) filter (where r.delist_date < m.datetime) as gone from m left join reg r on r.instrument = m.instrument group by 1 having gone > 0""")
def members_after_delisting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.members_after_delisting(days(spark, sf_dir), spans(spark, sf_dir), registry(spark, sf_dir))


@query("window_leaks", LATE + """, w as (select datetime, instrument, count(close) over (partition by instrument order by datetime rows between 4 preceding and current row) as n from dense)
select w.instrument, k.delist_date, count(*) as n_leaks from w join k on k.instrument = w.instrument and w.datetime > k.delist_date where w.n = 5 group by 1, 2""")
def window_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.window_leaks(v.dense(spark, sf_dir), registry(spark, sf_dir), 5)


@query("closes_around", REGISTRY + " select r.instrument, r.delist_date as day, count(b.datetime) as n_closes, count(b.datetime) >= 6 as enough from reg r left join bars b on b.instrument = r.instrument and b.datetime between r.delist_date - 20 and r.delist_date + 20 group by 1, 2")
def closes_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.closes_around(v.bars(spark, sf_dir), registry(spark, sf_dir).select("instrument", F.col("delist_date").alias("day")), 20, 6)


@query("membership_cases", BOTH + """, c as (select distinct instrument, delist_date as day, case cast(substr(instrument, 2) as int) % 5 when 0 then 'join' when 1 then 'enter' when 2 then 'enter' else 'leave' end as action from reg),
r as (select instrument, start, case when "end" < date '2099-12-31' then "end" end as b from spans),
e as (select c.instrument, c.action, c.day, case c.action when 'enter' then r.start when 'leave' then r.b end as edge, r.instrument as ri from c left join r on r.instrument = c.instrument),
w as (select instrument, action, day, count(ri) as n, arg_min(edge, row(abs(edge - day), edge)) as nearest, min(abs(edge - day)) as gap from e group by all)
select 'A' as index_code, instrument, action, day, nearest, gap, case when n = 0 then 'no run' when action = 'join' then 'unknown action' when gap is null then 'still a member' when gap <= 300 then 'match' else 'too far' end as verdict from w""")
def membership_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("instrument", 2, 2).cast("int") % 5
    action = F.when(n == 0, "join").when(n <= 2, "enter").otherwise("leave")
    cases = registry(spark, sf_dir).select(F.lit("A").alias("index_code"), "instrument", action.alias("action"), F.col("delist_date").alias("day"))
    return validation.membership_cases(spans(spark, sf_dir).withColumn("index_code", F.lit("A")), cases, 300)


@query("aligned_panel", """+ own as (select * from bars where datetime >= date '1993-01-04' + 21 * cast(substr(instrument, 2) as int)), f as (select instrument, min(datetime) as first from own group by 1),
g as (select c.datetime, f.instrument, c.idx, min(c.idx) over (partition by f.instrument) as start_index from f join cal c on c.datetime >= f.first)
select g.datetime, g.instrument, g.start_index, own.close, own.volume, cast(null as double) as pe from g left join own on own.instrument = g.instrument and own.datetime = g.datetime""")
def aligned_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = v.bars(spark, sf_dir).where(F.col("datetime") >= F.date_add(F.to_date(F.lit("1993-01-04")), 21 * F.substring("instrument", 2, 2).cast("int")))
    return panel.aligned(late.select("datetime", "instrument", "close", "volume"), days(spark, sf_dir), ("close", "volume", "pe"))


@query("registry_defects", REGISTRY + """, r as (select instrument, date '1999-01-01' + 50 * cast(substr(instrument, 2) as int) as list_date, delist_date from reg), t as (select * from r union all select * from r where cast(substr(instrument, 2) as int) % 2 = 0)
select distinct instrument, 'order' as why from t where delist_date < list_date union all select instrument, 'duplicate' from t group by 1 having count(*) > 1""")
def registry_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("instrument", 2, 2).cast("int")
    rows = registry(spark, sf_dir).select("instrument", F.date_add(F.to_date(F.lit("1999-01-01")), 50 * n).alias("list_date"), "delist_date")
    return validation.registry_defects(rows.union(rows.where(n % 2 == 0)))


@query("calendar_defects", """+ d as (select distinct cast(o_orderdate as date) as d from orders), t as (select d, case when day(d) = 31 then '2000013' else strftime(d, '%Y%m%d') end as c, case when day(d) = 15 then 2 else cast(dayofweek(d) between 1 and 5 as int) end as o from d union all select d, strftime(d, '%Y%m%d'), 1 from d where day(d) = 1)
select count(*) as rows, count(*) filter (where day(d) = 31) as bad_dates, count(*) filter (where day(d) = 1) // 2 as repeats, count(*) filter (where o not in (0, 1)) as bad_flags,
(max(d) filter (where day(d) <> 31) - min(d) filter (where day(d) <> 31)) + 1 - count(distinct d) filter (where day(d) <> 31) as missing_days, count(*) filter (where o = 1) as open_days from t""")
def calendar_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("d")).distinct()
    text = F.date_format("d", "yyyyMMdd")
    rows = d.select(F.when(F.dayofmonth("d") == 31, "2000013").otherwise(text).alias("cal_date"), F.when(F.dayofmonth("d") == 15, 2).otherwise(F.dayofweek("d").between(2, 6).cast("int")).alias("is_open"))
    return validation.calendar_defects(rows.union(d.where(F.dayofmonth("d") == 1).select(text, F.lit(1))))


@query("short_embargoes", """+ w as (select cast(q as varchar) as name, q as start, q + 80 as e from (select distinct cast(date_trunc('quarter', datetime) as date) as q from bars)), p as (select *, lag(e) over (order by start) as b from w)
select p.name, p.start, count(c.datetime) as gap from p left join cal c on c.datetime > p.b and c.datetime < p.start where p.b is not null group by 1, 2 having count(c.datetime) < 2""")
def short_embargoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir)
    q = d.select(F.trunc("datetime", "quarter").alias("start")).distinct()
    return validation.short_embargoes(q.select(F.col("start").cast("string").alias("name"), "start", F.date_add("start", 80).alias("end")), d, 2)


@query("score_contract", "select count(distinct datetime) as dates, count(*) - count(distinct instrument) as repeats, count(*) filter (where score is null) as no_number, count(*) filter (where datetime > date '2001-06-01') as after from predictions where datetime >= date '2001-01-01'")
def score_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.score_contract(v.predictions(spark, sf_dir).where("datetime >= date'2001-01-01'"), F.to_date(F.lit("2001-06-01")))


@query("late_evidence", ST + """, e as (select code, period, available_from, max(available_from) over (partition by code order by period rows between 1 preceding and 1 preceding) as b from rec where available_from is not null) select code, period, available_from from e where b > available_from""")
def late_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = record(spark, sf_dir).where("available_from is not null")
    return validation.out_of_order(known, "code", "period", "available_from").select("code", "period", "available_from")
