"""Queries over ingest, benchmarks, arms and aligned statements, each with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import codes
from strandline.operators import arms, ingest, statements
from strandline.plans import testviews as v
from strandline.plans.portfolio_queries import BENCH, POS, bench, groups, positions
from strandline.plans.queries import REGISTRY, registry
from strandline.plans.registry import off_ties, query
from strandline.plans.signal_queries import rounded
from strandline.plans.statement_queries import ST, days, record


def number() -> Column:
    return F.substring("instrument", 2, 2).cast("int")


def vendor_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, some of them found a second time with other volumes."""
    b = v.bars(spark, sf_dir)
    return b.withColumn("seq", F.lit(0)).union(b.where(number() % 10 == 5).withColumns({"volume": F.col("volume") * 2, "seq": F.lit(1)}))


@query("built_panel", REGISTRY + """, a as (select d.*, case when d.close is not null and p.score > 0.3 then p.score * 10 end as pe, case when (cast(substr(d.instrument, 2) as int) + d.idx) % 13 = 0 then 1 + cast(substr(d.instrument, 2) as int) / 100.0 end as fct
  from dense d left join predictions p on p.datetime = d.datetime and p.instrument = d.instrument),
b as (select *, coalesce(last_value(fct ignore nulls) over w, 1.0) as f, count(close) over w as seen from a window w as (partition by instrument order by datetime rows between unbounded preceding and current row))
select b.datetime, b.instrument, round(close * f + 1e-9, 6) as close, round(high * f + 1e-9, 6) as high, volume * 100 as volume, round(pe, 6) as pe, null::double as pb from b left join reg r on r.instrument = b.instrument where seen > 0 and (r.delist_date is null or b.datetime <= r.delist_date)""")
def built_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    basics = v.predictions(spark, sf_dir).where("score > 0.3").select("datetime", "instrument", (F.col("score") * 10).alias("pe"))
    d = v.dense(spark, sf_dir)
    factors = d.where((number() + F.col("idx")) % 13 == 0).select("datetime", "instrument", (1 + number() / 100.0).alias("adj_factor"))
    out = ingest.build_panel(vendor_bars(spark, sf_dir), factors, basics, registry(spark, sf_dir), ("pe", "pb"), "seq")
    return rounded(out.select("datetime", "instrument", off_ties(F.col("close")).alias("close"), off_ties(F.col("high")).alias("high"), "volume", "pe", "pb"), "pe")


@query("feature_query", REGISTRY + " select b.datetime, b.instrument, round(case when r.delist_date is null or b.datetime <= r.delist_date then b.close end + 1e-9, 6) as close, case when r.delist_date is null or b.datetime <= r.delist_date then b.volume end as volume from bars b left join reg r on r.instrument = b.instrument where b.datetime between date '1995-01-01' and date '1999-12-31' and cast(substr(b.instrument, 2) as int) % 2 = 1")
def feature_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.bars(spark, sf_dir)
    out = ingest.feature_query(b, registry(spark, sf_dir), ("close", "volume"), "1995-01-01", "1999-12-31", b.where(number() % 2 == 1).select("instrument"))
    return out.select("datetime", "instrument", off_ties(F.col("close")).alias("close"), "volume")


@query("wide_volumes", "select datetime, max(case when instrument = 'I01' then volume end) as I01, max(case when instrument = 'I07' then volume end) as I07 from bars group by datetime")
def wide_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.wide(v.bars(spark, sf_dir), "volume", ("I01", "I07"))


@query("issuers_of", POS + " select instrument from ind where grp in ('ASIA', 'EUROPE')")
def issuers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.issuers_of(groups(spark, sf_dir).withColumnRenamed("group", "industry"), ("ASIA", "EUROPE"))


@query("industry_map", """+ m as (select distinct concat('I', lpad(cast(s_suppkey % 40 as varchar), 2, '0')) as instrument, n_name as industry from supplier join nation on n_nationkey = s_nationkey where s_suppkey % 3 <> 0 and n_nationkey % 5 <> 0)
select instrument, industry, count(*) over (partition by instrument) as n from m""")
def industry_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    classes = n.select(F.col("n_nationkey").alias("index_code"), F.col("n_name").alias("industry"), F.when(F.col("n_nationkey") % 5 != 0, "L2").otherwise("L1").alias("level"))
    members = s.select(F.col("s_nationkey").alias("index_code"), F.concat(F.lit("I"), F.lpad((F.col("s_suppkey") % 40).cast("string"), 2, "0")).alias("instrument"), F.when(F.col("s_suppkey") % 3 != 0, "Y").otherwise("N").alias("is_new"))
    return ingest.industry_map(classes, members)


@query("built_registry", REGISTRY + """, d as (select instrument, case when instrument <> 'I14' then delist_date end as delist_date, cast(substr(instrument, 2) as int) % 3 as code from reg),
o as (select * from (values ('I07', date '1998-01-05', 'moved'), ('X99', date '1998-01-05', 'moved')) t(instrument, od, ore)), r as (select * from (values (0, 'merged'), (1, 'failed')) t(code, reason))
select coalesce(d.instrument, o.instrument) as instrument, coalesce(o.od, d.delist_date) as delist_date, case when o.ore is not null then o.ore else coalesce(r.reason, 'other') end as reason, case when d.instrument is null then 'unknown override' when coalesce(o.od, d.delist_date) is null then 'no date' end as defect from d left join r on r.code = d.code full join o on o.instrument = d.instrument""")
def built_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    delisted = registry(spark, sf_dir).withColumn("code", number() % 3).withColumn("delist_date", F.when(F.col("instrument") != "I14", F.col("delist_date")))
    reasons = spark.createDataFrame([(0, "merged"), (1, "failed")], "code int, reason string")
    over = spark.createDataFrame([("I07", "moved"), ("X99", "moved")], "instrument string, reason string").withColumn("delist_date", F.to_date(F.lit("1998-01-05")))
    return ingest.build_registry(delisted, reasons, over)


@query("index_membership", """+ snap as (select distinct l_returnflag as index_code, concat('I', lpad(cast(l_suppkey % 40 as varchar), 2, '0')) as instrument, cast(date_trunc('month', l_shipdate) as date) as datetime from lineitem where l_returnflag <> 'N' and l_suppkey % 40 < 25 and l_linenumber = 1),
sd as (select index_code, datetime, row_number() over (partition by index_code order by datetime) as i, max(datetime) over (partition by index_code) as covered_to from (select distinct index_code, datetime from snap)),
g as (select s.index_code, s.instrument, s.datetime, covered_to, i - row_number() over (partition by s.index_code, s.instrument order by s.datetime) as run from snap s join sd on sd.datetime = s.datetime and sd.index_code = s.index_code)
select index_code, instrument, min(datetime) as start, case when max(datetime) = max(covered_to) then date '2099-12-31' else max(datetime) end as "end", max(covered_to) as covered_to from g group by index_code, instrument, run""")
def index_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag <> 'N' and l_suppkey % 40 < 25 and l_linenumber = 1")
    return ingest.membership(t.select(F.col("l_returnflag").alias("index_code"), F.concat(F.lit("I"), F.lpad((F.col("l_suppkey") % 40).cast("string"), 2, "0")).alias("instrument"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("datetime")))


# Means of an even number of cents end in half a cent; a little off, engines round them alike.
LEVELS = "+ lv as (select cast(date_trunc('week', o_orderdate) as date) as datetime, round(avg(o_totalprice) + 1e-6, 2) as close, round(max(o_totalprice), 2) as high from orders group by 1)"


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("datetime")).agg(F.round(F.avg("o_totalprice") + 1e-6, 2).alias("close"), F.round(F.max("o_totalprice"), 2).alias("high"))


@query("benchmark_bars", LEVELS + """, x as (select lv.* from lv where day(datetime) <= 20 and datetime in (select datetime from cal))
select c.datetime, x.close as open, case when day(x.datetime) % 2 = 0 then x.high else x.close end as high, x.close as low, x.close from cal c left join x on x.datetime = c.datetime where c.datetime between (select min(datetime) from x) and (select max(datetime) from x)""")
def benchmark_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = levels(spark, sf_dir).where(F.dayofmonth("datetime") <= 20)
    none = F.lit(None).cast("double")
    rows = rows.select("datetime", none.alias("open"), F.when(F.dayofmonth("datetime") % 2 == 0, F.col("high")).alias("high"), none.alias("low"), "close")
    return ingest.benchmark_bars(rows, days(spark, sf_dir))


@query("benchmark_value_defects", LEVELS + ", x as (select case when day(datetime) = 3 then null when day(datetime) = 9 then 'nan'::double when day(datetime) = 5 then 0 else close end as c from lv) select count(*) filter (c is null or isnan(c)) as n_missing, count(*) filter (c is not null and not isnan(c) and c <= 0) as n_not_positive from x")
def benchmark_value_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("datetime")
    close = F.when(day == 9, F.lit(float("nan"))).when(day == 5, 0.0).when(day != 3, F.col("close"))
    return ingest.value_defects(levels(spark, sf_dir).withColumn("close", close))


@query("benchmark_return_deficit", LEVELS + ", b as (select datetime, close as p, high as t from lv), f as (select arg_min(p, datetime) as p0, arg_min(t, datetime) as t0, count(*) as n from b) select n, round(max(p / p0 - t / t0), 9) as worst, case when max(p / p0 - t / t0) > 0.01 then 'below price' else 'ok' end as verdict from b, f group by n")
def benchmark_return_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = levels(spark, sf_dir)
    return rounded(ingest.return_deficit(lv, lv.select("datetime", F.col("high").alias("close"))), "worst", places=9)


@query("snapshot_date", "select count(distinct strftime(l_shipdate, '%Y%m%d')) as n, 0::bigint as gaps, max(cast(l_shipdate as date)) as snapshot_date from lineitem where l_shipdate = (select max(l_shipdate) from lineitem)")
def snapshot_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.date_format("l_shipdate", "yyyyMMdd").alias("snapshot_date"))
    last = t.agg(F.max("snapshot_date").alias("_l"))
    return ingest.snapshot_date(t.join(F.broadcast(last), F.col("snapshot_date") == F.col("_l")).drop("_l"))


@query("artifact_state", LEVELS + """, x as (select datetime from lv where day(datetime) <= 20) select n_dates, n_days, round(least(1.0::double, n_dates / n_days), 6) as coverage, date_diff('day', l, date '1997-12-31') as stale_days from
(select count(distinct datetime) as n_dates, max(datetime) as l from x where datetime between date '1994-01-01' and date '1997-12-31'), (select count(*) as n_days from cal where datetime between date '1994-01-01' and date '1997-12-31')""")
def artifact_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ingest.artifact_state(levels(spark, sf_dir).where(F.dayofmonth("datetime") <= 20), days(spark, sf_dir), "1994-01-01", "1997-12-31"), "coverage")


@query("extended_days", "select o.d as datetime, coalesce((select c2.datetime from cal c2 where c2.idx = 5 + coalesce((select max(c.idx) from cal c where c.datetime <= o.d), -1)), o.d + 15) as extended from (select distinct cast(o_orderdate as date) as d from orders) o")
def extended_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("datetime")).distinct()
    return ingest.extended(ends, days(spark, sf_dir), 5)


@query("scope_days", "select b.datetime from cal a join cal b on b.idx = a.idx + 2 where a.idx % 5 = 0")
def scope_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = days(spark, sf_dir)
    return ingest.scope_days(d.where("idx % 5 = 0"), d, 2)


@query("panel_subset", "select datetime, instrument, volume from bars where instrument = 'I03' or instrument in (select instrument from predictions where score > 0.999)")
def panel_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.panel_subset(v.bars(spark, sf_dir), v.predictions(spark, sf_dir).where("score > 0.999"), ("I03",), ("volume",))


@query("fold_delistings", REGISTRY + """, f as (select year(datetime) as fold, min(datetime) as start, max(datetime) as "end" from cal group by 1), m as (select distinct year(datetime) as fold, instrument from bars)
select m.fold, r.instrument, r.delist_date from m join f on f.fold = m.fold join reg r on r.instrument = m.instrument where r.delist_date between f.start - 120 and f."end" """)
def fold_delistings(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = days(spark, sf_dir).groupBy(F.year("datetime").cast("long").alias("fold")).agg(F.min("datetime").alias("start"), F.max("datetime").alias("end"))
    members = v.bars(spark, sf_dir).select(F.year("datetime").cast("long").alias("fold"), "instrument").distinct()
    return ingest.delistings_in_folds(registry(spark, sf_dir), folds, members, 120)


@query("year_shortfalls", """+ l as (select year(datetime) as year, instrument, max(datetime) as last from bars group by 1, 2), e as (select year(datetime) as year, max(datetime) as "end" from cal group by 1)
select year, count(*) filter (last < "end") as n_short, count(*) as n_names, count(*) filter (last < "end") >= 2 and count(*) filter (last < "end") > count(*) * 0.1 as systemic from l join e using (year) group by year""")
def year_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("datetime").cast("long").alias("year")
    last = v.bars(spark, sf_dir).groupBy(year, "instrument").agg(F.max("datetime").alias("last"))
    return ingest.shortfalls(last, days(spark, sf_dir).groupBy(year).agg(F.max("datetime").alias("end")), 0.1, 2)


@query("merged_holes", """+ k as (select instrument as key, count(*) < 300 as hole, 1::bigint as attempts, min(datetime) as first, max(datetime) as last from bars where cast(substr(instrument, 2) as int) < 30 and year(datetime) < 1995 group by 1),
n as (select instrument as key, count(*) < 200 as hole, 2::bigint as attempts, min(datetime) as first, max(datetime) as last from bars where cast(substr(instrument, 2) as int) >= 10 and year(datetime) >= 1995 group by 1)
select coalesce(k.key, n.key) as key, case when n.key is not null then n.hole else k.hole end as hole, coalesce(k.attempts, 0) + coalesce(n.attempts, 0) as attempts, least(k.first, n.first) as first, greatest(k.last, n.last) as last from k full join n on n.key = k.key""")
def merged_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v.bars(spark, sf_dir)

    def manifest(rows: DataFrame, full: int, attempts: int) -> DataFrame:
        return rows.groupBy(F.col("instrument").alias("key")).agg((F.count(F.lit(1)) < full).alias("hole"), F.lit(attempts).cast("long").alias("attempts"), F.min("datetime").alias("first"), F.max("datetime").alias("last"))

    return ingest.merged_holes(manifest(b.where((number() < 30) & (F.year("datetime") < 1995)), 300, 1), manifest(b.where((number() >= 10) & (F.year("datetime") >= 1995)), 200, 2))


@query("flattened", "select l_orderkey as key, l_linenumber as \"at.line\", l_quantity as \"at.of.quantity\" from lineitem where l_orderkey % 100 = 0")
def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey % 100 = 0")
    return ingest.flattened(t.select(F.col("l_orderkey").alias("key"), F.struct(F.col("l_linenumber").alias("line"), F.struct(F.col("l_quantity").alias("quantity")).alias("of")).alias("at")))


FOLDED = POS + ", fp as (select year(datetime) as fold, * from pos)"


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).withColumn("fold", F.year("datetime").cast("long"))


TURN = """, d as (select fold, datetime, lag(datetime) over (partition by fold order by datetime) as b from (select distinct fold, datetime from fp)),
m as (select fold, datetime, instrument, weight as w from fp union all select d.fold, d.datetime, p.instrument, -p.weight from fp p join d on d.b = p.datetime and d.fold = p.fold),
n as (select fold, datetime, instrument, sum(w) as w from m group by all), t as (select n.fold, n.datetime, sum(abs(w)) / 2 as turnover from n join d on d.datetime = n.datetime and d.fold = n.fold where d.b is not null group by 1, 2)"""


@query("run_turnover", FOLDED + TURN + " select count(*) as transitions, round(avg(turnover), 6) as turnover, round(avg(turnover) * 52, 4) as annual from t")
def run_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(arms.run_turnover(folded(spark, sf_dir), 52), "turnover"), "annual", places=4)


@query("turnover_ratio", FOLDED + TURN + ", u as (select avg(turnover) as a, avg(turnover) filter (fold >= 1995) as b from t) select round(ceil(a / b * 1e9) / 1e9, 6) as ratio from u")
def turnover_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = folded(spark, sf_dir)
    return rounded(arms.turnover_ratio(arms.run_turnover(whole), arms.run_turnover(whole.where("fold >= 1995"))), "ratio")


@query("sleeve_dependence", FOLDED + """, e as (select fold, grp, sum(weight) as total from fp group by 1, 2) select count(distinct fold) as folds, round(floor(sum(total) filter (grp = 'ASIA') / sum(total) * 1e9) / 1e9, 6) as share from e""")
def sleeve_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = folded(spark, sf_dir)
    return rounded(arms.dependence(f.groupBy("fold", "group").agg(F.sum("weight").alias("total")), "ASIA", f.select("fold").distinct().count()), "share")


@query("sleeve_weights", FOLDED + """, w as (select fold, grp, sum(weight) / count(distinct datetime) as weight from fp group by 1, 2) select grp as "group", round(ceil(sum(weight) / (select count(distinct fold) from w) * 1e9) / 1e9, 6) as weight, sum(weight) / (select count(distinct fold) from w) > 0.25 as over from w group by grp""")
def sleeve_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = folded(spark, sf_dir).groupBy("fold", "group").agg((F.sum("weight") / F.count_distinct("datetime")).alias("weight"))
    return rounded(arms.sleeve_weights(w, 0.25), "weight")


@query("metric_status", "select count(*) filter (y % 3 <> 0) as n, case when count(*) filter (y % 3 <> 0) > 0 then 'official' else 'unverified' end as status from (select distinct year(datetime) as y from cal)")
def metric_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = days(spark, sf_dir).select(F.year("datetime").alias("y")).distinct()
    return arms.metric_status(y.select(F.when(F.col("y") % 3 == 0, "failed").otherwise("official").alias("status"), F.lit(True).alias("has_metrics")), False)


@query("attribution_totals", POS + BENCH + """, w as (select instrument, sum(weight) / (select sum(weight) from pos) as p from pos group by instrument), bw as (select instrument, 1.0::double / (select count(distinct instrument) from bars) as b from bars group by instrument),
r as (select instrument, arg_max(close, datetime) / arg_min(close, datetime) - 1 as ret from bars group by instrument having count(*) >= 2),
s as (select i.grp, coalesce(sum(w.p), 0) as wp, coalesce(sum(bw.b), 0) as wb, coalesce(sum(w.p * r.ret), 0) as sp, coalesce(sum(bw.b * r.ret), 0) as sb from ind i left join w on w.instrument = i.instrument left join bw on bw.instrument = i.instrument left join r on r.instrument = i.instrument group by i.grp),
x as (select grp, wp, wb, case when wp > 1e-9 then sp / wp else 0 end as rp, case when wb > 1e-9 then sb / wb else 0 end as rb, (select product(1 + ret) - 1 from bench where ret is not null) as t from s),
pr as (select datetime, avg(score) / 100 as ret from predictions group by 1),
z as (select sum((wp - wb) * (rb - t)) as a, sum(wb * (rp - rb)) as s, sum((wp - wb) * (rp - rb)) as i, max(t) as b, (select product(1 + ret) - 1 from pr) as p from x)
select round(a, 6) as allocation, round(s, 6) as selection, round(i, 6) as interaction, round(p, 6) as portfolio, round(b, 6) as benchmark, round(p - b, 6) as excess, round(a + s + i, 6) as effects, round(p - b - (a + s + i), 6) as residual from z""")
def attribution_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, scores = v.bars(spark, sf_dir), v.predictions(spark, sf_dir)
    names = bars.select("instrument").distinct()
    equal = names.withColumn("weight", F.lit(1.0) / names.count())
    returns = scores.groupBy("datetime").agg((F.avg("score") / 100).alias("ret"))
    totals = arms.attribution_job(positions(spark, sf_dir), scores, groups(spark, sf_dir), equal, bars, returns, bench(spark, sf_dir))[2]
    return rounded(totals, *totals.columns)


@query("grouping", POS + " select distinct b.instrument, coalesce(case when i.grp <> 'ASIA' then i.grp end, case when cast(substr(b.instrument, 2) as int) < 20 then 'main' else 'growth' end) as \"group\" from bars b left join ind i on i.instrument = b.instrument")
def grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms.grouping(v.bars(spark, sf_dir), groups(spark, sf_dir).where("`group` <> 'ASIA'"), F.when(number() < 20, "main").otherwise("growth"))


@query("daily_list", """+ s as (select * from predictions where cast(substr(instrument, 2) as int) % 11 <> 3), b as (select datetime, instrument from bars where high = low union select datetime, instrument from bars where volume < 20)
select datetime, instrument, round(score, 9) as score, rank from (select s.*, row_number() over (partition by s.datetime order by score desc, s.instrument) as rank from s anti join b on b.datetime = s.datetime and b.instrument = s.instrument) where rank <= 5""")
def daily_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, scores = v.bars(spark, sf_dir), v.predictions(spark, sf_dir)
    blocked = arms.blocked_rows(bars.where("high = low"), bars.where("volume < 20"))
    return rounded(arms.daily_list(scores, blocked, scores.select("instrument").distinct().where(number() % 11 == 3), 5), "score", places=9)


@query("stale_list", "select datetime, date '1997-06-30' as known_to from cal where datetime > date '1997-06-30'")
def stale_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("d")).where("d <= '1997-06-29'").select(F.to_date(F.lit("1997-06-30")).alias("ann_date"), F.col("d").alias("start_date"))
    return arms.stale_list(v.predictions(spark, sf_dir), o)


RATIOS = """+ x as (select o_orderkey as key, o_totalprice as revenue, o_totalprice * 0.6 as oper_cost, o_custkey % 7 * 100.0 as sell_exp, case when o_orderkey % 11 <> 0 then o_custkey % 5 * 90.0 end as admin_exp, o_custkey % 3 * 10.0 as fin_exp, o_custkey % 9 * 1000.0 - 1000 as equity, o_custkey % 13 * 1000.0 as total_assets,
o_custkey % 17 * 1.0 as a, o_custkey % 19 * 1.0 as b, case when o_orderkey % 4 = 0 then o_custkey % 23 * 1.0 end as adv, case when o_orderkey % 6 <> 0 then o_custkey % 29 * 1.0 end as con from orders)"""


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    a, b = (c % 17).cast("double"), (c % 19).cast("double")
    adv, con = F.when(k % 4 == 0, (c % 23).cast("double")), F.when(k % 6 != 0, (c % 29).cast("double"))
    return o.select(
        k.alias("key"), F.col("o_totalprice").alias("revenue"), (F.col("o_totalprice") * 0.6).alias("oper_cost"), (c % 7 * 100.0).alias("sell_exp"), F.when(k % 11 != 0, c % 5 * 90.0).alias("admin_exp"), (c % 3 * 10.0).alias("fin_exp"), (c % 9 * 1000.0 - 1000).alias("equity"), (c % 13 * 1000.0).alias("total_assets"),
        a.alias("receivables"), b.alias("receivables_prior"), (a * 2).alias("inventories"), b.alias("inventories_prior"), (a * 3).alias("prepayments"), b.alias("prepayments_prior"), (a * 5).alias("payables"), b.alias("payables_prior"), adv.alias("advances"), con.alias("contract_liabilities"), con.alias("advances_prior"), adv.alias("contract_liabilities_prior"),
    )


@query("profit_over_equity", RATIOS + " select key, round((revenue - oper_cost - sell_exp - admin_exp - fin_exp) / case when equity > 0 then equity end + 1e-9, 6) as c2 from x")
def profit_over_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios(spark, sf_dir).select("key", off_ties(statements.profit_over_equity()).alias("c2"))


@query("cash_profit_over_assets", RATIOS + " select key, round((revenue - oper_cost - sell_exp - admin_exp - (a - b) - (2 * a - b) - (3 * a - b) + (5 * a - b) + (coalesce(adv, con) - coalesce(con, adv))) / case when total_assets > 0 then total_assets end + 1e-9, 6) as c3 from x")
def cash_profit_over_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios(spark, sf_dir).select("key", off_ties(statements.cash_profit_over_assets()).alias("c3"))


PERIODS = """+ x as (select o_orderkey as key, last_day(cast(o_orderdate as date)) as p, case when o_custkey % 4 = 0 then null when o_custkey % 4 = 1 then last_day(cast(o_orderdate as date) + interval 3 month) else last_day(cast(o_orderdate as date)) end as q, last_day(cast(last_day(cast(o_orderdate as date)) - interval (case when o_custkey % 5 = 0 then 6 else 3 end) month as date)) as r, o_totalprice as v from orders)"""


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d = F.to_date("o_orderdate")
    p = F.last_day(d)
    q = F.when(F.col("o_custkey") % 4 == 1, F.last_day(F.add_months(d, 3))).when(F.col("o_custkey") % 4 != 0, p)
    return o.select(F.col("o_orderkey").alias("key"), p.alias("p"), q.alias("q"), F.last_day(F.add_months(p, F.when(F.col("o_custkey") % 5 == 0, -6).otherwise(-3))).alias("r"), F.col("o_totalprice").alias("v"), F.col("o_totalprice").alias("w"))


@query("misaligned_periods", PERIODS + " select key, p is not null and q is not null and p <> coalesce(q, p) as misaligned from x")
def misaligned_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods(spark, sf_dir).select("key", statements.misaligned(("p", "q")).alias("misaligned"))


@query("aligned_statements", PERIODS + " select key, case when p = q and r = last_day(cast(p - interval 3 month as date)) then v end as v, case when p = q and r = last_day(cast(p - interval 3 month as date)) then v end as w from x")
def aligned_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statements.aligned(periods(spark, sf_dir).withColumn("z", F.col("q")), {"v": "p", "z": "q"}, {"w": "r"})
    return out.select("key", "v", "w")


@query("statement_panel_defects", ST + " select datetime, code, period, 'after the day' as defect from served where period > datetime")
def statement_panel_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = record(spark, sf_dir)
    return statements.panel_defects(statements.as_of_panel(r, days(spark, sf_dir), "revenue"), r)


@query("exclusion_conflicts", ST + ", y as (select code, max(case when code % 4 <> 1 then 1 else 0 end) as reports from rec group by code) select code, case when code % 3 = 0 then 'financial with cost' else 'never reports cost' end as conflict from y where (code % 3 = 0 and reports = 1) or (code % 3 <> 0 and reports = 0)")
def exclusion_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = record(spark, sf_dir).withColumn("oper_cost", F.when(F.col("code") % 4 != 1, F.col("oper_cost")))
    return statements.exclusion_conflicts(r, r.where("code % 3 = 0").select("code"))


@query("exclusion_counts", POS + " select grp as industry, count(*) as n_names, count(*) filter (cast(substr(instrument, 2) as int) % 6 = 0) as n_excluded from ind group by grp having count(*) filter (cast(substr(instrument, 2) as int) % 6 = 0) > 0")
def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stocks = groups(spark, sf_dir).withColumnRenamed("group", "industry")
    return statements.exclusion_counts(stocks, stocks.where(number() % 6 == 0).select("instrument"))


@query("net_scores", "select datetime, instrument, round(score - 0.003, 9) as net, cast(datetime + interval 3 month as date) as review from predictions")
def net_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.predictions(spark, sf_dir).select("datetime", "instrument", F.round(codes.net_of_cost(F.col("score")), 9).alias("net"), codes.months_later(F.col("datetime"), 3).alias("review"))
