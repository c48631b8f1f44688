"""Queries over statements and names, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import codes
from strandline.operators import panel, statements
from strandline.plans import testviews as v
from strandline.plans.registry import query

ST = """+ raw as (select o_custkey % 40 as code, cast(date_trunc('quarter', o_orderdate) + interval 3 month - interval 1 day as date) as period,
  cast(o_orderdate as date) + cast(o_orderkey % 60 as int) as ann, case when o_orderkey % 5 <> 0 then cast(o_orderdate as date) + cast(o_orderkey % 90 as int) end as f_ann,
  o_orderkey % 2 as update_flag, concat(o_orderpriority, lpad(cast(o_orderkey as varchar), 9, '0')) as batch, o_totalprice as revenue, o_totalprice * 0.6 as oper_cost, o_totalprice * 5 as total_assets from orders),
st as (select *, coalesce(f_ann, ann) as announced, case when f_ann is not null then 'f_ann_date' else 'ann_date' end as announced_from, (select min(c.datetime) from cal c where c.datetime > coalesce(f_ann, ann)) as available_from from raw),
cur as (select * from st qualify row_number() over (partition by code, period, update_flag, announced order by batch desc) = 1),
ver as (select * from cur qualify row_number() over (partition by code, period, update_flag order by announced nulls last, available_from nulls last) = 1),
rec as (select * from ver qualify row_number() over (partition by code, period order by update_flag) = 1),
served as (select c.datetime, r.code, max(r.period) as period, arg_max(r.revenue, r.period) as revenue, arg_max(r.oper_cost, r.period) as oper_cost, arg_max(r.total_assets, r.period) as total_assets
  from cal c join rec r on r.available_from <= c.datetime group by c.datetime, r.code)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    return o.select(
        (F.col("o_custkey") % 40).alias("code"), codes.quarter_end(day).alias("end_date"), F.date_add(day, (key % 60).cast("int")).alias("ann_date"),
        F.when(key % 5 != 0, F.date_add(day, (key % 90).cast("int"))).alias("f_ann_date"), (key % 2).alias("update_flag"), F.concat("o_orderpriority", F.lpad(key.cast("string"), 9, "0")).alias("batch"),
        F.col("o_totalprice").alias("revenue"), (F.col("o_totalprice") * 0.6).alias("oper_cost"), (F.col("o_totalprice") * 5).alias("total_assets"),
    )


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.calendar(v.bars(spark, sf_dir))


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.contract(raw(spark, sf_dir), days(spark, sf_dir))


def record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.of_record(contract(spark, sf_dir))


@query("statement_contract", ST + " select code, period, update_flag, batch, announced, announced_from, available_from from st")
def statement_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract(spark, sf_dir).select("code", "period", "update_flag", "batch", "announced", "announced_from", "available_from")


@query("statement_current_version", ST + " select code, period, update_flag, announced, batch from cur")
def statement_current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.current_version(contract(spark, sf_dir)).select("code", "period", "update_flag", "announced", "batch")


@query("statement_version_record", ST + " select code, period, update_flag, announced, batch from ver")
def statement_version_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.version_record(contract(spark, sf_dir)).select("code", "period", "update_flag", "announced", "batch")


@query("statement_of_record", ST + " select code, period, update_flag, available_from, revenue from rec")
def statement_of_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record(spark, sf_dir).select("code", "period", "update_flag", "available_from", "revenue")


@query("statement_as_of", ST + " select datetime, code, period, revenue from served")
def statement_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.as_of_panel(record(spark, sf_dir), days(spark, sf_dir), "revenue")


@query("statement_profitability", ST + " select datetime, code, round(case when total_assets > 0 then (revenue - oper_cost) / total_assets end, 6) as gross_profit_to_assets from served")
def statement_profitability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statements.as_of_panel(record(spark, sf_dir), days(spark, sf_dir), "revenue", "oper_cost", "total_assets")
    return out.select("datetime", "code", F.round(F.when(F.col("total_assets") > 0, (F.col("revenue") - F.col("oper_cost")) / F.col("total_assets")), 6).alias("gross_profit_to_assets"))


@query("statement_prior_quarter", ST + """ select s.datetime, s.code, s.period, s.revenue, r.revenue as prior_revenue from served s
left join rec r on r.code = s.code and r.period = cast(date_trunc('quarter', s.period) - interval 1 day as date) and r.available_from <= s.datetime""")
def statement_prior_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = record(spark, sf_dir)
    out = statements.as_of_panel(rec, days(spark, sf_dir), "revenue")
    return statements.with_period(out, rec, codes.previous_quarter_end(F.col("period")), "revenue", "prior_revenue")


@query("statement_version_differences", ST + """, p as (select a.revenue as r0, b.revenue as r1, a.announced as a0, b.announced as a1 from ver a join ver b on a.code = b.code and a.period = b.period and a.update_flag = 0 and b.update_flag = 1)
select 'revenue' as field, count(*) as compared, count(*) filter (where r0 is distinct from r1) as differing from p union all select 'announced', count(*), count(*) filter (where a0 is distinct from a1) from p""")
def statement_version_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.version_differences(statements.version_record(contract(spark, sf_dir)), "revenue", "announced")


HASH = "sha256(concat('period=', cast(st.period as varchar), chr(31), 'revenue=', cast(cast(round(st.revenue * 100) as bigint) as varchar)))"


def hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.sha2(F.concat_ws("\x1f", F.concat(F.lit("period="), F.col("period").cast("string")), F.concat(F.lit("revenue="), F.round(F.col("revenue") * 100).cast("long").cast("string"))), 256))


@query("statement_revision_link", ST + f", o as (select code, period, arg_max({HASH}, batch) as original_hash from st where update_flag = 0 group by all) select st.code, st.period, st.batch, o.original_hash from st left join o on o.code = st.code and o.period = st.period where st.update_flag = 1")
def statement_revision_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.revision_link(hashed(contract(spark, sf_dir)), F.col("h")).select("code", "period", "batch", "original_hash")


@query("statement_new_versions", ST + f""", old as (select code, period, update_flag, arg_max({HASH}, batch) as h from st where announced < date '1999-01-01' group by all)
select st.code, st.period, st.update_flag, st.batch, case when old.h is null then 'new' else 'changed' end as state from st left join old on old.code = st.code and old.period = st.period and old.update_flag = st.update_flag
where st.announced >= date '1998-01-01' and {HASH} is distinct from old.h""")
def statement_new_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed(contract(spark, sf_dir))
    out = statements.new_versions(rows.where("announced >= date'1998-01-01'"), rows.where("announced < date'1999-01-01'"), F.col("h"))
    return out.select("code", "period", "update_flag", "batch", "state")


@query("statement_period_coverage", ST + """, u as (select distinct code from st) select year(c.datetime) as year, cast(count(*) as bigint) as cells, count(s.revenue) as served, round(count(s.revenue) / count(*), 6) as coverage
from cal c cross join u left join served s on s.datetime = c.datetime and s.code = u.code group by 1""")
def statement_period_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = days(spark, sf_dir)
    rows = contract(spark, sf_dir)
    grid = rows.select("code").distinct().crossJoin(F.broadcast(calendar.select("datetime")))
    served = statements.as_of_panel(statements.of_record(rows), calendar, "revenue")
    out = grid.join(served, ["datetime", "code"], "left").groupBy(F.year("datetime").cast("long").alias("year"))
    return out.agg(F.count(F.lit(1)).alias("cells"), F.count("revenue").alias("served"), F.round(F.count("revenue") / F.count(F.lit(1)), 6).alias("coverage"))


NAMES = """+ hist as (select distinct o_custkey % 40 as code, cast(o_orderdate as date) as start, o_orderstatus = 'F' as is_risk, case when o_orderstatus = 'F' then '*ST X' else 'X' end as name from orders),
day as (select code, start, max(is_risk) as is_risk, arg_max(name, row(is_risk, name)) as name from hist group by all),
spans as (select code, start, lead(start) over (partition by code order by start) as next, is_risk, name from day)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    history = o.select((F.col("o_custkey") % 40).alias("code"), F.to_date("o_orderdate").alias("start_date"), F.when(F.col("o_orderstatus") == "F", "*ST X").otherwise("X").alias("name"))
    return statements.name_spans(history.dropDuplicates(), codes.is_risk_name(F.col("name")))


@query("name_spans", NAMES + " select code, start, next, is_risk, name from spans")
def name_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir)


@query("name_as_of", NAMES + ", u as (select distinct code from hist) select c.datetime, u.code, s.is_risk, s.name from cal c cross join u left join spans s on s.code = u.code and s.start <= c.datetime and (s.next is null or c.datetime < s.next)")
def name_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    dates = s.select("code").distinct().crossJoin(F.broadcast(days(spark, sf_dir).select("datetime")))
    return statements.named_at(dates, s).select("datetime", "code", "is_risk", "name")


@query("weekdays_to_quarter_end", "select o_orderkey, (select count(*) from range(cast(o_orderdate as date), date_trunc('quarter', o_orderdate) + interval 3 month - interval 1 day, interval 1 day) t(d) where dayofweek(d) between 1 and 5) as weekdays from orders")
def weekdays_to_quarter_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", codes.weekdays_between(day, codes.quarter_end(day)).alias("weekdays"))


@query("journal_effective", """select user_id, day, decided_at, action from (select user_id, cast(ts as date) as day, ts as decided_at, event_type as action, row_number() over (partition by user_id, cast(ts as date) order by ts desc, event_id desc) as n from events) where n = 1""")
def journal_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.to_date("ts").alias("day"), F.col("ts").alias("decided_at"), F.col("event_type").alias("action"), "event_id")
    return statements.first_of(t, ("user_id", "day"), F.desc("decided_at"), F.desc("event_id")).drop("event_id")
