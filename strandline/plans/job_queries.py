"""Queries over whole jobs: vendor files to a panel, the analysis of factors, the daily list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import codes
from strandline.operators import analysis, daily, ingest, panel, statements
from strandline.plans import testviews as v
from strandline.plans.queries import REGISTRY, registry
from strandline.plans.registry import off_ties, query
from strandline.plans.selection_queries import RANK_CORR, ranked
from strandline.plans.signal_queries import FACTORS, IC, columns
from strandline.sources import vendor
from strandline.sources.shared import kept_table, new_path

DAY = "yyyyMMdd"


def vendor_files(spark: SparkSession, bars: DataFrame) -> str:
    """Bars, factors and daily fields as vendor files of two folders, where the second repeats days of the first, and so does the first itself."""
    root = new_path(spark, "vendor")
    b = panel.densify(bars, panel.calendar(bars)).withColumns({"n": F.substring("instrument", 2, 2).cast("int"), "ts_code": F.concat(F.lit("6000"), F.substring("instrument", 2, 2), F.lit(".SH")), "trade_date": F.date_format("datetime", DAY)})
    first, again = F.lit(1.0), F.lit(3.0)

    def put(rows: DataFrame, table: str) -> None:
        """The columns after `turn`, in the order of turn within a name's day; a folder for each part."""
        for part in ("a", "b"):
            rows.where(F.col("part") == part).repartition("ts_code").sortWithinPartitions("ts_code", "trade_date", "turn").drop("part", "turn").write.parquet(f"{root}/{table}/{part}/rows.parquet")

    turns = F.explode(F.array(
        F.struct(F.lit("a").alias("part"), F.lit(0).alias("turn"), first.alias("times")), F.struct(F.when(F.col("n") % 10 == 5, "a").alias("part"), F.lit(1).alias("turn"), again.alias("times")),
        F.struct(F.when(F.col("n") % 4 == 1, "b").alias("part"), F.lit(0).alias("turn"), again.alias("times")),
    ))
    all_turns = b.withColumn("t", turns).select("*", "t.part", "t.turn", "t.times").where("part is not null")
    put(all_turns.where("close is not null").select("part", "turn", "ts_code", "trade_date", *[(F.col(c) * F.col("times")).alias(c) for c in ("open", "high", "low", "close")], (F.col("volume") * F.col("times")).alias("vol"), F.col("money").alias("amount")), "daily")
    factor = F.when((F.col("n") + F.col("idx")) % 13 == 0, (1 + F.col("n") / 100.0) * F.col("times"))
    put(all_turns.where((F.col("n") + F.col("idx")) % 13 == 0).select("part", "turn", "ts_code", "trade_date", factor.alias("adj_factor")), "adj_factor")
    put(all_turns.where("n % 3 = 0 and close is not null").select("part", "turn", "ts_code", "trade_date", F.when(F.col("volume") > 50, F.col("volume") * F.col("times")).alias("pe")), "daily_basic")
    return root


@query("panel_from_files", REGISTRY + """, a as (select d.*, case when cast(substr(d.instrument, 2) as int) % 3 = 0 and d.close is not null and d.volume > 50 then d.volume end as pe, case when (cast(substr(d.instrument, 2) as int) + d.idx) % 13 = 0 then 1 + cast(substr(d.instrument, 2) as int) / 100.0 end as fct from dense d),
b as (select *, coalesce(last_value(fct ignore nulls) over w, 1.0) as f, count(close) over w as seen from a window w as (partition by instrument order by datetime rows between unbounded preceding and current row))
select b.datetime, concat('SH6000', substr(b.instrument, 2, 2)) as instrument, round(close * f + 1e-9, 6) as close, round(low * f + 1e-9, 6) as low, volume * 100 as volume, round(money * 1000, 2) as money, pe, cast(null as double) as pb from b left join reg r on r.instrument = b.instrument where seen > 0 and (r.delist_date is null or b.datetime <= r.delist_date)""")
def panel_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Files and registry come from the same bars, which are written once: they are far smaller than the rows they come from.
    bars = kept_table(v.bars(spark, sf_dir), new_path(spark, "vendor-bars"))
    root = vendor_files(spark, bars)
    gone = registry(spark, sf_dir, bars).withColumn("instrument", F.concat(F.lit("SH6000"), F.substring("instrument", 2, 2)))
    out = ingest.build_panel(vendor.read_bars(spark, root), vendor.read_factors(spark, root), vendor.read_basics(spark, root), gone, ("pe", "pb"))
    return out.select("datetime", "instrument", off_ties(F.col("close")).alias("close"), off_ties(F.col("low")).alias("low"), "volume", F.round("money", 2).alias("money"), "pe", "pb")


#: The two factors of the largest absolute information, then their decay and correlation, in one table of results.
ANALYSIS = FACTORS.replace("lead(close, 2) over wi / lead(close, 1) over wi - 1 as ret", "lead(close, 1) over wi / close - 1 as ret") + IC + f""", su as (select factor, count(ic) as days, avg(ic) as m, stddev_samp(ic) as s, avg(case when ic > 1e-12 then 1.0 else 0.0 end) as p from daily where ic is not null group by factor),
pl as (select *, row_number() over (order by abs(m) desc, factor) as place from su), best as (select factor from pl where place <= 2),
rl as (select datetime, instrument, unnest([1, 2, 3]) as lag, unnest([lead(close, 1) over wi / close - 1, lead(close, 2) over wi / close - 1, lead(close, 3) over wi / close - 1]) as r from dense window wi as (partition by instrument order by datetime)),
lk as (select factor, lag, datetime, {ranked("factor, lag, datetime", "value", "r")} from (select f.factor, f.datetime, f.value, l.lag, l.r from fac f join best using (factor) join rl l on l.datetime = f.datetime and l.instrument = f.instrument where f.value is not null and l.r is not null)),
ld as (select factor, lag, datetime, {RANK_CORR} as ic from lk group by all),
pp as (select x.factor as a, y.factor as b, {ranked("x.factor, y.factor", "x.value", "y.value")} from fac x join fac y on x.datetime = y.datetime and x.instrument = y.instrument and x.factor in (select factor from best) and y.factor in (select factor from best) where x.value is not null and y.value is not null)
select 'ic' as result, factor as a, cast(null as varchar) as b, cast(place as int) as k, days as n, round(m, 6) as value from pl union all select 'ir', factor, null, cast(place as int), days, round(case when s > 1e-12 then m / s end, 6) from pl union all select 'positive', factor, null, cast(place as int), days, round(p, 6) from pl
union all select 'decay', factor, null, lag, count(ic), round(avg(ic), 6) from ld where ic is not null group by factor, lag union all select 'correlation', a, b, null, count(*), round(corr(x, y), 4) from pp group by a, b"""


@query("factor_analysis", ANALYSIS)
def factor_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.factor_analysis(v.dense(spark, sf_dir), columns(), top=2, most_lag=3)
    none = F.lit(None).cast("string")
    out = None
    for name, value in (("ic", "mean_ic"), ("ir", "ir"), ("positive", "positive")):
        one = found.ic.select(F.lit(name).alias("result"), F.col("factor").alias("a"), none.alias("b"), F.col("place").alias("k"), F.col("days").alias("n"), F.round(value, 6).alias("value"))
        out = one if out is None else out.unionByName(one)
    out = out.unionByName(found.decay.select(F.lit("decay").alias("result"), F.col("factor").alias("a"), none.alias("b"), F.col("lag").alias("k"), F.col("days").alias("n"), F.round("mean_ic", 6).alias("value")))
    return out.unionByName(found.correlation.select(F.lit("correlation").alias("result"), "a", "b", F.lit(None).cast("int").alias("k"), "n", F.round("corr", 4).alias("value")))


DAILY = """+ nm as (select concat('I', lpad(cast(o_custkey % 40 as varchar), 2, '0')) as instrument, cast(o_orderdate as date) as start, max(row(case when o_orderstatus = 'F' then 1 else 0 end, case when o_orderstatus = 'F' then '*ST X' else 'X' end)) as x from orders where o_custkey % 40 < 12 group by 1, 2),
sp as (select *, lead(start) over (partition by instrument order by start) as next from nm), nx as (select datetime, lead(datetime) over (order by datetime) as entry from cal),
mv as (select *, close / lag(close) over (partition by instrument order by datetime) - 1 as move from dense),
j as (select p.datetime, nx.entry, p.instrument, p.score, s.x[2] as name, case when nx.entry is null then case when s.x[1] = 1 then 'risk name' end when d.instrument is null then 'no row' when d.volume is null or d.volume < 1 or d.close is null then 'suspended' when d.high = d.low then 'one price' when d.move is null or not d.move <= 0.098 then 'price limit' when s.x[1] = 1 then 'risk name' end as reason
  from predictions p join nx on nx.datetime = p.datetime left join mv d on d.datetime = nx.entry and d.instrument = p.instrument left join sp s on s.instrument = p.instrument and s.start <= coalesce(nx.entry, p.datetime) and (s.next is null or coalesce(nx.entry, p.datetime) < s.next)),
k as (select *, count(*) filter (reason is null) over (partition by datetime order by score desc, instrument rows between unbounded preceding and current row) as n from j)
select datetime as as_of_date, entry as entry_date, case when reason is null then cast(n as int) end as rank, instrument as stock_code, name as stock_name, round(score, 6) as predicted_score, reason is null as tradable_flag, reason as unavailable_reason from k where (reason is null and n <= 5) or (reason is not null and n < 5)"""


@query("daily_recommendations", DAILY)
def daily_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey % 40 < 12")
    history = o.select(F.concat(F.lit("I"), F.lpad((F.col("o_custkey") % 40).cast("string"), 2, "0")).alias("code"), F.to_date("o_orderdate").alias("start_date"), F.when(F.col("o_orderstatus") == "F", "*ST X").otherwise("X").alias("name"))
    spans = statements.name_spans(history, codes.is_risk_name(F.col("name")))
    out = daily.daily_recommendations(v.predictions(spark, sf_dir), v.dense(spark, sf_dir), panel.calendar(v.bars(spark, sf_dir)), spans, 5, "2001-11-05", most_age=400)
    return out.withColumn("predicted_score", F.round("predicted_score", 6))
