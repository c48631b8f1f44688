"""Financial statements: versions, availability, as-of panels.

Raw rows: (code, end_date, ann_date, f_ann_date, update_flag, batch, values ...). A row becomes known on the first
trading day after its announcement. Revisions stay beside originals until a step below picks one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators.panel import next_day, on_days

KEY = ("code", "period")


def contract(raw: DataFrame, days: DataFrame) -> DataFrame:
    """Adds period, announced, announced_from (which column) and available_from; rows without a period go."""
    out = raw.withColumn("period", F.col("end_date")).where("period is not null").drop("end_date")
    out = out.withColumn("d", F.coalesce("f_ann_date", "ann_date"))
    out = out.withColumn("announced_from", F.when(F.col("f_ann_date").isNotNull(), "f_ann_date").when(F.col("ann_date").isNotNull(), "ann_date"))
    return next_day(out, days).withColumnRenamed("next", "available_from").withColumnRenamed("d", "announced").drop("ann_date", "f_ann_date")


def first_of(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def current_version(rows: DataFrame) -> DataFrame:
    """Of each (code, period, flag, announcement) the row of the latest fetch batch."""
    return first_of(rows, (*KEY, "update_flag", "announced"), F.desc("batch"))


def version_record(rows: DataFrame) -> DataFrame:
    """Of each (code, period, flag) the row announced first; undated ones last."""
    return first_of(current_version(rows), (*KEY, "update_flag"), F.asc_nulls_last("announced"), F.asc_nulls_last("available_from"))


def of_record(rows: DataFrame) -> DataFrame:
    """Of each (code, period) the original, or the revision where there is no original."""
    return first_of(version_record(rows), KEY, F.col("update_flag"))


def served_spans(record: DataFrame, *values: str) -> DataFrame:
    """(code, from, to, period, values): which period is served from when until the day before `to`.

    Of what is available the latest period is served, not the latest arrival, so a late old report never wins.
    One window per code; rows that never win make no span.
    """
    by_day = Window.partitionBy("code").orderBy("available_from", "period")
    known = record.where("available_from is not null").withColumn("_best", F.max("period").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    won = known.where(F.col("period") == F.col("_best"))
    won = won.withColumn("to", F.lead("available_from").over(by_day)).where("to is null or to > available_from")
    return won.select("code", F.col("available_from").alias("from"), "to", "period", *values)


def as_of_panel(record: DataFrame, days: DataFrame, *values: str) -> DataFrame:
    """(datetime, code, period, values): what is served on each trading day. The calendar is small and broadcast."""
    last = F.coalesce(F.date_sub("to", 1), F.to_date(F.lit("9999-12-31")))
    return on_days(served_spans(record, *values), days, F.col("from"), last).select("datetime", "code", "period", *values)


def with_period(panel: DataFrame, record: DataFrame, period: Column, value: str, name: str) -> DataFrame:
    """panel with the value of the given period, where that was available on the day; else NULL."""
    r = record.where("available_from is not null").select(F.col("code").alias("_c"), F.col("period").alias("_p"), F.col("available_from").alias("_a"), F.col(value).alias(name))
    return panel.join(r, (panel["code"] == r["_c"]) & (period == r["_p"]) & (r["_a"] <= panel["datetime"]), "left").drop("_c", "_p", "_a")


def revision_link(rows: DataFrame, hash_of: Column) -> DataFrame:
    """Revisions with the hash of the original of the same (code, period), NULL where there is none: of several, the latest batch."""
    h = rows.withColumn("_h", hash_of)
    links = h.where("update_flag = 0").groupBy(*KEY).agg(F.max_by("_h", "batch").alias("original_hash"))
    return rows.where("update_flag = 1").join(links, list(KEY), "left")


def version_differences(versions: DataFrame, *fields: str) -> DataFrame:
    """(field, compared, differing) between original and revision of the same (code, period)."""
    one = [F.max(F.when(F.col("update_flag") == k, F.struct(*fields))).alias(f"_v{k}") for k in (0, 1)]
    both = versions.groupBy(*KEY).agg(*one).where("_v0 is not null and _v1 is not null")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (~F.col(f"_v0.{c}").eqNullSafe(F.col(f"_v1.{c}"))).alias("differs")) for c in fields]))
    return both.select(cells.alias("x")).groupBy("x.field").agg(F.count(F.lit(1)).alias("compared"), F.count_if("x.differs").alias("differing"))


def residuals(versions: DataFrame, universe: DataFrame, *fields: str, source: str = "source") -> DataFrame:
    """(source, field, compared, differing, without_file) of versions of several sources (source, code, period, update_flag, fields) at once:
    how many cells differ between original and revision, and how many names of the universe (code) a source has no row of."""
    one = [F.max(F.when(F.col("update_flag") == k, F.struct(*fields))).alias(f"_v{k}") for k in (0, 1)]
    both = versions.groupBy(source, *KEY).agg(*one)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.when(F.col("_v0").isNotNull() & F.col("_v1").isNotNull(), ~F.col(f"_v0.{c}").eqNullSafe(F.col(f"_v1.{c}"))).alias("differs")) for c in fields]))
    out = both.select(source, cells.alias("x")).groupBy(source, "x.field").agg(F.count("x.differs").alias("compared"), F.count_if(F.coalesce("x.differs", F.lit(False))).alias("differing"))
    names = universe.select("code").distinct()
    had = versions.select(source, "code").distinct().join(names, "code", "left_semi").groupBy(source).agg(F.count(F.lit(1)).alias("_had"))
    return out.join(had, source, "left").join(F.broadcast(names.agg(F.count(F.lit(1)).alias("_all"))), how="cross").select(source, "field", "compared", "differing", (F.col("_all") - F.coalesce("_had", F.lit(0))).alias("without_file"))


def contract_frame(raw: DataFrame, days: DataFrame, hash_of: Column) -> DataFrame:
    """contract() with original_hash: in revisions the hash of the original of the same (code, period), NULL where there is none and in originals."""
    rows = contract(raw, days)
    links = rows.withColumn("_h", hash_of).where("update_flag = 0").groupBy(*KEY).agg(F.max_by("_h", "batch").alias("_original"))
    return rows.join(links, list(KEY), "left").withColumn("original_hash", F.when(F.col("update_flag") == 1, F.col("_original"))).drop("_original")


def new_versions(batch: DataFrame, stored: DataFrame, hash_of: Column) -> DataFrame:
    """Rows of the batch whose content differs from the latest stored one of their (code, period, flag), or is new: column `state`."""
    keys = [*KEY, "update_flag"]
    latest = stored.withColumn("_h", hash_of).groupBy(*keys).agg(F.max_by("_h", "batch").alias("_stored"))
    out = batch.withColumn("_h", hash_of).join(latest, keys, "left").where(~F.col("_h").eqNullSafe(F.col("_stored")))
    return out.withColumn("state", F.when(F.col("_stored").isNull(), "new").otherwise("changed")).drop("_h", "_stored")


def name_spans(history: DataFrame, risky: Column) -> DataFrame:
    """(code, start, next, is_risk, name): a step function of names; of several on one day a risk name wins, then the last by text."""
    day = history.withColumn("is_risk", risky).groupBy("code", F.col("start_date").alias("start")).agg(F.max(F.struct("is_risk", "name")).alias("x"))
    return day.select("code", "start", F.lead("start").over(Window.partitionBy("code").orderBy("start")).alias("next"), "x.is_risk", "x.name")


def named_at(dates: DataFrame, spans: DataFrame) -> DataFrame:
    """dates (datetime, code) with the name and risk flag that hold on the day; NULL before the first."""
    s = spans.select(F.col("code").alias("_c"), "start", "next", "is_risk", "name")
    on = (dates["code"] == s["_c"]) & (s["start"] <= dates["datetime"]) & (s["next"].isNull() | (dates["datetime"] < s["next"]))
    return dates.join(s, on, "left").drop("_c", "start", "next")


def profit_over_equity() -> Column:
    """Operating profit after financing over equity; NULL where an input is or equity is not positive."""
    c = F.col
    return (c("revenue") - c("oper_cost") - c("sell_exp") - c("admin_exp") - c("fin_exp")) / F.when(c("equity") > 0, c("equity"))


def cash_profit_over_assets() -> Column:
    """Operating profit less the change of what it left uncollected, over assets; each `x` beside `x_prior`, the quarter before.

    Advance receipts and contract liabilities are one input under two names, merged for each quarter before the change is taken."""
    c = F.col
    change = {x: c(x) - c(f"{x}_prior") for x in ("receivables", "inventories", "prepayments", "payables")}
    owed = F.coalesce("advances", "contract_liabilities") - F.coalesce("advances_prior", "contract_liabilities_prior")
    earned = c("revenue") - c("oper_cost") - c("sell_exp") - c("admin_exp")
    return (earned - change["receivables"] - change["inventories"] - change["prepayments"] + change["payables"] + owed) / F.when(c("total_assets") > 0, c("total_assets"))


def misaligned(periods: Sequence[str]) -> Column:
    """Whether all sources have served a period, and not the same."""
    return F.forall(F.array(*periods), lambda x: x.isNotNull()) & (F.size(F.array_distinct(F.array(*periods))) > 1)


def aligned(panel: DataFrame, fields: Mapping[str, str], prior: Mapping[str, str] | None = None) -> DataFrame:
    """panel with the fields NULL in rows whose periods are not proven to agree. fields: value column to its period column;
    prior: of values of the quarter before, whose period must be the quarter before the common one."""
    periods = [F.col(p) for p in sorted(set(fields.values()))]
    same = periods[0].isNotNull()
    for p in periods[1:]:
        same = same & p.eqNullSafe(periods[0])
    for p in sorted(set((prior or {}).values())):
        same = same & F.coalesce(F.col(p) == F.last_day(F.add_months(periods[0], -3)), F.lit(False))
    return panel.withColumns({c: F.when(same, F.col(c)) for c in [*fields, *(prior or {})]})


def panel_defects(panel: DataFrame, record: DataFrame) -> DataFrame:
    """Rows of an as-of panel that break what it promises, with `defect`: found twice, a period that ends after the day, or one that was not available."""
    n = F.count(F.lit(1)).over(Window.partitionBy("datetime", "code"))
    known = record.groupBy(F.col("code").alias("_c"), F.col("period").alias("_p")).agg(F.min("available_from").alias("_a"))
    rows = panel.withColumn("_n", n).join(known, (F.col("code") == F.col("_c")) & (F.col("period") == F.col("_p")), "left")
    defect = F.when(F.col("_n") > 1, "twice").when(F.col("period") > F.col("datetime"), "after the day").when(F.col("_a").isNull() | (F.col("_a") > F.col("datetime")), "not available")
    return rows.withColumn("defect", defect).where("defect is not null").select("datetime", "code", "period", "defect")


def exclusion_conflicts(record: DataFrame, financial: DataFrame) -> DataFrame:
    """(code, conflict): financial issuers that report an operating cost, and others that never do. financial: (code)."""
    seen = record.groupBy("code").agg(F.max(F.col("oper_cost").isNotNull()).alias("reports")).join(financial.select("code", F.lit(True).alias("_f")).distinct(), "code", "left")
    conflict = F.when(F.col("_f") & F.col("reports"), "financial with cost").when(F.col("_f").isNull() & ~F.col("reports"), "never reports cost")
    return seen.withColumn("conflict", conflict).where("conflict is not null").select("code", "conflict")


def exclusion_counts(stocks: DataFrame, excluded: DataFrame) -> DataFrame:
    """(industry, n_names, n_excluded) of industries with excluded names."""
    out = stocks.join(excluded.select("instrument", F.lit(1).alias("_x")).distinct(), "instrument", "left").groupBy("industry").agg(F.count(F.lit(1)).alias("n_names"), F.count("_x").alias("n_excluded"))
    return out.where("n_excluded > 0")
