"""Vendor files and run results, read and written by Spark.

Vendor tables name a security by `ts_code` (600000.SH) and a day by `trade_date` (yyyyMMdd); here they are instrument
(SH600000) and datetime. A table that lacks a required column, or is empty where it must not be, is refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.codes import compact_date, to_prefixed
from strandline.operators import ingest, validation
from strandline.sources.files import SPAN, refuse
from strandline.sources.shared import kept_table, new_path

#: The vendor's daily fields.
BASICS = ("pe", "pb", "ps", "turnover_rate", "circ_mv", "total_mv")
#: Columns of a buy list.
BUY_LIST = ("as_of_date", "entry_date", "rank", "stock_code", "stock_name", "predicted_score", "tradable_flag", "unavailable_reason")


def require(df: DataFrame, columns: Sequence[str], what: str, rows: bool = True) -> DataFrame:
    """df, if it has the columns and, unless rows is False, a row."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks {missing}")
    if rows and not df.take(1):
        raise ValueError(f"{what} is empty")
    return df


def _day(column: str) -> Column:
    return compact_date(F.col(column).cast("string"))


def _yearly(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All years and names of a table kept as <table>/<year>/<code>.parquet, in one scan."""
    return spark.read.parquet(f"{root}/{table}/*/*.parquet")


#: Where a row stands in its table: the path of its file (<table>/<year>/...), then its place there. The first of repeated rows is the one to keep.
SOURCE_ORDER = "source_order"


def _placed(raw: DataFrame) -> DataFrame:
    return raw.withColumn(SOURCE_ORDER, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def read_bars(spark: SparkSession, root: str) -> DataFrame:
    """(datetime, instrument, open, high, low, close, volume, money, source_order) of the whole market, in vendor units. Repeated days are kept, for build_panel to settle by source_order."""
    raw = _placed(require(_yearly(spark, root, "daily"), ("ts_code", "trade_date", "open", "high", "low", "close", "vol", "amount"), "daily"))
    return raw.select(_day("trade_date").alias("datetime"), to_prefixed(F.col("ts_code")).alias("instrument"), *[F.col(c).cast("double") for c in ("open", "high", "low", "close")], F.col("vol").cast("double").alias("volume"), F.col("amount").cast("double").alias("money"), SOURCE_ORDER)


def _first_of_days(rows: DataFrame, fields: Sequence[Column]) -> DataFrame:
    """The fields of the first row of each day and name, NULL where that row has them so."""
    return rows.groupBy("datetime", "instrument").agg(F.min_by(F.struct(*fields), SOURCE_ORDER).alias("x")).select("datetime", "instrument", "x.*")


def read_factors(spark: SparkSession, root: str) -> DataFrame:
    """(datetime, instrument, adj_factor), of repeated days the first."""
    raw = _placed(require(_yearly(spark, root, "adj_factor"), ("ts_code", "trade_date", "adj_factor"), "adj_factor"))
    rows = raw.select(_day("trade_date").alias("datetime"), to_prefixed(F.col("ts_code")).alias("instrument"), F.col("adj_factor").cast("double"), SOURCE_ORDER)
    return _first_of_days(rows, [F.col("adj_factor")])


def read_basics(spark: SparkSession, root: str) -> DataFrame:
    """(datetime, instrument, BASICS), of repeated days the first; a field that the table has not is NULL."""
    raw = _placed(require(_yearly(spark, root, "daily_basic"), ("ts_code", "trade_date"), "daily_basic", rows=False))
    fields = [(F.col(c) if c in raw.columns else F.lit(None)).cast("double").alias(c) for c in BASICS]
    rows = raw.select(_day("trade_date").alias("datetime"), to_prefixed(F.col("ts_code")).alias("instrument"), *fields, SOURCE_ORDER)
    return _first_of_days(rows, [F.col(c) for c in BASICS])


def read_listed(spark: SparkSession, path: str, delisted: bool) -> DataFrame:
    """(instrument, list_date) of names still listed, or of those delisted, with name and delist_date."""
    raw = require(spark.read.parquet(path), ("ts_code", "name", "list_date", "delist_date") if delisted else ("ts_code", "list_date"), path)
    more = ["name", _day("delist_date").alias("delist_date")] if delisted else []
    return raw.select(to_prefixed(F.col("ts_code")).alias("instrument"), _day("list_date").alias("list_date"), *more)


def read_index_weights(spark: SparkSession, path: str) -> DataFrame:
    """(index_code, datetime, instrument) of index snapshots."""
    raw = require(spark.read.parquet(path), ("index_code", "con_code", "trade_date"), path)
    return raw.select("index_code", _day("trade_date").alias("datetime"), to_prefixed(F.col("con_code")).alias("instrument"))


def resolve_membership(spark: SparkSession, source: str, target: str, indexes: Sequence[str] | None = None, cases: DataFrame | None = None, most_days: int = 45) -> DataFrame:
    """Index snapshots to files of spans; returns (index_code, n_runs, n_names, earliest, latest), a row an index.

    Every index (or those named, each of which must have a snapshot) gets target/spans/index_code=.../ (instrument, start, end; read_spans reads such a folder) and
    target/coverage/index_code=.../, the day of its last snapshot; folders of other indexes stay as they are. cases: what
    validation.membership_cases takes, held against the runs within most_days days; a case that does not match refuses, before anything is written."""
    raw = read_index_weights(spark, source)
    refuse(raw.where("index_code is null or datetime is null or instrument is null"), "a snapshot without index, day or name")
    if indexes is not None:
        asked = spark.createDataFrame([(i,) for i in indexes], "index_code string")
        refuse(asked.join(raw.select("index_code").distinct(), "index_code", "left_anti"), "an index without snapshots")
        raw = raw.join(asked.distinct(), "index_code", "left_semi")
    runs = kept_table(ingest.membership(raw), new_path(spark, "membership"))
    if cases is not None:
        own = cases if indexes is None else cases.join(asked.distinct(), "index_code", "left_semi")
        refuse(validation.membership_cases(runs, own, most_days).where("verdict <> 'match'"), "a known case that the runs do not show")
    sorted_runs = runs.select("index_code", "instrument", "start", "end").repartitionByRange("index_code", "instrument").sortWithinPartitions("index_code", "instrument", "start")
    sorted_runs.write.partitionBy("index_code").option("partitionOverwriteMode", "dynamic").csv(f"{target}/spans", sep="\t", mode="overwrite")
    covered = runs.groupBy("index_code").agg(F.max("covered_to").cast("string").alias("last_snapshot"))
    covered.write.partitionBy("index_code").option("partitionOverwriteMode", "dynamic").json(f"{target}/coverage", mode="overwrite")
    return runs.groupBy("index_code").agg(F.count(F.lit(1)).alias("n_runs"), F.countDistinct("instrument").alias("n_names"), F.min("start").alias("earliest"), F.max("covered_to").alias("latest"))


def read_coverage(spark: SparkSession, target: str) -> DataFrame:
    """(index_code, last_snapshot) of the stamps that resolve_membership wrote; an entry that holds no day is left out."""
    stamps = spark.read.json(f"{target}/coverage", schema="index_code string, last_snapshot string")
    return stamps.select("index_code", F.try_to_timestamp("last_snapshot", F.lit("yyyy-MM-dd")).cast("date").alias("last_snapshot")).where("last_snapshot is not null")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(instrument, name, start, end, announced) of the history of names; end is NULL for the current one."""
    raw = require(spark.read.parquet(path), ("ts_code", "name", "start_date", "end_date", "ann_date"), path)
    return raw.select(to_prefixed(F.col("ts_code")).alias("instrument"), "name", _day("start_date").alias("start"), _day("end_date").alias("end"), _day("ann_date").alias("announced"))


def read_statements(spark: SparkSession, root: str, endpoint: str) -> DataFrame:
    """Raw statements of one endpoint (income, balancesheet, cashflow), kept as endpoint=<name>/...; other endpoints are pruned."""
    return require(spark.read.parquet(root), ("endpoint", "ts_code", "end_date"), root, rows=False).where(F.col("endpoint") == endpoint)


def write_statements(rows: DataFrame, path: str) -> None:
    """rows with `endpoint`, appended by endpoint and dealt by code."""
    rows.repartition("endpoint", F.pmod(F.xxhash64("ts_code"), F.lit(32))).write.partitionBy("endpoint").parquet(path, mode="append")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, names of columns trimmed and in lower case, all text trimmed; rows without any value go."""
    raw = spark.read.csv(path, header=True)
    rows = raw.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip().lower()) for c in raw.columns])
    return rows.where(F.coalesce(*[F.col(f"`{c}`") for c in rows.columns]).isNotNull())


def artifact_summary(rows: DataFrame, mode: str, reference: str | None = None) -> DataFrame:
    """One row (rows, first, last, n_dates, has_future) of an artifact of text columns. mode: trade_date (of `trade_date`), range (of
    effective_start and effective_end, without n_dates) or static (rows alone). What is no ISO day counts as a row only."""
    def iso(c: str) -> Column:
        return F.try_to_timestamp(F.trim(F.col(c)), F.lit("yyyy-MM-dd")).cast("date")

    none = F.lit(None).cast("date")
    lo, hi = {"trade_date": ("trade_date",) * 2, "range": ("effective_start", "effective_end"), "static": (None, None)}[mode]
    a, b = (none if c is None or c not in rows.columns else iso(c) for c in (lo, hi))
    n = F.count_distinct(a) if mode == "trade_date" else F.lit(0).cast("long")
    ahead = F.coalesce(F.max(b > F.to_date(F.lit(reference))), F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.min(a).alias("first"), F.max(b).alias("last"), n.alias("n_dates"), ahead.alias("has_future"))


def benchmark_summary(rows: DataFrame, reference: str | None = None) -> DataFrame:
    """One row (rows, first, last, missing, has_future) of a benchmark (date, close) of text columns; missing: share of closes that are no number."""
    day = F.try_to_timestamp(F.trim("date"), F.lit("yyyy-MM-dd")).cast("date")
    close = F.expr("try_cast(close as double)")
    bad = F.avg(F.when(close.isNull() | F.isnan(close), 1.0).otherwise(0.0))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.min(day).alias("first"), F.max(day).alias("last"), F.coalesce(bad, F.lit(0.0)).alias("missing"), F.coalesce(F.max(day > F.to_date(F.lit(reference))), F.lit(False)).alias("has_future"))


def write_registry(registry: DataFrame, path: str) -> None:
    """(instrument, delist_date, reason); a defect in a row refuses, before anything is written."""
    refuse(registry.where("defect is not null"), "registry")
    registry.drop("defect").write.parquet(path, mode="overwrite")


def write_artifact(rows: DataFrame, path: str, snapshot_date: str | None = None, day: str = "trade_date") -> None:
    """CSV in <path>/rows and a one-row JSON manifest (n_rows, first, last, snapshot_date) in <path>/manifest.

    A range (effective_start, effective_end) that ends before it starts refuses, and so does a snapshot date that is not the
    last `day` (`date` in a benchmark)."""
    if {"effective_start", "effective_end"} <= set(rows.columns):
        refuse(rows.where("effective_start > effective_end"), "a range ends before it starts")
        lo, hi = "effective_start", "effective_end"
    else:
        lo = hi = day
    manifest = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.min(lo).alias("first"), F.max(hi).alias("last")).withColumn("snapshot_date", F.lit(snapshot_date))
    if snapshot_date is not None and lo == day:
        refuse(manifest.where(~F.col("last").cast("string").eqNullSafe(F.lit(snapshot_date))), "the snapshot is not of the last day")
    rows.write.csv(f"{path}/rows", header=True, mode="overwrite")
    manifest.write.json(f"{path}/manifest", mode="overwrite")


def write_run(path: str, **tables: DataFrame) -> None:
    """Each table of a run (nav, holdings, predictions, trades, metrics ...) as Parquet in a folder of its name; empty ones keep their schema."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}", mode="overwrite")


def write_recommendations(picks: DataFrame, scored: DataFrame, path: str) -> None:
    """The buy list as CSV and JSON, and all scored names as CSV, by as_of_date. Days that are written again replace their own."""
    own = require(picks, BUY_LIST, "the buy list", rows=False).select(*BUY_LIST)
    for df, kind in ((own, "list_csv"), (own, "list_json"), (scored, "scored_csv")):
        writer = df.write.partitionBy("as_of_date").mode("overwrite").option("partitionOverwriteMode", "dynamic")
        if kind == "list_json":
            writer.json(f"{path}/{kind}")
        else:
            writer.csv(f"{path}/{kind}", header=True)


def write_pool(metrics: DataFrame, expressions: DataFrame, path: str) -> None:
    """Factor metrics (expr_hash, ...) as Parquet, expressions (expr_hash, expr) as JSON."""
    metrics.write.parquet(f"{path}/metrics", mode="overwrite")
    expressions.select("expr_hash", "expr").write.json(f"{path}/expressions", mode="overwrite")


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """Metrics with `expr`, and orientation 1 where an older pool has none; a factor without its expression refuses."""
    metrics = spark.read.parquet(f"{path}/metrics")
    expressions = spark.read.json(f"{path}/expressions", schema="expr_hash string, expr string")
    refuse(metrics.join(expressions, "expr_hash", "left_anti"), "a factor without its expression")
    out = metrics.join(expressions, "expr_hash")
    return out if "orientation" in out.columns else out.withColumn("orientation", F.lit(1))


def write_risk_audit(rows: DataFrame, path: str) -> None:
    """(date, instrument, ts_code, name) of what the risk-name mask dropped, as CSV by day and name."""
    rows.select("date", "instrument", "ts_code", "name").orderBy("date", "instrument").write.csv(path, header=True, mode="overwrite")


def sleeve_map(spans: DataFrame, coverage: DataFrame, as_of: str) -> DataFrame:
    """(instrument, sleeve) on a day, of spans (sleeve, instrument, start, end) and coverage (sleeve, covered_to).

    Refuses a day that a sleeve's coverage does not reach, a sleeve without members and an instrument in two sleeves."""
    day = F.to_date(F.lit(as_of))
    refuse(spans.select("sleeve").distinct().join(coverage, "sleeve", "left").where(F.coalesce(F.col("covered_to") < day, F.lit(True))), "beyond the coverage")
    members = spans.where(F.lit(day).between(F.col("start"), F.col("end"))).select("instrument", "sleeve").distinct()
    refuse(coverage.select("sleeve").join(members, "sleeve", "left_anti"), "a sleeve without members")
    refuse(members.groupBy("instrument").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "an instrument in two sleeves")
    return members


def read_sleeves(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(sleeve, instrument, start, end) from one span file a sleeve."""
    parts = [spark.read.csv(path, sep="\t", schema=SPAN).select(F.lit(name).alias("sleeve"), "instrument", "start", "end") for name, path in sorted(paths.items())]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out
