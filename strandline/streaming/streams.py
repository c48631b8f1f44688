"""Streams: journals without replays, daily bars of events, new statement versions, bars that replace their years."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from strandline.operators.statements import new_versions
from strandline.sources.shared import delete, exists

#: Parts that a statement store is dealt in by code.
BUCKETS = 64


def journal_once(journal: DataFrame, late: str = "7 days") -> DataFrame:
    """Without replays of (trade_date, code, nonce) that come within `late` of the first; state older than that goes."""
    return journal.withWatermark("decided_at", late).dropDuplicatesWithinWatermark(["trade_date", "code", "nonce"])


def day_bars(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(user_id, day, open, high, low, close, n) of (ts, user_id, value): partial bars combine before the shuffle."""
    order = F.struct("ts", "value")
    bars = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("n"))
    return bars.select("user_id", F.to_date("w.start").alias("day"), "open", "high", "low", "close", "n")


def bucket_of(code: str = "code", n: int = BUCKETS) -> Column:
    """The bucket of the statement store that a code's rows are kept in."""
    return F.pmod(F.xxhash64(code), F.lit(n)).cast("int")


def statement_sink(stream: DataFrame, store: str, hash_of: Callable[[], object]) -> DataStreamWriter:
    """Appends what differs from the store's latest row of the same (code, period, update_flag).

    The store is kept as batch_no=<number>/bucket=<bucket_of(code)>; a batch is a folder of its number, so one that is run
    again replaces itself, and reads of the store only the buckets that its codes are in (their numbers, at most BUCKETS,
    come to the driver). Of rows of a batch with one key the latest `batch` wins. The store must hold Parquet of the
    stream's columns, as batch_no=-1 or later."""
    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", bucket_of())
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        stored = spark.read.parquet(store).where((F.col("batch_no") != number) & F.col("bucket").isin(touched)).drop("batch_no")
        last = F.row_number().over(Window.partitionBy("code", "period", "update_flag").orderBy(F.desc("batch")))
        own = rows.withColumn("_n", last).where("_n = 1").drop("_n")
        new_versions(own, stored, hash_of()).drop("state").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch_no={number}")

    return stream.writeStream.foreachBatch(append)


def year_sink(stream: DataFrame, store: str, *order: str, keep: int = 2) -> DataStreamWriter:
    """Bars that replace stored rows of the same (datetime, instrument), a version of each touched year for each batch.

    order: columns that tell which of a batch's rows with one key is the last and wins (ties: the largest row). Only the years
    touched are written anew, as batch_no=<number>/year=<year>, and the newest finished version of a year is the one to read
    (`current_years`). After a batch is written, all but its `keep` newest versions of each touched year are deleted, so
    readers of the version before go on undisturbed and the store does not grow with the number of batches. A batch that
    was written before a restart is not written again: its folder has Spark's mark of success."""
    def replace(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = F.row_number().over(Window.partitionBy("datetime", "instrument").orderBy(*(F.desc_nulls_last(c) for c in order), F.desc(F.struct(*batch.columns))))
        rows = batch.withColumn("_n", place).where("_n = 1").drop("_n").withColumn("year", F.year("datetime"))
        if not exists(spark, f"{store}/batch_no={number}/_SUCCESS"):
            # The years of a batch are few, and known beforehand so that no other year is read.
            years = [r["year"] for r in batch.select(F.year("datetime").alias("year")).distinct().collect()]
            stored = spark.read.parquet(store).where((F.col("batch_no") < number) & F.col("year").isin(years))
            kept = current_years(stored).drop("batch_no").join(rows.select("datetime", "instrument"), ["datetime", "instrument"], "left_anti")
            kept.unionByName(rows).write.mode("overwrite").partitionBy("year").parquet(f"{store}/batch_no={number}")
        compact_years(spark, store, keep)

    return stream.writeStream.foreachBatch(replace)


def compact_years(spark: SparkSession, store: str, keep: int = 2) -> int:
    """Delete all but the `keep` newest versions of each year; how many went. Only the store's folders are listed, no file is read."""
    if keep < 1:
        raise ValueError("keep at least one version of a year")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/batch_no=*/year=*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    versions: dict[str, list[tuple[int, str]]] = {}
    for status in found:
        at = status.getPath()
        versions.setdefault(at.getName(), []).append((int(at.getParent().getName().removeprefix("batch_no=")), at.toString()))
    old = [p for own in versions.values() for _, p in sorted(own)[:-keep]]
    delete(spark, *old)
    return len(old)


def current_years(stored: DataFrame) -> DataFrame:
    """Of each year the rows of its newest batch. The years of a store are few and broadcast."""
    newest = stored.groupBy("year").agg(F.max("batch_no").alias("batch_no"))
    return stored.join(F.broadcast(newest), ["year", "batch_no"], "left_semi")
