"""Pieces that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a new local one serves, but in local mode alone."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def settle(df: DataFrame, name: str, once: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: what follows neither recomputes nor depends on lost executors.

    once: nothing else reads df, so its shuffle files go as soon as it is written, not when the driver collects its garbage.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if once:
        # The plan takes the setting when it is made, so it is made again.
        conf, clean = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(clean, "false")
        conf.set(clean, "true")
        try:
            df.select("*").write.parquet(path)
        finally:
            conf.set(clean, before)
    else:
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(*settled: DataFrame) -> None:
    """Delete what settle() wrote, once all that reads it is settled itself."""
    for df in settled:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pick(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the whole row as the struct `row`, whatever the names of the other columns."""
    return docs.select(*[docs[c] for c in columns], F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def pieces(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def rows_per_bucket(n_rows: int, per_bucket: int) -> int:
    """How many buckets of about per_bucket rows; follows the data, 1 at least."""
    return max(1, -(-n_rows // per_bucket))


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], buckets: int, name: str, along: Column | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order of a hash of `order`, then `order`; or of `along`, a
    number from 0 up that is spread evenly, instead of the hash.

    A group may hold most rows: each is cut in `buckets` ranges of the hash, rows are numbered inside a range,
    and counts of the ranges before are added, so no task sees a whole group. Rows equal in `order` are
    numbered in any order. The counts (groups x buckets rows) are joined, not collected.
    """
    # Not the hash that deals the rows out, else the window's tasks would be uneven.
    spread = F.xxhash64(F.lit(11), *order) if along is None else along
    step = (1 << 64) // buckets + 1 if along is None else (df.agg(F.max(along)).first()[0] or 0) // buckets + 1
    df = df.withColumn("_spread", spread).withColumn("_bucket", F.floor(F.col("_spread") / F.lit(float(step))).cast("int"))
    counts = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_spread", *order)
    left = df.withColumn("_at", F.row_number().over(inside) - 1)
    right = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_bucket").alias("_b"), "_before")
    same = [left[c].eqNullSafe(right[f"_g{i}"]) for i, c in enumerate(group)] + [left["_bucket"] == right["_b"]]
    on = same[0]
    for more in same[1:]:
        on = on & more
    return left.join(right, on).withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop(
        "_spread", "_bucket", "_at", "_before", "_b", *[f"_g{i}" for i in range(len(group))]
    )


def link_components(edges: DataFrame, name: str = "links", most_rounds: int = 60) -> DataFrame:
    """Smallest label of each connected component: edges (u, v) of longs to rows (node, label).

    Alternates large-star and small-star steps; each keeps the components, hangs nodes on ever smaller ones and
    ends in stars. Only minima per node are joined, never neighbour lists, so a hub with most links stays spread.
    """
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(large, name)
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v")))
        edges = settle(small.where("u <> v").distinct(), name)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of unsigned 64-bit numbers, so that any bits of the result can serve as a hash."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class RollingHash:
    """Polynomial hashes modulo 2 ** 64 of any stretch of a byte string, from one running sum."""

    def __init__(self, base: int) -> None:
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, dtype=np.uint64)
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(self.base))

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            n = max(1 << 16, 2 * len(data))
            self.up, self.down = powers(self.base, n), powers(self.inverse, n)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self.down[starts]


def to_batch(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=schema.field(c).type) for c, x in columns.items()], schema=schema)


def chunked(df: DataFrame, keys: Sequence[Column | str], size: Column, name: str, most: int = 16 << 20) -> DataFrame:
    """df settled in ranges of the keys: the column _chunk numbers them in key order. A chunk has about `most` bytes by `size`; equal keys share one."""
    n_bytes = df.agg(F.sum(size)).first()[0] or 0
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows_per_bucket(n_bytes, most))
    return settle(df.repartitionByRange(n, *keys).withColumn("_chunk", F.spark_partition_id()), name)
