"""Shards of near-equal bytes by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import number_rows, rows_per_bucket, settle


def differencing(weights: np.ndarray, k: int) -> np.ndarray:
    """Which of k parts each weight goes to. A weight is a partial partition (itself and k - 1 empty parts); the two with
    the largest spread are combined again and again, the heaviest part of one with the lightest of the other."""
    n = len(weights)
    if n <= 1 or k == 1:
        return np.zeros(n, dtype=np.int64)
    sums = np.zeros((n, k), dtype=np.int64)
    sums[:, 0] = weights
    heap = [(-int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        sums[a] = both[order] - both[order[-1]]
        merges.append((a, b, order.astype(np.int16)))
        heapq.heappush(heap, (-int(sums[a][0]), a))
    # Backwards: at[x] holds where the parts of x end up.
    at: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    out = np.zeros(n, dtype=np.int64)
    for a, b, order in reversed(merges):
        place = np.empty(k, dtype=np.int64)
        place[order] = at[a]
        at[a], at[b] = place, place[::-1]
    for i, place in at.items():
        out[i] = place[0]
    return out


def _part(table: pa.Table, k: int, name: str) -> pa.Table:
    """One block, rows of (key, size), with the number of its part of k."""
    table = table.sort_by([("size", "descending"), ("key", "ascending")])
    return table.append_column(name, pa.array(differencing(table.column("size").to_numpy(), k), type=pa.int32()))


def assign_groups(groups: DataFrame, shards: int, block_rows: int = 8192, detail: int = 256) -> DataFrame:
    """groups (key, size) to (key, shard).

    Groups of more than a shard's 1/detail of all bytes, shards * detail at most, go one by one into the last
    differencing. The many small ones are dealt by hash into blocks of about block_rows, each differenced in a
    task of its own into `fine` bins; those of all blocks with one number, largest facing smallest, make `fine`
    lots of nearly one size, which are the last differencing's further items, together with up to shards * detail small
    groups that are kept out to level what is left. So the last one's input has a bound for any number of groups.
    """
    fine = shards * 8
    total, n = groups.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not n:
        return groups.select("key", F.lit(0).alias("shard"))
    grain = max(1, total // (shards * detail))
    n_blocks = rows_per_bucket(n, block_rows)
    spread = F.xxhash64(F.lit(5), "key")
    # The share of small groups that stay single: shards * detail of n, by hash.
    loose = spread >= F.lit(float((1 << 63) - min(1.0, shards * detail / n) * float(1 << 64)))
    marked = groups.withColumn("single", (F.col("size") > grain) | loose).withColumn("block", F.pmod(F.xxhash64(F.lit(6), "key"), F.lit(n_blocks)).cast("int"))
    small = marked.where(~F.col("single")).select("block", "key", "size")

    def in_block(table: pa.Table) -> pa.Table:
        return _part(table, fine, "bin")

    kind = groups.schema["key"].dataType.simpleString()
    binned = settle(small.groupBy("block").applyInArrow(in_block, f"block int, key {kind}, size long, bin int"), "shard-bins")
    # Bins of a block are taken from heavy to light or the other way about, by the block's parity.
    bins = binned.groupBy("block", "bin").agg(F.sum("size").alias("size"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("size"), "bin")) - 1
    bins = bins.withColumn("rank", rank).select("block", "bin", "size", F.when(F.col("block") % 2 == 0, F.col("rank")).otherwise(fine - 1 - F.col("rank")).alias("lot"))
    lots = bins.groupBy("lot").agg(F.sum("size").alias("size")).select(F.concat(F.lit("lot "), F.col("lot").cast("string")).alias("key"), "size", F.lit(0).alias("all"))
    singles = marked.where("single").select(F.concat(F.lit("key "), F.col("key").cast("string")).alias("key"), "size", F.lit(0).alias("all"))

    def at_last(table: pa.Table) -> pa.Table:
        return _part(table, shards, "shard")

    last = singles.union(lots).groupBy("all").applyInArrow(at_last, "key string, size long, `all` int, shard int")
    last = settle(last.select("key", "shard"), "shard-last")
    lot_shard = last.where("key like 'lot %'").select(F.substring("key", 5, 20).cast("int").alias("_lot"), "shard")
    of_bin = bins.join(lot_shard, bins["lot"] == lot_shard["_lot"]).select(F.col("block").alias("_block"), F.col("bin").alias("_bin"), "shard")
    of_small = binned.join(of_bin, (binned["block"] == of_bin["_block"]) & (binned["bin"] == of_bin["_bin"])).select("key", "shard")
    of_single = last.where("key like 'key %'").select(F.expr("substring(key, 5)").cast(kind).alias("key"), "shard")
    return of_small.union(of_single)


def shard_rows(docs: DataFrame, shards: int = 40, overhead: int = 16, per_bucket: int = 50_000, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes plus overhead), text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Documents of equal text stay together, as the unit that differencing places; a null text counts as an empty
    one. Slots run from 0 without gaps in each shard. Ids may be null or repeat. keep: further columns to take along,
    of names other than the result's. A shard can be larger than the mean only by its last group, or if one group
    alone is.
    """
    return place_rows(docs.select(*measures(docs, overhead, id_col, text_col, keep)), shards, per_bucket, id_col, keep)


def measures(docs: DataFrame, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> list[Column]:
    """What sharding needs of a document: id, size, text_crc32, key (equal for equal texts) and the columns to keep."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return [docs[id_col].alias("id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.substring(F.sha2(text.cast("binary"), 256), 1, 32).alias("key"), *[docs[c] for c in keep]]


def place_rows(rows: DataFrame, shards: int = 40, per_bucket: int = 50_000, id_col: str = "doc_id", keep: tuple[str, ...] = (), along: str | None = None) -> DataFrame:
    """shard_rows for rows of `measures`. Slots follow the column `along`, of numbers from 0 up, or else a hash."""
    rows = settle(rows, "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    place = assign_groups(settle(groups, "shard-groups"), shards).withColumnRenamed("key", "_key")
    placed = rows.join(place, rows["key"] == place["_key"]).drop("_key", "key")
    n = rows.count()
    placed = number_rows(placed, ["shard"], [F.col("id"), F.col("text_crc32"), F.col("size")], rows_per_bucket(n, per_bucket), "slot", None if along is None else F.col(along))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), *keep)
