"""Removal of repeated byte strings through a family of sorted suffix levels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import RollingHash, mixed, pieces, release, settle, to_batch

#: Bytes that decide where suffixes are sampled.
GRAM = 16
#: Starts that are judged together before single ones are.
BLOCK = 12


def sampled(g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the (leftmost) least value of each stretch of `width` values, as runs: places, and the first and last stretch that chose each."""
    n = len(g) - width + 1
    # Least of each stretch by the running minima, from either side, of blocks as long as a stretch.
    padded = np.full(-(-len(g) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(g)] = g
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[width - 1 : width - 1 + n])
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    # Equal least values side by side: a run may hold several places; each stretch takes its leftmost.
    places, lo, hi = [], [], []
    order = np.argsort(g, kind="stable")
    values = g[order]
    begin = np.searchsorted(values, least[first], side="left")
    end = np.searchsorted(values, least[first], side="right")
    simple = end - begin == 1
    if simple.all():
        return order[begin], first, last
    for a, b, s, e in zip(first.tolist(), last.tolist(), begin.tolist(), end.tolist(), strict=True):
        at = a
        for p in order[s:e].tolist():
            if p < at or at > b:
                continue
            if p - width + 1 > b:
                break
            stop = min(b, p)
            places.append(p)
            lo.append(at)
            hi.append(stop)
            at = stop + 1
    return np.array(places, dtype=np.int64), np.array(lo, dtype=np.int64), np.array(hi, dtype=np.int64)


class Sampler:
    """Suffixes of a text that stand for all its strings of `length` bytes."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.width = length // 2
        self.one, self.two = RollingHash(0x9E3779B97F4A7C15), RollingHash(0xD1B54A32D192ED03)

    def suffixes(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, lo, hi, key, context): strings that start at lo..hi chose the suffix at place. key: hash of
        the bytes that all of them have behind place; context: hash of all their bytes, seen from place."""
        sums = self.one.sums(data)
        n = len(data) - self.length + 1
        at = np.arange(n + self.width - 1)
        g = mixed(self.one.of(sums, at, at + GRAM)) & np.uint64((1 << 40) - 1)
        place, lo, hi = sampled(g, self.width)
        key = self.one.of(sums, place, place + self.length - self.width + 1)
        other = self.two.sums(data)
        context = mixed(self.two.of(other, lo, hi + self.length)) ^ mixed(((place - lo) * 4096 + (hi - place) + 4096).astype(np.uint64))
        return place, lo, hi, key.view(np.int64), context.view(np.int64)

    def passages(self, data: np.ndarray, length: int) -> np.ndarray:
        """Keys of suffixes sampled so that equal strings of `length` bytes have one in common."""
        half = length // 2
        sums = self.one.sums(data)
        at = np.arange(len(data) - GRAM + 1)
        place, _, _ = sampled(mixed(self.one.of(sums, at, at + GRAM)) & np.uint64((1 << 40) - 1), half)
        place = np.unique(place[place + length - half + 1 <= len(data)])
        return np.unique(self.one.of(sums, place, place + length - half + 1).view(np.int64))

    def blocks(self, one: np.ndarray, two: np.ndarray, place: int, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """(lo, hi, key, context), from both running sums of a text, of stretches of BLOCK starts, counted from place so that equal strings are in alike
        stretches. key: hash of the bytes that any start of the whole stretch has; context: of all bytes of the starts in lo..hi."""
        b = np.arange((place - hi) // BLOCK, (place - lo) // BLOCK + 1)
        first, last = np.maximum(lo, place - b * BLOCK - BLOCK + 1), np.minimum(hi, place - b * BLOCK)
        core = place - b * BLOCK
        key = mixed(self.one.of(one, core, core - BLOCK + 1 + self.length) + b.astype(np.uint64))
        context = mixed(self.two.of(two, first, last + self.length)) ^ mixed(((core - first) * 4096 + (last - first) + 1).astype(np.uint64))
        return first, last, key.view(np.int64), context.view(np.int64)

    def strings(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(h.of(h.sums(data), starts, starts + self.length).view(np.int64) for h in (self.one, self.two))


def suffix_rows(docs: DataFrame, length: int, n_batches: int, passage: int) -> DataFrame:
    """(batch, rid, place, lo, hi, key, context) of the sampled suffixes, and as batch -1 (rid, key) of those that stand for passages; docs: (rid, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(length)
        schema = pa.schema([("batch", pa.int32()), ("rid", pa.int64()), ("place", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("key", pa.int64()), ("context", pa.int64())])
        for batch in batches:
            for part in pieces(batch, "text"):
                found: list[list] = [[] for _ in range(6)]
                rids, keys = [], []
                for rid, text in zip(part.column("rid").to_pylist(), part.column("text").to_pylist(), strict=True):
                    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
                    if len(data) >= passage:
                        keys.append(sampler.passages(data, passage))
                        rids.append(np.full(len(keys[-1]), rid))
                    if len(data) < length:
                        continue
                    rows = sampler.suffixes(data)
                    for to, x in zip(found, (np.full(len(rows[0]), rid), *rows), strict=True):
                        to.append(x)
                if rids:
                    none = np.zeros(sum(map(len, rids)), dtype=np.int64)
                    yield to_batch({"batch": none - 1, "rid": np.concatenate(rids), "place": none, "lo": none, "hi": none, "key": np.concatenate(keys), "context": none}, schema)
                if found[0]:
                    cols = [np.concatenate(x) for x in found]
                    yield to_batch({"batch": cols[0] % n_batches, **dict(zip(schema.names[1:], cols, strict=True))}, schema)

    return docs.mapInArrow(run, "batch int, rid long, place int, lo int, hi int, key long, context long")


class SuffixLevels:
    """Sorted levels of suffixes, of sizes 1, 2, 4, ... batches.

    A batch's suffixes are sorted by the hash of the `length - width + 1` bytes they begin with, which puts equal beginnings side
    by side as the alphabet's order would. append() merge-scans the batch against each level (a sort-merge join) for
    suffixes that agree so far, and then merges it with levels of its own size, as a binary counter carries. Only
    one row of each key is held in a level, so the copies of a passage make no long runs.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.shared: list[DataFrame] = []
        self.settled: list[DataFrame] = []

    def append(self, suffixes: DataFrame) -> None:
        keys = suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        batch = settle(keys.sortWithinPartitions("key"), "suffix-level")
        self.settled.append(batch)
        self.shared.append(batch.where("n > 1").select("key"))
        own = batch.select("key")
        for _, level in self.levels:
            self.shared.append(own.hint("merge").join(level, "key", "left_semi"))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            own = own.union(self.levels.pop()[1])
            size *= 2
        if size > 1:
            own = settle(own.distinct().sortWithinPartitions("key"), "suffix-level")
            self.settled.append(own)
        self.levels.append((size, own))

    def repeated(self) -> DataFrame:
        """Keys that two or more suffixes have."""
        out = self.shared[0]
        for more in self.shared[1:]:
            out = out.union(more)
        return out.distinct()


def shared_passages(rows: DataFrame) -> DataFrame:
    """Texts (rid) with a passage that another text has too. rows: (rid, key). Of a key only the least and greatest text are gathered."""
    keys = rows.groupBy("key").agg(F.min("rid").alias("one"), F.max("rid").alias("two")).where("one <> two").select(F.col("key").alias("_key"))
    return rows.join(keys, rows["key"] == keys["_key"], "left_semi").select("rid").distinct()


def repeated_starts(docs: DataFrame, length: int, n_batches: int, passage: int) -> DataFrame:
    """(rid, starts, passage): array of (lo, hi), where strings of `length` bytes start that start elsewhere too, and whether
    another text has a passage of it. docs: (rid, text)."""
    all_rows = settle(suffix_rows(docs, length, n_batches, passage), "suffixes")
    family = SuffixLevels()
    for b in range(n_batches):
        family.append(all_rows.where(F.col("batch") == b))
    keys = settle(family.repeated().select(F.col("key").alias("_key")), "suffix-keys")
    release(*family.settled)
    shared = settle(shared_passages(all_rows.where("batch = -1").select("rid", "key")), "suffix-passages")
    rows = all_rows.where("batch >= 0")
    rows = settle(rows.join(keys, rows["key"] == keys["_key"], "left_semi").drop("batch"), "suffix-meet")
    release(all_rows, keys)
    kinds = settle(rows.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "place", "lo", "hi")).alias("x")), "suffix-kinds")
    doubtful = _doubtful(kinds)
    full = kinds.where("n > 1").select(F.col("key").alias("_key"), F.col("context").alias("_context"))
    sure = rows.join(full, (rows["key"] == full["_key"]) & (rows["context"] == full["_context"]), "left_semi").select("rid", "lo", "hi")
    sure = settle(sure.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("starts")), "suffix-sure")

    # The same again for short stretches of the starts in doubt, then for each start that is still in doubt.
    texts = settle(_ask(docs, doubtful), "suffix-texts")
    release(rows, kinds)

    def split(row: dict, sampler: Sampler) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(row["text"].encode(), dtype=np.uint8)
        one, two = sampler.one.sums(data), sampler.two.sums(data)
        parts = [sampler.blocks(one, two, x["place"], x["lo"], x["hi"]) for x in row["xs"]]
        n = [np.full(len(p[0]), x["n"]) for p, x in zip(parts, row["xs"], strict=True)]
        first, last, key, context = (np.concatenate(c) for c in zip(*parts, strict=True))
        return np.full(len(first), row["rid"]), first, last, key, context, np.concatenate(n)

    stretches = settle(_compare(texts, split, length), "suffix-stretches")
    stretch_kinds = stretches.groupBy("key", "context").agg(F.sum("n").alias("n"), F.min(F.struct("rid", "lo", F.col("lo").alias("place"), "hi")).alias("x"))
    stretch_kinds = settle(stretch_kinds, "stretch-kinds")
    full = stretch_kinds.where("n > 1").select(F.col("key").alias("_key"), F.col("context").alias("_context"))
    alike = stretches.join(full, (stretches["key"] == full["_key"]) & (stretches["context"] == full["_context"]), "left_semi").select("rid", "lo", "hi")

    def single(row: dict, sampler: Sampler) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(row["text"].encode(), dtype=np.uint8)
        starts = np.concatenate([np.arange(x["lo"], x["hi"] + 1) for x in row["xs"]])
        n = np.concatenate([np.full(x["hi"] - x["lo"] + 1, x["n"]) for x in row["xs"]])
        return np.full(len(starts), row["rid"]), starts, starts, *sampler.strings(data, starts), n

    strings = settle(_compare(_ask(texts.select("rid", "text"), _doubtful(stretch_kinds)), single, length), "suffix-strings")
    again = strings.groupBy("key", "context").agg(F.sum("n").alias("all")).where("`all` > 1").select(F.col("key").alias("_key"), F.col("context").alias("_context"))
    found = strings.join(again, (strings["key"] == again["_key"]) & (strings["context"] == again["_context"]), "left_semi").select("rid", "lo", "hi")
    more = found.union(alike).groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    marked = sure.select("rid", "starts", F.lit(False).alias("passage")).union(more.select("rid", "starts", F.lit(False))).union(shared.select("rid", F.lit(None), F.lit(True)))
    # Lists of null are left out of collect_list.
    out = settle(marked.groupBy("rid").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.max("passage").alias("passage")), "suffix-starts")
    release(texts, stretches, stretch_kinds, strings, sure, shared)
    return out


def _doubtful(kinds: DataFrame) -> DataFrame:
    """(rid, xs): one row's place of each kind whose key has several kinds, gathered by text. A key of one kind leaves no doubt."""
    many = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(F.col("key").alias("_key"))
    own = kinds.join(many, kinds["key"] == many["_key"], "left_semi")
    return own.groupBy(F.col("x.rid").alias("_rid")).agg(F.collect_list(F.struct("x.place", "x.lo", "x.hi", "n")).alias("xs"))


def _ask(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(rid, text, xs) of the texts in doubt, one row for equal rows."""
    return docs.join(asked, docs["rid"] == asked["_rid"]).groupBy("rid").agg(F.first("text").alias("text"), F.first("xs").alias("xs"))


def _compare(texts: DataFrame, of, length: int) -> DataFrame:
    """Rows (rid, lo, hi, key, context, n) that of(row, sampler) makes of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(length)
        schema = pa.schema([("rid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("key", pa.int64()), ("context", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = [of(row, sampler) for row in part.to_pylist()]
                if rows:
                    yield to_batch(dict(zip(schema.names, map(np.concatenate, zip(*rows, strict=True)), strict=True)), schema)

    return texts.mapInArrow(run, "rid long, lo int, hi int, key long, context long, n long")


def cut(text: str | None, starts: list | None, length: int) -> tuple[int, list[tuple[int, int]], bytes]:
    """Bytes of the text, removed runs, the bytes that stay."""
    data = (text or "").encode()
    if not starts:
        return len(data), [], data
    change = np.zeros(len(data) + 1, dtype=np.int64)
    at = np.array([(x["lo"], x["hi"] + length) for x in starts], dtype=np.int64)
    np.add.at(change, at[:, 0], 1)
    np.add.at(change, at[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
    return len(data), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, length: int = 400, n_batches: int = 4, passage: int = 280, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, spans (start, end of removed runs, in bytes), kept (binary), passage: whether another
    text has a string of its of `passage` bytes (about 50 words; always found, those of half the length by chance).

    Every byte goes that a string of `length` bytes covers which also starts anywhere else, in the same document or
    another; strings are judged on the input. A null text counts as empty, shorter texts lose nothing. Ids
    may be null or repeat; rows equal in id and text are copies of each other like any. Texts are never cut
    before they are judged.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rid = F.xxhash64(F.col("id"), F.col("text"))
    texts = rows.where(F.octet_length("text") >= min(length, passage)).select(rid.alias("rid"), "text")
    starts = repeated_starts(texts, length, n_batches, passage).withColumnRenamed("rid", "_rid")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field("id"), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("passage", pa.bool_())])
            for part in pieces(batch, "text"):
                cuts = [cut(t, s, length) for t, s in zip(part.column("text").to_pylist(), part.column("starts").to_pylist(), strict=True)]
                yield to_batch({"id": part.column("id"), "n_bytes": [x[0] for x in cuts], "spans": [[{"start": a, "end": b} for a, b in x[1]] for x in cuts], "kept": [x[2] for x in cuts], "passage": part.column("passage")}, schema)

    marked = rows.withColumn("rid", rid).join(starts, F.col("rid") == starts["_rid"], "left").select("id", "text", "starts", F.coalesce("passage", F.lit(False)).alias("passage"))
    return marked.mapInArrow(run, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, passage boolean").withColumnRenamed("id", id_col)
