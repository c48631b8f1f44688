"""Phrase collocations: streams of n-gram counts, kept in prefix and in suffix order and joined in lockstep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import chunked, mixed, pieces, release, settle

#: Bytes that end a piece, and bytes between words of a piece.
BREAKS, BLANKS = tuple(b".,;:!?\n\x0b\x0c\r"), tuple(b" \t")
#: Classes of bytes: 0 in a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, dtype=np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(BREAKS)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Of a filter of frequent n-grams: its bits, whatever the corpus. Where it fills up, more n-grams are counted in vain; results stay the same.
FILTER_BITS = 1 << 26
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words of the texts in order, the piece that each is in, and the words that the codes stand for."""
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    kind = KIND[data]
    inside = kind == 0
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(off) > 0)
    starts[off[full]] = inside[off[full]]
    ends[off[full + 1] - 1] = inside[off[full + 1] - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    breaks = np.flatnonzero(kind == 2)
    piece = (np.searchsorted(breaks, first) + np.searchsorted(off, first, side="right")).astype(np.int32)
    lengths = np.zeros(len(first) + 1, dtype=np.int32)
    np.cumsum(last - first, out=lengths[1:])
    coded = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(lengths), pa.py_buffer(LOWER[data[inside]])]).dictionary_encode()
    return coded.indices.to_numpy(), piece, coded.dictionary


def word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(words))


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n-grams from their words' hashes, one for each start."""
    out = hashes[: max(0, len(hashes) - n + 1)]
    for k in range(1, n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)])
    return out


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where a filter may hold the hash: two bits each."""
    out = np.ones(len(hashes), dtype=bool)
    for h in (hashes, mixed(hashes)):
        at = (h % np.uint64(FILTER_BITS)).astype(np.int64)
        out &= (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def frequent_filter(grams: DataFrame) -> np.ndarray:
    """A bit filter of the n-grams (lang, phrase): FILTER_BITS / 64 words at most reach the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                phrases = batch.column("phrase").filter(pc.equal(batch.column("lang"), lang)).to_pylist()
                seed = xxhash.xxh64_intdigest(lang.encode())
                h = np.fromiter((int(chain(np.array([xxhash.xxh64_intdigest(w.encode(), seed) for w in p.split(" ")], dtype=np.uint64), p.count(" ") + 1)[0]) for p in phrases), dtype=np.uint64, count=len(phrases))
                for x in (h, mixed(h)):
                    at = (x % np.uint64(FILTER_BITS)).astype(np.int64)
                    np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits[at].view(np.int64))], ["at", "bits"])

    found = grams.select("lang", "phrase").mapInArrow(mark, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def gram_counts(docs: DataFrame, orders: tuple[int, ...], known=None) -> DataFrame:
    """Counts (lang, phrase, f) of all n-grams of the given orders; with a broadcast filter `known` = (order, bits), only those whose parts of that order it holds.

    A task counts a few megabytes of text at a time in arrays and sends on each distinct n-gram once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 4 << 20):
                langs = batch.column("lang")
                for lang in pc.unique(langs).to_pylist():
                    codes, piece, words = words_of(batch.column("text").filter(pc.equal(langs, lang)))
                    if len(codes):
                        yield from counted(codes, piece, words, lang)
                pa.default_memory_pool().release_unused()

    def counted(codes: np.ndarray, piece: np.ndarray, words: pa.Array, lang: str) -> Iterator[pa.RecordBatch]:
        n_words = len(words)
        fine = None
        if known is not None:
            order, bits = known.value
            hashes = word_hashes(words, lang)
            if order == 1:
                fine = holds(bits, hashes)[codes]
            else:
                same = piece[: len(codes) - order + 1] == piece[order - 1 :]
                fine = np.zeros(len(same), dtype=bool)
                fine[same] = holds(bits, chain(hashes[codes], order)[same])
        for n in orders:
            starts = len(codes) - n + 1
            if starts <= 0:
                continue
            ok = piece[:starts] == piece[n - 1 :]
            if fine is not None:
                for k in range(n - known.value[0] + 1):
                    ok = ok & fine[k : k + starts]
            at = np.flatnonzero(ok)
            # Ranks of n-grams grow by a word at a time, so that a pair of rank and word stays a 64-bit number.
            rank, parts = codes[at].astype(np.int64), None
            f = np.bincount(rank, minlength=n_words) if n == 1 else None
            if n == 1:
                found = np.flatnonzero(f)
                parts, f = [found], f[found]
            for k in range(1, n):
                key = rank * n_words + codes[at + k]
                if k == n - 1:
                    pairs, f = np.unique(key, return_counts=True)
                else:
                    pairs, rank = np.unique(key, return_inverse=True)
                before, word = pairs // n_words, pairs % n_words
                parts = [before, word] if parts is None else [*(p[before] for p in parts), word]
            if len(f):
                phrase = words.take(pa.array(parts[0]))
                for p in parts[1:]:
                    phrase = pc.binary_join_element_wise(phrase, words.take(pa.array(p)), " ")
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(f), np.int32))), phrase, pa.array(f.astype(np.int64))], schema=COUNTS)

    part = docs.mapInArrow(count, "lang string, phrase string, f long")
    return part.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def lockstep(table: pa.Table, backward: bool) -> pa.Table:
    """One chunk of the count streams, all orders in one order of words, read once with the open prefixes on a stack.

    rows: lang, words, f (null where a row only completes another), own (false for prefixes that belong to an earlier
    chunk), parts (counts so far), most. Adds the counts of each n-gram's proper prefixes to `parts` and the largest count
    of its extensions by a word to `most`. In suffix order (words reversed) the prefixes are suffixes.
    """
    rows = table.to_pylist()
    for r in rows:
        r["key"] = (r["lang"], r["words"][::-1] if backward else r["words"])
    rows.sort(key=lambda r: (r["key"], not r["own"]))
    out: list[dict] = []
    stack: list[dict] = []
    for r in rows:
        if out and out[-1]["key"] == r["key"]:
            # What other chunks know of the same n-gram.
            top = out[-1]
            for c in ("f", "parts"):
                top[c] = r[c] if top[c] is None else top[c]
            top["most"] = max(top["most"], r["most"])
            top["own"] |= r["own"]
            continue
        lang, words = r["key"]
        while stack and not (stack[-1]["key"][0] == lang and stack[-1]["key"][1] == words[: len(stack[-1]["key"][1])]):
            stack.pop()
        r["prefixes"] = list(stack)
        if stack and len(stack[-1]["key"][1]) == len(words) - 1:
            stack[-1].setdefault("wider", []).append(r)
        stack.append(r)
        out.append(r)
    for r in out:
        r["most"] = max([r["most"], *(x["f"] for x in r.pop("wider", ()) if x["f"] is not None)])
        r["parts"] = [*(r["parts"] or []), *(p["f"] for p in r.pop("prefixes"))] if r["own"] else None
    for r in out:
        r["f"] = r["f"] if r["own"] else None
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64()), ("parts", pa.list_(pa.int64())), ("most", pa.int64())])
    return pa.Table.from_pylist([{c: r[c] for c in schema.names} for r in out], schema=schema)


def pass_over(stream: DataFrame, counts: DataFrame, backward: bool, name: str) -> DataFrame:
    """The stream (lang, words, f, parts, most) put in prefix or suffix order, cut in chunks and read in lockstep.

    A chunk begins amid the extensions of at most three prefixes whose rows lie before it; their counts ride along.
    """
    key = F.reverse("words") if backward else F.col("words")
    parts = chunked(stream.withColumn("_key", F.struct("lang", key.alias("k"))), ["_key"], 40 + F.octet_length(F.array_join("words", " ")), name, 4 << 20)
    first = parts.groupBy("_chunk").agg(F.min("_key").alias("k"), F.max(F.size("words")).alias("_m"))
    some = F.explode(F.sequence(F.lit(1), F.size("k.k") - 1))
    carried = first.where(F.size("k.k") > 1).select("_chunk", "k", some.alias("j")).select("_chunk", F.col("k.lang").alias("lang"), F.slice("k.k", F.lit(1), F.col("j")).alias("k"))
    carried = carried.select("_chunk", "lang", (F.reverse("k") if backward else F.col("k")).alias("words"))
    known = carried.join(counts.select("lang", "words", "f"), ["lang", "words"]).select("_chunk", "lang", "words", "f", F.lit(None).cast("array<long>").alias("parts"), F.lit(0).cast("long").alias("most"), F.lit(False).alias("own"))
    rows = parts.drop("_key").withColumn("own", F.col("f").isNotNull()).unionByName(known)
    return rows.groupBy("_chunk").applyInArrow(lambda t: lockstep(t, backward), "lang string, words array<string>, f long, parts array<long>, most long")


def wide(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, scale: int = 2_000_000, covered: int = 80) -> DataFrame:
    """The best-scoring phrases of 2 to 4 words of each language, by the count of the phrase against those of its two parts.

    docs: text, lang; other columns do not matter, whatever their names. Null texts are empty, a null lang is `und`. Words
    are runs without blanks inside pieces; texts are never joined. Repeated rows count each time. Ties of score go to the
    larger count, then to the phrase in byte order. An empty table gives an empty result.

    Counting goes by orders: an n-gram with `least` occurrences has only parts with as many, so n-grams of which a part is
    surely rarer are not counted (a filter of fixed size tells). All counts are exact, and only phrases below `least` are
    left out. A longer candidate that covers a phrase has one of a single word more in between with a count no smaller, so
    extensions by one word suffice.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    ones = settle(gram_counts(rows, (1,)).withColumn("n", F.col("f")), "phrases-1")
    totals = ones.groupBy("lang").agg(F.sum("n").alias("n"))
    often = ones.where(F.col("f") >= least).select("lang", "phrase", "f")
    twos = settle(gram_counts(rows, (2,), spark.sparkContext.broadcast((1, frequent_filter(often)))).where(F.col("f") >= least), "phrases-2")
    more = gram_counts(rows, (3, 4), spark.sparkContext.broadcast((2, frequent_filter(twos)))).where(F.col("f") >= least)
    counts = settle(often.union(twos).union(more).select("lang", F.split("phrase", " ").alias("words"), "f"), "phrases")
    stream = counts.withColumns({"parts": F.lit(None).cast("array<long>"), "most": F.lit(0).cast("long")})
    forward = settle(pass_over(stream, counts, False, "phrases-prefix"), "phrases-left")
    both = pass_over(forward, counts, True, "phrases-suffix")
    # A phrase's extensions may lie in several chunks.
    whole = both.groupBy("lang", "words").agg(F.max("f").alias("a"), F.max("parts").alias("parts"), F.max("most").alias("most"))
    m = F.size("words")
    whole = whole.where((m >= 2) & (wide(F.col("most")) * 100 < wide(F.col("a")) * covered))
    # parts: counts of the first 1 .. m - 1 words, then of the last 1 .. m - 1.
    cuts = F.transform(F.sequence(F.lit(1), m - 1), lambda k: F.struct(k.alias("k"), F.element_at("parts", k).alias("l"), F.element_at("parts", m - 1 + m - k).alias("r")))
    scored = whole.withColumn("cut", F.explode(cuts)).withColumn("score", F.expr(f"cast(cast(a as decimal(20,0)) * {scale} div (cast(cut.l as decimal(20,0)) + cast(cut.r as decimal(20,0))) as long)"))
    best = scored.groupBy("lang", "words").agg(F.min(F.struct("score", F.col("cut.k").alias("k"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"))).alias("x"), F.first("a").alias("a"))
    best = best.select("lang", F.array_join("words", " ").alias("phrase"), "a", "x.l", "x.r", "x.score")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # Heads of slices first, so that no task ranks a whole language.
    best = best.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("_at") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = settle(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    release(ones, twos, counts, forward)
    return out
