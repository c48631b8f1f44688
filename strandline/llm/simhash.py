"""SimHash near-duplicates through Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import link_components, mixed, pick, pieces, release, settle, to_batch
from strandline.llm.passages import word_codes

SEED = 42
#: Lowest bit and width of the three parts of a fingerprint; each fits the 23 bits of the code.
PARTS = ((0, 21), (21, 21), (42, 22))
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011


def fingerprint(text: str, shingle: int) -> int:
    """Majority bits of the XXH64 of the word shingles; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """docs with the long `fp`; a null text counts as empty."""
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                fp = pa.array([signed(fingerprint(t or "", shingle)) for t in part.column(text_col).to_pylist()], type=pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names if c != text_col), fp], names=[*(c for c in names if c != text_col), "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    return docs.mapInArrow(run, f"{schema}, fp long")


class Golay:
    """Decoding tables of the perfect [23, 12, 7] code."""

    def __init__(self) -> None:
        self.bytes = [np.array([self._syndrome(b << (8 * k)) for b in range(256)], dtype=np.int64) for k in range(3)]
        self.leader = np.zeros(2048, dtype=np.int64)
        weight = np.zeros(2048, dtype=np.int64)
        further: dict[int, list[int]] = {}
        for n in range(5):
            for bits in combinations(range(23), n):
                e = sum(1 << b for b in bits)
                s = self._syndrome(e)
                if n < 4:
                    self.leader[s], weight[s] = e, n
                elif weight[s] == 3:
                    further.setdefault(s, []).append(e)
        #: The error patterns that lead to the codewords a word shares: its nearest one; if that is 3 bits off, also the 5 that are 4 off.
        self.n_errors = np.where(weight == 3, 6, 1)
        self.errors = np.zeros((2048, 6), dtype=np.int64)
        self.errors[:, 0] = self.leader
        for s, es in further.items():
            self.errors[s, 1:] = es

    @staticmethod
    def _syndrome(x: int) -> int:
        for b in range(23, 10, -1):
            if x >> b & 1:
                x ^= GENERATOR << (b - 11)
        return x

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.bytes[0][words & 255] ^ self.bytes[1][words >> 8 & 255] ^ self.bytes[2][words >> 16]

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Index (12 bits) of the codeword within 3 bits."""
        return (words ^ self.leader[self.syndrome(words)]) >> 11

    def shared(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all codewords that a word one bit away may have as its nearest: (which word, index)."""
        s = self.syndrome(words)
        n = self.n_errors[s]
        row = np.repeat(np.arange(len(words)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, (words[row] ^ self.errors[s[row], at]) >> 11


def key_rows(fps: np.ndarray, golay: Golay) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(side, row, key): two fingerprints at 4 or fewer differing bits meet in a key, one from side 0 and one from side 1.

    Of the three parts' errors, sorted, the two smaller are (0 or 1, 0 or 1) or (0, 2). In the first case one
    side gives its nearest codeword of one part and all shared codewords of the other part, the other side the
    reverse; both pairs of indices then agree. In the second case a part agrees bit by bit and the next part, with two
    errors, has a third without one.
    """
    u = fps.view(np.uint64)
    part = [((u >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in PARTS]
    near = [golay.nearest(p) for p in part]
    shared = [golay.shared(p) for p in part]
    for kind, (i, j) in enumerate(combinations(range(3), 2)):
        row, index = shared[j]
        yield 0, row, (kind << 40) | near[i][row] << 12 | index
        row, index = shared[i]
        yield 1, row, (kind << 40) | index << 12 | near[j][row]
    all_rows = np.arange(len(fps))
    for i in range(3):
        j = (i + 1) % 3
        for t in range(3):
            key = (3 + 3 * i + t << 40) | part[i] << 8 | (part[j] >> (8 * t) & 255)
            yield 0, all_rows, key
            yield 1, all_rows, key


def first_rule(x: F.Column) -> F.Column:
    """Of the keys in which two linked fingerprints meet, the one that reports them, so that each link comes once. x: their XOR."""
    def bits(lo: int, n: int) -> F.Column:
        return F.bit_count(x.bitwiseAND(F.lit(signed(((1 << n) - 1) << lo))))

    part = [bits(lo, n) for lo, n in PARTS]
    rule = None
    cases = [((part[i] <= 1) & (part[j] <= 1), k) for k, (i, j) in enumerate(combinations(range(3), 2))]
    for i in range(3):
        j = (i + 1) % 3
        lo, n = PARTS[j]
        cases += [((part[i] == 0) & (bits(lo + 8 * t, min(8, n - 8 * t)) == 0), 3 + 3 * i + t) for t in range(3)]
    for cond, k in cases:
        rule = F.when(cond, k) if rule is None else rule.when(cond, k)
    return rule


def not_joined() -> F.Column:
    """Whether two rows with `known` of fingerprint_links may still need a link: not if both have one and the same."""
    return ~F.coalesce(F.col("known_u") == F.col("known_v"), F.lit(False))


def fingerprint_links(fps: DataFrame, most_bits: int = 4, of: str | None = None, extra: Sequence[str] = (), keep: F.Column | None = None, own: str | None = None) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints `fp` that differ in at most most_bits (0 to 4) bits.

    With `of`, an integer column from 0 to 32767, fingerprints are distinct and linked for each of its values by itself, and pairs carry it.
    Columns `extra` stand beside both sides as <name>_u and <name>_v for `keep`, a condition on pairs that is part of
    the join, so pairs that are known to be joined already or to fail are never made. With `own`, one of these columns, several
    rows may have one fingerprint: those of different `own` (null is one value) are linked too, and pairs carry both. Null fingerprints meet nothing.
    """
    types = {c: fps.schema[c].dataType.simpleString() for c in extra}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            schema = pa.schema([("side", pa.int8()), ("k", pa.int64()), ("fp", pa.int64()), *(batch.schema.field(c) for c in extra)])
            # Keys take 44 bits; the bits from 48 on keep values of `of` apart.
            apart = batch.column(of).to_numpy(zero_copy_only=False).astype(np.int64) << 48 if of else np.zeros(len(fp), dtype=np.int64)
            for side, row, key in key_rows(fp, golay):
                yield to_batch({"side": np.full(len(row), side, dtype=np.int8), "k": key | apart[row], "fp": fp[row]} | {c: batch.column(c).take(pa.array(row)) for c in extra}, schema)

    keys = settle(fps.where("fp is not null").mapInArrow(run, "side byte, k long, fp long" + "".join(f", {c} {t}" for c, t in types.items())), "golay")
    one = keys.where("side = 0").select("k", F.col("fp").alias("u"), *[F.col(c).alias(f"{c}_u") for c in extra])
    two = keys.where("side = 1").select("k", F.col("fp").alias("v"), *[F.col(c).alias(f"{c}_v") for c in extra])
    x = F.col("u").bitwiseXOR(F.col("v"))
    once = F.col("u") < F.col("v")
    if own:
        a, b = F.col(f"{own}_u"), F.col(f"{own}_v")
        once = once | ((F.col("u") == F.col("v")) & F.coalesce(a < b, a.isNull() & b.isNotNull()))
    near = once & (F.bit_count(x) <= most_bits) & (first_rule(x) == F.shiftright(one["k"], 40).bitwiseAND(F.lit(255)))
    if keep is not None:
        near = near & keep
    apart = [F.shiftright(one["k"], 48).cast("int").alias(of)] if of else []
    links = settle(one.join(two, (one["k"] == two["k"]) & near).select("u", "v", *apart, *([f"{own}_u", f"{own}_v"] if own else [])), "fingerprint-links")
    release(keys)
    return links


def coarse_cells(rows: DataFrame) -> DataFrame:
    """(cell, node): the coarse cells of each row (node, a long; fps, an array of fingerprints, as many in each row).

    A cell holds rows that agree in the nearest codewords of three parts, 36 bits in all, so that chance fills few at any
    size; many of a dense group share some. One fingerprint has one cell, several have one for each of their parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        schema = pa.schema([("cell", pa.int64()), ("node", pa.int64())])
        for batch in batches:
            u = batch.column("fps").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
            near = [golay.nearest(((u[:, k] >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64)) for k in range(u.shape[1]) for lo, n in PARTS]
            for a in range(len(near) if len(near) > 3 else 1):
                three = [near[(a + step) % len(near)] for step in ((0, 1, 5) if len(near) > 3 else (0, 1, 2))]
                yield to_batch({"cell": a << 48 | three[0] << 24 | three[1] << 12 | three[2], "node": batch.column("node")}, schema)

    return rows.select("node", "fps").mapInArrow(run, "cell long, node long")


def star_pairs(cells: DataFrame) -> DataFrame:
    """(u, v), u < v: each node of a cell with the least and the largest node of it.

    So a group of any size is mostly joined by two pairs a row and cell, before all near pairs are asked for. Which pairs
    come is no matter of results."""
    ends = cells.groupBy("cell").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    both = cells.join(ends, "cell").select(F.col("node").alias("u"), F.explode(F.array("lo", "hi")).alias("v"))
    return both.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(prints: DataFrame) -> DataFrame:
    """prints (id, fp, ...) with component_id: the smallest id of the documents that links reach, null if none has an id.

    Documents of one fingerprint are collapsed before keys are made; a group of copies, however large, is one
    row there. Fingerprints of a dense group are joined to its cells' ends first; then all near pairs between what is not
    joined yet are found, so components are exact and a dense ball makes no pairs of all. Only minima per fingerprint and
    component are gathered."""
    own = settle(prints.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    stars = settle(star_pairs(coarse_cells(own.where("fp is not null").select(F.col("fp").alias("node"), F.array("fp").alias("fps")))).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 4), "print-stars")
    joined = link_components(stars, "print-stars").select(F.col("node").alias("_n"), F.col("label").alias("known"))
    placed = own.select("fp").join(joined, own["fp"] == joined["_n"], "left").select("fp", "known")
    links = fingerprint_links(placed.repartition("fp"), extra=("known",), keep=not_joined())
    label = link_components(stars.union(links), "print-links")
    own = own.join(label, own["fp"] == label["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = own.groupBy("label").agg(F.min("least").alias("component_id"))
    of = settle(own.join(least, "label").select(F.col("fp").alias("_fp"), "component_id", "label"), "print-components")
    release(stars, links)
    return prints.join(of, prints["fp"] == of["_fp"]).drop("_fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and link like any other. A null id stays null; the component
    takes the smallest other id. Repeated rows are kept. Other columns are not read. Texts of any length are hashed whole.
    """
    prints = settle(fingerprints(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "text", shingle), "simhash")
    return components(prints).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_prints(text: str, n: int) -> list[int]:
    """n fingerprints of a text's distinct words (A-Z in lower case), each from its own hashes. One changed word moves far fewer bits than in a fingerprint of shingles."""
    words = set(text.encode().lower().split())
    if not words:
        return [0] * n
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    out = []
    for k in range(n):
        own = mixed(h + np.uint64(k))
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(own), 1 << 16):
            ones += np.unpackbits(own[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(signed(int.from_bytes(np.packbits(2 * ones > len(own), bitorder="little").tobytes(), "little")))
    return out


def sketch(text: str, shingle: int, size: int) -> np.ndarray:
    """The `size` least hashes (31 bits) of the word shingles, sorted: all of them in a shorter text."""
    codes = word_codes(text).view(np.uint32).astype(np.uint64)
    if not len(codes):
        return np.zeros(0, dtype=np.int32)
    n = max(1, len(codes) - shingle + 1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(min(shingle, len(codes))):
        h = mixed(h * np.uint64(31) + codes[i : i + n] + np.uint64(i + 1))
    return np.unique((h >> np.uint64(33)).astype(np.int32))[:size]


def likeness(x: F.Column, y: F.Column, size: int) -> F.Column:
    """Jaccard similarity of two shingle sets by their sketches: exact while both sets together have at most `size` shingles. Two empty sets are alike."""
    least = F.slice(F.array_sort(F.array_union(x, y)), 1, size)
    return F.when(F.size(least) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(least, x), y)) / F.size(least))


def lone_parts(texts: DataFrame) -> DataFrame:
    """(th, n, lone): the size of each text's sketch, and how many of its hashes no other of these texts has."""
    each = texts.select("th", F.explode("sk").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("th").alias("th")).where("c = 1")
    alone = each.groupBy(F.col("th").alias("_t")).agg(F.count(F.lit(1)).cast("int").alias("lone"))
    return texts.select("th", F.size("sk").alias("n")).join(alone, F.col("th") == F.col("_t"), "left").select("th", "n", F.coalesce("lone", F.lit(0)).alias("lone"))


def could_be_alike(size: int, similarity: float, figures: dict[str, F.Column] | None = None) -> F.Column:
    """Whether two texts (n_u, lone_u, n_v, lone_v: columns, or as given) of lone_parts may reach the similarity: what they share is at most what each has in common with any. Unknown figures say yes."""
    x = figures or {c: F.col(c) for c in ("n_u", "lone_u", "n_v", "lone_v")}
    shared = F.least(x["n_u"] - x["lone_u"], x["n_v"] - x["lone_v"])
    known = x["n_u"].isNotNull() & x["n_v"].isNotNull()
    return ~known | (shared >= F.lit(similarity - 1e-9) * F.least(F.lit(size), x["n_u"] + x["n_v"] - shared))


#: Longs of a text's marks.
MARKS = 8
#: Texts of a coarse cell from which on their marks go along with their fingerprints. It decides the effort alone.
DENSE = 8


def marks(texts: DataFrame) -> DataFrame:
    """(th, size, marks): the size of a sketch and, for each of 64 * MARKS places, whether an odd number of its hashes falls there.

    Hashes that only one of two sketches has change one mark each, so the marks that differ are at most these hashes."""
    schema = pa.schema([("th", pa.int64()), ("size", pa.int32()), ("marks", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sk = batch.column("sk")
            sizes = sk.value_lengths().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(sizes)), sizes) * (64 * MARKS) + sk.flatten().to_numpy(zero_copy_only=False) % (64 * MARKS)
            odd = (np.bincount(at, minlength=len(sizes) * 64 * MARKS) & 1).astype(np.uint8)
            words = np.packbits(odd, bitorder="little").view(np.int64)
            yield to_batch({"th": batch.column("th"), "size": sizes, "marks": pa.array(list(words.reshape(len(sizes), MARKS)), type=pa.list_(pa.int64()))}, schema)

    return texts.select("th", "sk").mapInArrow(run, "th long, size int, marks array<long>")


def alike_by_marks(size: int, similarity: float, sizes: tuple[F.Column, F.Column] | None = None) -> F.Column:
    """Whether two texts (size_u, marks_u, size_v, marks_v; sizes: columns, or as given) may reach the similarity: half of what both hold without the marks that differ is the most that they share."""
    size_u, size_v = sizes or (F.col("size_u"), F.col("size_v"))
    differ = sum((F.bit_count(F.col("marks_u")[i].bitwiseXOR(F.col("marks_v")[i])) for i in range(1, MARKS)), F.bit_count(F.col("marks_u")[0].bitwiseXOR(F.col("marks_v")[0])))
    both = size_u + size_v
    shared = (both - differ) / 2
    return shared >= F.lit(similarity - 1e-9) * F.least(F.lit(size), both - shared)


def alike_texts(texts: DataFrame, most_bits: int, similarity: float, size: int) -> DataFrame:
    """(node, label) of texts (th, fps, sk) that have others alike, by th; label: the least th of a component.

    Every pair of texts of which a fingerprint differs in most_bits or fewer, or not at all, is compared by sketch, unless
    links found before join both already, or so many hashes of one are its own, or so many marks of both differ, that they cannot be alike. So components
    are those of all such pairs, and a dense group makes few pairs, be its texts alike (its stars join them) or not
    (each has too much of its own, or their marks tell them apart as they meet). Figures of lone hashes are of the texts in
    coarse cells of two or more, and used between these alone; marks go with the texts of cells of DENSE or more, and are looked up
    for the pairs of others.
    """
    def verified(pairs: DataFrame, name: str) -> DataFrame:
        x, y = (texts.select(F.col("th").alias(c), F.col("sk").alias(f"sk_{c}")) for c in "uv")
        return settle(pairs.join(x, "u").join(y, "v").where(likeness(F.col("sk_u"), F.col("sk_v"), size) >= similarity).select("u", "v"), name)

    fps = texts.select("th", F.posexplode("fps").alias("k", "fp"))
    cells = settle(coarse_cells(texts.select(F.col("th").alias("node"), "fps")), "near-cells")
    tried = settle(star_pairs(cells), "near-tried")
    near = tried.select(F.explode(F.array("u", "v")).alias("th")).distinct()
    lone = settle(lone_parts(texts.join(near, "th", "left_semi")), "near-lone")
    sides = [lone.select(F.col("th").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "lone"))) for c in "uv"]
    stars = verified(tried.join(sides[0], "u").join(sides[1], "v").where(could_be_alike(size, similarity)).select("u", "v"), "near-stars")
    joined = settle(link_components(stars, "near-stars"), "near-joined").select(F.col("node").alias("_n"), F.col("label").alias("known"))
    figures = lone.select(F.col("th").alias("_t"), "n", "lone")
    crowded = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= DENSE)
    dense = cells.join(crowded, "cell", "left_semi").select(F.col("node").alias("th")).distinct()
    # A text of a dense cell is a row of its own, `own`, with its marks.
    known_marks = settle(marks(texts.join(dense, "th", "left_semi")).select(F.col("th").alias("own"), "marks"), "near-dense")
    placed = fps.join(joined, fps["th"] == joined["_n"], "left").join(figures, F.col("th") == F.col("_t"), "left").join(known_marks.select("own"), F.col("th") == F.col("own"), "left")
    placed = settle(placed.select("th", "k", "fp", "known", "n", "lone", "own"), "near-placed")
    # A fingerprint of several texts has no figures, and no `known` if they are not all joined, and so is left out of no pair.
    one_text = F.count(F.lit(1)) == 1
    whole = F.when((F.count("known") == F.count(F.lit(1))) & (F.min("known") == F.max("known")), F.min("known"))
    own = settle(placed.groupBy("k", "fp", "own").agg(whole.alias("known"), *(F.when(one_text, F.min(c)).alias(c) for c in ("n", "lone")), F.count(F.lit(1)).alias("texts")), "near-prints")
    open_pair = not_joined() & could_be_alike(size, similarity)
    # Both figures travel as one number.
    packed = own.join(known_marks, "own", "left").select("k", "fp", "own", "known", (F.col("n") * (size + 1) + F.col("lone")).alias("figures"), "marks")
    parts = {f"{x}_{c}": F.expr(f"figures_{c} {op} {size + 1}").cast("int") for c in "uv" for x, op in (("n", "div"), ("lone", "%"))}
    unlike = ~F.coalesce(alike_by_marks(size, similarity, (parts["n_u"], parts["n_v"])), F.lit(True))
    links = fingerprint_links(packed.repartition("k", "fp"), most_bits, "k", ("own", "known", "figures", "marks"), not_joined() & could_be_alike(size, similarity, parts) & ~unlike, "own")
    several = own.where("texts > 1 and known is null").select("k", F.col("fp").alias("u"), F.col("fp").alias("v"), F.col("own").alias("own_u"), F.col("own").alias("own_v"))
    # Marks are fetched for the texts of links alone, and leave few of the pairs of a group whose texts are not alike.
    met = links.select("k", "u", "v", "own_u", "own_v").unionByName(several)
    ends = met.select("k", F.explode(F.array("u", "v")).alias("fp")).distinct()
    members = settle(placed.join(ends, ["k", "fp"], "left_semi").join(marks(texts), "th"), "near-members")
    one, two = (members.select(F.col("k").alias(f"_k_{c}"), F.col("fp").alias(f"_{c}"), F.col("own").alias(f"_own_{c}"), *(F.col(x).alias(f"{x}_{c}") for x in ("th", "known", "n", "lone", "size", "marks"))) for c in "uv")
    same = [(F.col("k") == F.col(f"_k_{c}")) & (F.col(c) == F.col(f"_{c}")) & F.col(f"own_{c}").eqNullSafe(F.col(f"_own_{c}")) for c in "uv"]
    apart = open_pair & ((F.col("u") < F.col("v")) | ~F.col("own_u").eqNullSafe(F.col("own_v")) | (F.col("th_u") < F.col("th_v")))
    pairs = met.join(one, same[0]).join(two, same[1]).where(apart & alike_by_marks(size, similarity))
    pairs = settle(pairs.select(F.least("th_u", "th_v").alias("u"), F.greatest("th_u", "th_v").alias("v")).distinct(), "near-pairs")
    edges = verified(pairs, "near-edges")
    found = link_components(edges.union(stars), "near-links")
    release(cells, tried, lone, known_marks, placed, own, links, members, pairs)
    return found


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, n_prints: int = 4, most_bits: int = 4, size: int = 192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns as they were, with one row of each group of near-duplicates: that of the smallest id, null ids
    last; of rows with that id the one with the smallest hash over all columns, and one of fully equal rows.

    Texts are linked if their sets of word shingles (of 5 words, A-Z in lower case) have a Jaccard similarity of 0.8 or
    more, estimated from the `size` least hashes of both where they have more; groups are the components of links.
    Candidates are texts of which one of n_prints SimHash fingerprints over the distinct words differs in most_bits or
    fewer (0 to 4); more find more, and make more links in a dense group. Copies are one text there. A null text counts as empty; texts without words are alike. Texts are hashed whole.
    """
    text = F.coalesce(docs[text_col], F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("th", pa.int64()), ("fps", pa.list_(pa.int64())), ("sk", pa.list_(pa.int32()))])
        for batch in batches:
            for part in pieces(batch, "text"):
                own = part.column("text").to_pylist()
                yield to_batch({"th": part.column("th"), "fps": [word_prints(t, n_prints) for t in own], "sk": pa.array([sketch(t, shingle, size) for t in own], type=pa.list_(pa.int32()))}, schema)

    # Rows keep the hash of their text alone; what texts are compared by is kept once for each text.
    th = F.xxhash64(text).alias("th")
    prints = settle(docs.select(docs[id_col].alias("id"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("rid"), th), "near-rows")
    each = docs.select(th, text.alias("text")).mapInArrow(run, "th long, fps array<long>, sk array<int>")
    texts = settle(each.groupBy("th").agg(F.first("fps").alias("fps"), F.first("sk").alias("sk")), "near-distinct")
    label = settle(alike_texts(texts, most_bits, similarity, size), "near-labels").withColumnRenamed("node", "_node")
    rows = prints.join(label, prints["th"] == label["_node"], "left").select("id", "rid", F.coalesce("label", "th").alias("label"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    best = rows.groupBy("label").agg(F.min(first).alias("best")).select(F.col("best.rid").alias("_rid"))
    many = prints.groupBy("rid").agg(F.count(F.lit(1)).alias("_n"))
    best = settle(best.join(many, best["_rid"] == many["rid"]).select("_rid", "_n"), "near-best")
    release(texts, prints)
    kept = pick(docs).withColumn("rid", F.xxhash64(*[F.col(f"row.`{c}`") for c in docs.columns])).join(best, F.col("rid") == best["_rid"])
    once = kept.where("_n = 1").select("row")
    return once.union(kept.where("_n > 1").groupBy("rid").agg(F.first("row").alias("row")).select("row")).select("row.*")
