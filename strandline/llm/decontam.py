"""Benchmark decontamination: one Aho-Corasick automaton over the windows of test items."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import pieces, settle

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Upper case to lower case, all that is not in a word to a blank.
PLAIN = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
FOUND = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"
FOUND_ARROW = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]


class ItemMatcher:
    """The automaton of a block of items; its letters are the block's words."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in text.encode().translate(PLAIN).split())
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(ids[i : i + window], set()).add(item)
        self.least = min(map(len, owners), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in owners.items():
            self.automaton.add_word(key, (len(key), tuple(who)))
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, np.ndarray | None, set[str]]:
        """Number of words, which words are hit (None: none), the items found."""
        words = text.encode().translate(PLAIN).split()
        if not self.least or len(words) < self.least:
            return len(words), None, set()
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), dtype=np.int64, count=len(words))
        # Only stretches of known words, as long as the shortest window, can hold one.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids != 0, [0]))))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.least
        change, found = None, set()
        for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            for last, (n, who) in self.automaton.iter(tuple(ids[s:e].tolist())):
                if change is None:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                change[s + last - n + 1] += 1
                change[s + last + 1] -= 1
                found.update(who)
        return len(words), None if change is None else np.cumsum(change[:-1]) > 0, found


def word_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends in the original text, in characters."""
    data = text.encode()
    at = np.array([m.span() for m in WORD.finditer(data)], dtype=np.int64).reshape(-1, 2)
    is_start = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(is_start)))
    return chars[at[:, 0]], chars[at[:, 1]]


def word_of(offsets: np.ndarray, spans: list) -> np.ndarray:
    hit = np.zeros(len(offsets), dtype=bool)
    for x in spans:
        hit[np.searchsorted(offsets, x["start"]) : np.searchsorted(offsets, x["end"])] = True
    return hit


_built: dict[str, ItemMatcher] = {}


def find_items(docs: DataFrame, items: DataFrame, window: int = 13, item_col: str = "item_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted) and spans of the original text that items cover.

    docs must have no columns of these names; `text_col` is the text in both. Words are runs of digits,
    letters and non-ASCII characters, A-Z in lower case. A null or empty text has no words and no hits; items
    with a null id or no words are not searched; repeated items count once. The automaton is broadcast. Items
    beyond block_bytes are searched in blocks of about that size, a pass over the documents each, so any
    number of items can be given. Rows are neither moved nor dropped.
    """
    spark = docs.sparkSession
    items = items.where(items[item_col].isNotNull() & items[text_col].isNotNull()).select(items[item_col].cast("string").alias("i"), items[text_col].alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for block in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == block).distinct()
        held = spark.sparkContext.broadcast([(r.i, r.t) for r in own.collect()])

        def run(batches: Iterator[pa.RecordBatch], held=held, key=uuid.uuid4().hex, more=block > 0) -> Iterator[pa.RecordBatch]:
            matcher = _built.get(key)
            if matcher is None:
                _built.clear()
                matcher = _built[key] = ItemMatcher(held.value, window)
            for batch in batches:
                for part in pieces(batch, text_col):
                    texts = part.column(text_col).to_pylist()
                    before = part.select(["item_ids", "spans"]).to_pylist() if more else repeat(None)
                    out: list[list] = [[], [], [], []]
                    for t, b in zip(texts, before, strict=False):
                        n, hit, found = matcher.scan(t or "")
                        spans = b["spans"] if b else []
                        if hit is not None:
                            starts, ends = word_offsets(t)
                            hit |= word_of(starts, spans)
                            edges = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
                            spans = [{"start": int(starts[x]), "end": int(ends[y - 1])} for x, y in zip(edges[::2], edges[1::2], strict=True)]
                            n_hit = int(hit.sum())
                        elif spans:
                            n_hit = int(word_of(word_offsets(t)[0], spans).sum())
                        else:
                            n_hit = 0
                        for to, x in zip(out, (n, n_hit, sorted(found | set(b["item_ids"] if b else ())), spans), strict=True):
                            to.append(x)
                    cols = [part.column(c) for c in names] + [pa.array(x, type=k) for x, (_, k) in zip(out, FOUND_ARROW, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=[*names, *(c for c, _ in FOUND_ARROW)])

        docs = docs.mapInArrow(run, f"{schema}, {FOUND}")
        if block + 1 < n_blocks:
            docs = settle(docs, "decontam")
    return docs


def contaminated(share_of: int = 20) -> F.Column:
    """Whether at least one word in `share_of` is hit."""
    return (F.col("n_hit") > 0) & (F.lit(share_of) * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, text_col: str = "text") -> DataFrame:
    """docs, all columns as they were, without the contaminated rows. Other columns may be named anything."""
    whole = docs.select(docs[text_col].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    found = find_items(whole, items, window)
    return found.where(~contaminated()).select("row.*")
