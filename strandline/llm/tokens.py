"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import pieces, to_batch

#: The white space that the tokenizer's own \s means, unlike str.split() without the separators 1C to 1F.
SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Fixed value: how a stretch without white space falls apart before merging.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
NEVER = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next free one from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordMerger:
    """Counts tokens of texts as a word-end BPE tokenizer file gives them."""

    def __init__(self, spec: str, most_cached: int = 400_000) -> None:
        data = json.loads(spec)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        end = data["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.last = np.array([vocab[x + end] for x in letters], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        specials = [x["content"] for x in data["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.cache: dict[str, int] = {}
        self.most_cached = most_cached

    def counts_of_words(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token. All are held in one flat array; in each round every pre-token merges
        its lowest-ranked pair, all places at once, and pre-tokens with no pair left drop out."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        done = lengths.copy()
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[flat[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols) > 1:
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(hit, self.ranks[at], NEVER), NEVER)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            done[owner[starts]] = sizes
            chosen = np.flatnonzero((rank == np.repeat(least, sizes)) & (rank < NEVER))
            if not len(chosen):
                break
            # Of overlapping places (one letter repeated) every second merges, from the left.
            new_run = np.append(True, np.diff(chosen) != 1)
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
            symbols[chosen] = self.made[at[chosen]]
            keep = np.repeat(least < NEVER, sizes)
            keep[chosen + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols) == 1:
            done[owner[0]] = 1
        return done

    def learn(self, stretches: set[str]) -> None:
        """Cache the counts of stretches without white space."""
        words: dict[str, int] = {}
        parts = []
        for s in stretches:
            found = WORDS.findall(s)
            parts.append((s, [words.setdefault(w, len(words)) for w in found]))
        counts = self.counts_of_words([w.encode() for w in words]).tolist() if words else []
        for s, ids in parts:
            self.cache[s] = sum(counts[i] for i in ids)

    def normal(self, text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Strings of special tokens count one each and part the text around them."""
        fixed, cut = [], []
        for t in texts:
            n = 0
            if self.special is not None and "<|" in t:
                segments = self.special.split(t)
                n = len(segments) - 1
            else:
                segments = [t]
            words: list[str] = []
            for s in segments:
                s = self.normal(s)
                words += s.split() if s.isascii() and not any(c in s for c in "\x1c\x1d\x1e\x1f") else [x for x in SPACE.split(s) if x]
            fixed.append(n)
            cut.append(words)
        if len(self.cache) > self.most_cached:
            self.cache.clear()
        new = set(chain.from_iterable(cut)).difference(self.cache)
        if new:
            self.learn(new)
        get = self.cache.__getitem__
        return [n + sum(map(get, words)) for n, words in zip(fixed, cut, strict=True)]


_merger: dict[str, WordMerger] = {}


def count_tokens(docs: DataFrame, spec_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    spec_path: a tokenizer file on the driver (word-end BPE, a few MB; it is broadcast). Null and empty texts
    have 0 bytes and 0 tokens. Ids may be null or repeat; each row is counted by itself. Other columns are not read.
    Texts are never cut; a batch is worked off in slices of about 8 MB.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(spec_path).read_text(encoding="utf-8"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger.get(spec.value)
        if merger is None:
            _merger.clear()
            merger = _merger[spec.value] = WordMerger(spec.value)
        for batch in batches:
            for part in pieces(batch, "t"):
                text = part.column("t").fill_null("")
                out = pa.schema([part.schema.field("i"), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
                yield to_batch({"i": part.column("i"), "n_bytes": pc.binary_length(text).cast(pa.int64()), "n_tokens": merger.counts(text.to_pylist())}, out)

    out = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, f"i {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("i").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
