"""Every stage of the pipeline on nulls, repeated rows, empty tables and columns whose names clash with its own."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

BASE = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that stages use for columns of their own.
CLASHING = ("n_words", "n_hit", "n_items", "item_ids", "items", "spans", "contaminated", "id", "h", "th", "fp", "k", "row", "at", "block", "slot", "release", "deadline", "position", "size", "shard", "law", "kept", "posterior", "n", "w", "turn", "share", "words", "component_id", "text_crc32", "grown_shard")
NEW = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}


@pytest.fixture(scope="module")
def odd_docs(spark, sf_dir):
    good = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(12).collect()]
    rows = [*good, good[0], good[0], (None, good[1][1], None, None, None), (None, None, None, None, None), (900, "", "en", "s", 0), (901, "word " * 40_000, None, None, 1), (902, None, "en", "s", None), (903, "é😀 zażółć", "pl", None, 3)]
    return spark.createDataFrame(rows, BASE)


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_stage_on_odd_rows_and_clashing_names(spark, sf_dir, odd_docs, name, stage):
    plain = [tuple(r) for r in stage(spark, odd_docs, sf_dir).select("doc_id", "text").collect()]
    more = odd_docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    out = stage(spark, more, sf_dir)
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(plain)
    if name == "sharding":
        assert set(out.columns) == set(more.columns) | NEW
        assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in odd_docs.collect())
        assert all(r["size"] == len((r.text or "").encode()) + 16 for r in got)
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    else:
        assert out.columns == more.columns
    own = [c for c in CLASHING if name != "sharding" or c not in NEW]
    assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in got for c in own)


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_stage_on_an_empty_table(spark, sf_dir, odd_docs, name, stage):
    out = stage(spark, odd_docs.limit(0), sf_dir)
    assert out.count() == 0 and set(out.columns) == set(odd_docs.columns) | (NEW if name == "sharding" else set())
