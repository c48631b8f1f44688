"""From raw documents to shards: rules, near-duplicates, benchmark passages, mix, shards.

Stages take and give the columns of documents (doc_id, text, lang, source, n_chars and any others); the last adds its own.
Null texts have no words: the rules reject them. Null ids, sources and other columns pass through; repeated rows are one
document to the near-duplicate stage and several to the others. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm import decontam, mixing, rules, shards, simhash
from strandline.llm.common import release, settle


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have too few words; repeated rows are judged alike."""
    return rules.drop_bad(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8), that of the smallest id; null ids come last, one of equal rows stays."""
    return simhash.drop_near_duplicates(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty is of a benchmark passage. Null and empty texts stay; null items are not searched."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources interleave at their target weights. Null is a source like any other."""
    return mixing.mixed_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with the shard and the slot that each goes to: 40 shards of near-equal bytes, whose slots follow the mix. A null text counts as empty; null ids and repeated rows have places of their own.
    Columns of the input named size, text_crc32, law, shard, slot or grown_shard give way to the stage's own."""
    # A table that is read again has no order, so the positions come from the schedule once more, the same for the same rows.
    # Texts are moved once, at the end: rows meet their places by a hash of all columns, equal rows one to one.
    rid = F.xxhash64(*[docs[c] for c in docs.columns])
    rows = mixing.schedule(docs, carry=[*shards.measures(docs), rid.alias("_rid")]).select("position", "row.*")
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    nth = Window.partitionBy("_rid").orderBy("slot", "shard")
    places = shards.place_rows(rows, keep=("_rid",), along="position").withColumn("_m", F.row_number().over(nth)).select(F.col("_rid").alias("_r"), "_m", *new)
    own = docs.withColumn("_rid", rid).drop(*new).withColumn("_n", F.row_number().over(Window.partitionBy("_rid").orderBy("_rid")))
    return own.join(places, (own["_rid"] == places["_r"]) & (own["_n"] - places["_m"] == 0)).drop("_rid", "_n", "_r", "_m")


STAGES = [("quality rules", keep_good), ("near-duplicates", one_of_each), ("decontamination", clean_of_benchmark), ("mixing", mix), ("sharding", shard)]

#: SQL can express neither the estimation nor the links; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
