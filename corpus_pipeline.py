"""A corpus pipeline in stages: each takes the documents that the one before it kept.

``run(spark, sf_dir)`` applies all stages to the table `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from questlog.llm import langid, mixing, packing, simhash
from questlog.session import materialise


LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: those without a letter, and those for which no language has half of the evidence, go."""
    model = langid.fit(docs.filter(langid.fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    found = docs.select(F.struct("*").alias("row"), langid.predicted(F.col("text"), model, spark).alias("p"))
    return found.filter((F.col("p.lang_pred") != langid.UNDETERMINED) & (F.col("p.score") >= LEAST_SCORE)).select("row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id, of rows with that id one text, of repeated rows
    one. A document without an id stays only where its group has no other. All columns are kept."""
    found = simhash.near_duplicates(docs)
    chosen = materialise(found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))).alias("keep"))
                         .select("keep.kept_id", "keep.kept_hash"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    kept = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")), "left_semi")
    once = Window.partitionBy("doc_id", "text_hash").orderBy("text_hash")
    return kept.withColumn("copy", F.row_number().over(once)).filter("copy = 1").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by rates that rake source, language and topic to their targets; at most one copy of each."""
    items = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col("lang").alias("lang"),
                        mixing.topic_of(F.col("text")).alias("topic"), mixing.token_count(F.col("text")).alias("tokens"))
    return mixing.mix(items, carry="row").filter("copies > 0").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all kept documents with their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_stage), ("simhash", simhash_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table `documents`; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
