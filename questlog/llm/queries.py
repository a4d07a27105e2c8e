"""Registered corpus queries: each applies one operator to its whole table, with production settings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from questlog.llm import alignment, bpe, langid, lm, minhash, mixing, packing, pq, sharding, simhash, toxicity, warc, whitening
from questlog.llm.oracles import archives_sql, mixing_sql, near_vectors_sql


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pq_near_dedup(spark, sf_dir):
    return pq.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.95)


MAX_COPIES = 4  # of one document: more repetition gives a model little
DRAWS = {"target": math.inf, "once": 1.0}  # beside it: as many copies as the targets take, and no document twice


def op2_mixing(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    items = docs.select("doc_id", "source", "lang", mixing.topic_of(F.col("text")).alias("topic"), mixing.token_count(F.col("text")).alias("tokens"))
    mixed = mixing.mix(mixing.materialise(items), max_copies=MAX_COPIES, also=DRAWS)  # what full cells cannot give, the others give
    return mixed.withColumns({c: F.round(c, 6) for c in ("weight", "rate", *(f"{d}_rate" for d in DRAWS))})


def op3_language_id(spark, sf_dir):
    return langid.identify(_read(spark, sf_dir, "documents"), folds=4, held_out=2)


def op4_fingerprints(spark, sf_dir):
    return minhash.fingerprints(_read(spark, sf_dir, "documents"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_counts(spark, sf_dir):
    return bpe.token_table(_read(spark, sf_dir, "documents"), vocabulary_path(), limit=512)


def op6_simhash(spark, sf_dir):
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc_index(spark, sf_dir):
    back = warc.round_trip(_read(spark, sf_dir, "pages"), min_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark, sf_dir):
    return packing.pack_documents(_read(spark, sf_dir, "documents"), vocabulary_path())


def op9_lm_scores(spark, sf_dir):
    return lm.score_documents(_read(spark, sf_dir, "documents"), train=langid.fold(F.col("doc_id"), 5) != 1)


def op10_sharding(spark, sf_dir):
    return sharding.assign_shards(_read(spark, sf_dir, "documents"), shards=24)


def op11_toxicity(spark, sf_dir):
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), folds=4, held_out=2, threshold=0.3)


def op12_whitening(spark, sf_dir):
    return whitening.whiten(_read(spark, sf_dir, "embeddings"), count=4)


def op13_alignment(spark, sf_dir):
    import public_tokenizers

    return alignment.align(_read(spark, sf_dir, "documents"), vocabulary_path(), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_pq_near_dedup, op2_mixing, op3_language_id, op4_fingerprints, op5_token_counts, op6_simhash, op7_warc_index, op8_packing, op9_lm_scores, op10_sharding, op11_toxicity, op12_whitening, op13_alignment)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {"op1_pq_near_dedup": near_vectors_sql(), "op2_mixing": mixing_sql(), "op7_warc_index": archives_sql()}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
