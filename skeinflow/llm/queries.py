"""One query for each operator of this folder, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, language_id, language_model, line_dedup, mixing, neighbours, pii, sharding, simhash, token_counts

#: Where the session has the key of the pseudonyms; the default serves tests only.
PII_KEY, PII_TEST_KEY = "spark.skeinflow.pii.key", "not a secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(_table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), spark.conf.get(PII_KEY, PII_TEST_KEY))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_line_dedup": op2_line_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_token_counts": op4_token_counts,
    "op5_pii": op5_pii,
    "op6_language_id": op6_language_id,
    "op7_language_model": op7_language_model,
    "op8_decontamination": op8_decontamination,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_shard_documents": op10_shard_documents,
}

ORACLES = {
    "op8_decontamination": decontamination.oracle_sql(),
    "op3_nearest_neighbours": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where embedding is not null and len(embedding) > 0
), good as (
  select vec_id, e from v
  where len(list_filter(e, lambda x: x is not null and isfinite(x))) = len(e) and len(list_filter(e, lambda x: x <> 0)) > 0
), pairs as (
  select q.vec_id as query_id, c.vec_id, list_distance(q.e, c.e) as score
  from good q join good c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)
  where q.vec_id % 100 = 0
), ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as integer) as rank, vec_id, score from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 10
""",
}
