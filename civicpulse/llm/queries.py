"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.llm import (
    conversations,
    decontamination,
    jaccard,
    merkle,
    neighbours,
    packing,
    pii,
    quality,
    repeats,
    sharding,
    simhash,
    tokens,
    urls,
)
from civicpulse.llm.common import table

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "n_equal")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), SHARDS)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def fold() -> F.Column:
    """The remainder that decides which rows are held out; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(fold() != 2))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "score", "predicted")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered)
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings("proof").cast("binary"), 256).alias("proof_sha256"),
        "folded_root", "verified",
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_personal_data, op3_repeated_passages, op4_token_counts, op5_nearest_neighbours,
        op6_decontamination, op7_sharding, op8_packing, op9_jaccard_join, op10_quality,
        op11_simhash_near_dedup, op12_merkle_manifest, op13_conversation_repair,
    )
}

#: Queries that DuckDB can express.
ORACLES: dict[str, str] = {
    "op1_url_filter": urls.judge_sql(),
    "op3_repeated_passages": repeats.REPEATS_SQL,
    "op7_sharding": sharding.place_sql(SHARDS),
    "op9_jaccard_join": jaccard.CLASSES_SQL,
    "op11_simhash_near_dedup": simhash.near_duplicates_sql(),
    "op12_merkle_manifest": merkle.MANIFEST_SQL,
    "op13_conversation_repair": conversations.REPAIR_SQL,
}
