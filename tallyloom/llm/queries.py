"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.ball_tree import top_inner_products
from tallyloom.llm.chat import format_conversations
from tallyloom.llm.edit_prints import compare_with_next, edit_classes
from tallyloom.llm.hyperplane_tree import mine_hard_negatives
from tallyloom.llm.licenses import scan_licenses
from tallyloom.llm.line_dedup import drop_shared_lines
from tallyloom.llm.near_dedup import near_duplicates
from tallyloom.llm.packing import packed_documents
from tallyloom.llm.phrases import mine_collocations
from tallyloom.llm.quality import judge_quality
from tallyloom.llm.scoring import score_documents
from tallyloom.llm.segmentation import decode_pieces, encode_sampled
from tallyloom.llm.sharding import assign_shards
from tallyloom.sources.staging import stage


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_documents(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_shared_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), digest.alias("kept_sha256")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = assign_shards(_documents(spark, sf_dir))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_documents(spark, sf_dir), path("word_bpe_49k.json"), digest=True)


def op5_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = path("piece_bpe_32k.model")
    decoded = decode_pieces(encode_sampled(_documents(spark, sf_dir), model), model)
    return decoded.select("doc_id", F.size("ids").alias("n_ids"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_documents(spark, sf_dir)).select(
        F.col("_key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def op7_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir))


def op9_edit_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = edit_classes(stage(compare_with_next(_documents(spark, sf_dir))))
    hexed = {"fingerprint": "fp", "edited_fingerprint": "edited_fp"}
    return compared.select(
        "doc_id", "n_chars", "edited_sha256", *[F.lower(F.hex(c)).alias(n) for n, c in hexed.items()], "near_edited", "near_next", "class_id"
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(_documents(spark, sf_dir))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_segmentation": op5_segmentation,
    "op6_quality": op6_quality,
    "op7_scoring": op7_scoring,
    "op8_licenses": op8_licenses,
    "op9_edit_prints": op9_edit_prints,
    "op10_chat": op10_chat,
    "op11_collocations": op11_collocations,
    "op12_top_k": op12_top_k,
    "op13_hard_negatives": op13_hard_negatives,
}
