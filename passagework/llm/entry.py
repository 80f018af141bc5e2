"""The registered queries of this package: thin digests of the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, embedding_whitening, html_consensus, merkle_manifest, mpeg_audio, piece_transducer, pipeline, quality_rules, source_mixing
from .common import table
from .lm_scoring import score_documents
from .near_dedup import near_duplicates
from .packing import pack
from .quality_mil import score_quality
from .token_counts import count_tokens


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = mpeg_audio.read_media(mpeg_audio.store_texts(table(spark, sf_dir, "documents")))
    at = F.md5(F.concat_ws(",", F.col("offsets").cast("array<string>")))
    return read.select(
        "doc_id", F.col("tags")["n_bytes"].cast("long").alias("n_bytes"), F.octet_length("ancillary").cast("long").alias("payload_bytes"),
        F.sha2("ancillary", 256).alias("payload_sha256"), F.crc32(F.substring("ancillary", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.format_string("layer %d kbit/s %s frames %d of %d samples %d seconds %d/%d crc %d+%d- resyncs %d seek %s", "layer", F.concat_ws(",", F.col("kbits").cast("array<string>")), "frames", "table_frames", "samples", "duration_num", "duration_den", "crc_ok", "crc_bad", "resyncs", at).alias("feature"),
        "frames", "samples", "duration_num", "duration_den",
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the documents that are labelled good."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"))


def op7_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, and what they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = piece_transducer.encode_texts(docs, model)
    return piece_transducer.digest(ids, model)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat_format.PROBE).alias("text"))
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    formatted = chat_format.format_chat(messages.withColumn("parts", chat_format.text_parts(F.col("text"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chat_format.read_chat(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extract_text(table(spark, sf_dir, "pages"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.planned(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that a long can't hold is null here."""
    return embedding_whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"), tampered)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_mpeg_audio": op2_mpeg_audio,
        "op3_packing": op3_packing,
        "op4_token_counts": op4_token_counts,
        "op5_quality_mil": op5_quality_mil,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_piece_transducer": op7_piece_transducer,
        "op8_chat_format": op8_chat_format,
        "op9_quality_rules": op9_quality_rules,
        "op10_html_consensus": op10_html_consensus,
        "op11_source_mixing": op11_source_mixing,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_merkle_manifest": op13_merkle_manifest,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_format": chat_format.ORACLE_SQL, "op9_quality_rules": quality_rules.ORACLE_SQL, "op11_source_mixing": source_mixing.ORACLE_SQL, "op13_merkle_manifest": merkle_manifest.ORACLE_SQL}
