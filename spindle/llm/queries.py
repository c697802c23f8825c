"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.alignment import aligned_documents
from spindle.llm.common import table
from spindle.llm.hard_negatives import hard_negatives
from spindle.llm.kneser_ney import language_scores
from spindle.llm.multi_index import near_duplicate_vectors
from spindle.llm.packing import packed_documents
from spindle.llm.quality import quality_scores
from spindle.llm.simhash import near_duplicates
from spindle.llm.suffix_dedup import remove_repeats
from spindle.llm.tiff import stored_documents, tiff_pages
from spindle.llm.token_count import token_counts
from spindle.llm.token_files import encoded_digests
from spindle.llm.toxicity import toxicity_scores
from spindle.llm.transducer import encode_documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stored_documents(table(spark, sf_dir, "documents"))
    stored = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    pages = tiff_pages(stored, ("doc_id", "n_bytes", "media_bytes", "media_sha256"), "media", nested=True)
    read = pages.select("*", F.unhex(F.array_join(F.transform("pages", lambda p: F.hex(p["pixels"])), "")).alias("payload"))
    first = F.element_at("pages", 1)
    rows = F.aggregate("pages", F.lit(0), lambda a, p: a + p["height"])
    mean = F.aggregate("pages", F.lit(0.0), lambda a, p: a + p["mean"] * p["height"]) / rows
    feature = F.concat_ws(
        ";", F.size("pages"), first["width"], rows, first["compression"], first["predictor"], first["tiled"].cast("int"), F.format_string("%.6f", mean)
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
        F.size("pages").alias("n_pages"),
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), tau=3, words=3)
    # the bytes are stored lowest first
    digits = F.concat(*(F.substring(F.hex("fp"), 15 - 2 * i, 2) for i in range(8)))
    return out.select("doc_id", F.lower(digits).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, limit=1024)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), WORD_BPE, capacity=2048)


def op8_transducer_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents"), WORD_BPE)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10_multi_index_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return hard_negatives(own.select("vec_id", label.alias("label"), whole.alias("vector")), F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


#: All anchors against all rows.
OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other_id)::INT AS rank,
  n.other_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
QUALIFY rank <= 3
"""


def op12_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return language_scores(table(spark, sf_dir, "documents"), held_out)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tiff_media": op1_tiff_media,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_token_files": op6_token_files,
    "op7_best_two_fit_packing": op7_best_two_fit_packing,
    "op8_transducer_codec": op8_transducer_codec,
    "op9_quality": op9_quality,
    "op10_multi_index_near_dedup": op10_multi_index_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_kneser_ney": op12_kneser_ney,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {"op11_hard_negatives": OP11_SQL}
