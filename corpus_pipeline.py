"""A training corpus from raw documents, in five stages.

Each stage works on all rows that its predecessor kept. The first four return
the columns of ``documents``; the last returns packed pieces.

In all stages a null text is an empty one, other nulls pass through, extra
columns of the input are ignored, and an empty table gives an empty one.
Repeated rows are scored, and packed, each; of equal or similar texts one row
stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import remove, scratch_path, table
from spindle.llm.packing import packed_documents
from spindle.llm.quality import quality_scores
from spindle.llm.queries import WORD_BPE
from spindle.llm.simhash import similar_texts
from spindle.llm.suffix_dedup import remove_repeats
from spindle.llm.toxicity import toxicity_scores

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]
#: Bits of the near-duplicate stage's fingerprints, and the chance to meet a pair just similar enough.
BITS, RECALL = 512, 0.99


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject (score below 0.5); empty texts and rows without an id are scored like any other."""
    scores = toxicity_scores(docs, table(spark, sf_dir, "labels"), threshold=0.5, keep=REST)
    return scores.where("predicted = 0").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.3 or more); without labels the score is the base rate."""
    scores = quality_scores(docs, table(spark, sf_dir, "labels"), threshold=0.3, keep=REST)
    return scores.where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of a similarity of 0.8 over five-word shingles, or more.

    The similarity is the Jaccard similarity of the sets of shingles; SimHash
    fingerprints find the pairs to compare. Rows are judged by their own text,
    also where several have one doc_id: each group keeps one row. Documents
    without a doc_id stay.
    """
    found = similar_texts(docs, similarity=0.8, words=5, bits=BITS, recall=RECALL)
    first = found.where("first").select(F.col("doc_id").alias("own_id"), "text_key").distinct()
    own = (F.col("doc_id").cast("long") == F.col("own_id")) & (F.xxhash64("text") == F.col("text_key"))
    kept = docs.where("doc_id is not null").join(first, own).groupBy("own_id", "text_key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return kept.select(*(F.col(f"row.{c}").alias(c) for c in COLUMNS)).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that also start in an earlier document; emptied documents go.

    A character of which only some bytes were removed is dropped.
    """
    out = remove_repeats(docs, length=50, keep=REST)
    valid = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(valid)
    out = out.withColumn("cut", text).where("n_removed = 0 or length(trim(cut)) > 0")
    return out.select("doc_id", F.col("cut").alias("text"), "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("cut").cast("long")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed into sequences; an empty text is one piece with the end id."""
    return packed_documents(docs, WORD_BPE, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeats),
    ("best_two_fit_packing", packing),
]

#: The stages are not expressible in SQL; they are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; every stage is written to the shared folder and read again, and removed once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(path := scratch_path(spark, f"stage-{name}"))
            docs = spark.read.schema(docs.schema).parquet(path)
            if before is not None:
                remove(spark, before)  # nothing reads the stage before the last any more
            before = path
    return docs
