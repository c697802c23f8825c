"""Labelled rows for the classifiers: the split, and a bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 1_000_000


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id, text, y``: labelled rows that are not held out, about ``most`` of them at most.

    Rows are chosen by a hash of the id, with the share that gives ``most`` rows
    from all. Rows whose label is not 0 or 1, or whose id is null, are left out;
    a document labelled twice counts by its largest label.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    share = PARTS if n <= most else int(PARTS * most / n)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(PARTS)) < share)
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return own.join(chosen, "doc_id")
