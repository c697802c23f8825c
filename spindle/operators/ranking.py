"""Ranking of labels against a search phrase."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_rank(label: str, exact: str, prefixes: Sequence[str], parts: Sequence[str]) -> Column:
    """0 for the phrase itself, 1 for one of the prefixes, 2 for one of the parts, else null; case is ignored."""
    low = F.lower(label)
    starts, holds = F.lit(False), F.lit(False)
    for p in prefixes:
        starts = starts | low.startswith(p.lower())
    for p in parts:
        holds = holds | low.contains(p.lower())
    return F.when(low == exact.lower(), 0).when(starts, 1).when(holds, 2)


def is_variant(label: Column | str) -> Column:
    """True for labels that number a variant: a number after the last comma, or "type" and a number."""
    low = F.lower(label)
    return low.rlike(r",\s*[0-9]+\s*$") | low.rlike(r"\btype\s+[0-9]+\b")


def scored_terms(terms: DataFrame, phrase: str, most: int) -> DataFrame:
    """The ``most`` best of ``terms(id, label, relevance, obsolete)``: exact 4, first word as prefix 3, last word inside 2.

    Equal scores: an exact label, labels that number no variant, the greater
    relevance (null counts 0), terms in use, the length nearest to the
    phrase's, the longer label, the id.
    """
    words = phrase.lower().split()
    low = F.lower(F.trim("label"))
    score = F.when(low == phrase.lower(), 4).when(low.startswith(words[0]), 3).when(low.contains(words[-1]), 2).otherwise(0)
    rows = terms.withColumn("score", score.cast("long")).where("score > 0")
    order = [
        F.desc("score"), F.desc(low == phrase.lower()), is_variant("label"), F.desc(F.coalesce("relevance", F.lit(0.0))), F.coalesce("obsolete", F.lit(False)),
        F.abs(F.length("label") - len(phrase)), F.desc(F.length("label")), F.col("id"),
    ]
    return rows.orderBy(*order).limit(most)


def facets(rows: DataFrame, fields: Sequence[str], most: int = 15, where: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``field, value, n, rank``: the ``most`` frequent values of each field (ties by value) among rows that pass the filters.

    ``where`` maps a field to the values wanted; a facet is not narrowed by its
    own filter, so that the other values of a chosen field stay to be seen.
    Nulls are no values.
    """
    where = where or {}
    cells = []
    for f in fields:
        others = [F.col(g).isin(*v) for g, v in where.items() if g != f]
        keep = reduce(lambda a, b: a & b, others, F.lit(True))
        cells.append(F.when(keep & F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))))
    each = rows.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).groupBy("c.field", "c.value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return each.withColumn("rank", rank).where(F.col("rank") <= most)
