"""Resolution of names to terms, drugs and genes by scored matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_score(label: Column | str, phrase: str) -> Column:
    """4 for the phrase itself, 3 if the label begins with it, 2 if it holds it, else null; case is ignored."""
    low = F.lower(label)
    return F.when(low == phrase.lower(), 4).when(low.startswith(phrase.lower()), 3).when(low.contains(phrase.lower()), 2)


def best_by_id(*matches: DataFrame) -> DataFrame:
    """``id, score, label, how``: of all ``matches(id, score, label, how)`` the best one of each id; ties go to the least label."""
    rows = reduce(DataFrame.unionByName, matches).where("score is not null")
    best = F.min(F.struct((-F.col("score")).alias("less"), "label", "how")).alias("b")
    return rows.groupBy("id").agg(best).select("id", (-F.col("b.less")).alias("score"), "b.label", "b.how")


def drugs(labels: DataFrame, aliases: DataFrame, brands: DataFrame, phrase: str, most: int = 10) -> DataFrame:
    """The ``most`` best drugs for a name: exact label 4, exact alias or brand of an ingredient 3, part of an alias 2.

    ``labels(id, label)``, ``aliases(id, alias)``, ``brands(brand, ingredient)``.
    """
    low = phrase.lower()
    of = lambda rows, score, label, how: rows.select("id", score.cast("int").alias("score"), F.col(label).alias("label"), F.lit(how).alias("how"))
    exact = of(labels.where(F.lower("label") == low), F.lit(4), "label", "label")
    alias = of(aliases, F.when(F.lower("alias") == low, 3).when(F.lower("alias").contains(low), 2), "alias", "alias")
    brand = of(brands.where(F.lower("brand") == low).withColumnRenamed("ingredient", "id"), F.lit(3), "brand", "brand")
    return best_by_id(exact, alias, brand).orderBy(F.desc("score"), "id").limit(most)


def within(candidates: DataFrame, allowed: DataFrame) -> DataFrame:
    """Candidates whose id is in ``allowed(id)``; all of them if none is."""
    marked = candidates.join(allowed.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left")
    # one row on the right
    some = marked.agg(F.coalesce(F.bool_or("_in"), F.lit(False)).alias("_some"))
    return marked.join(F.broadcast(some), how="cross").where("_in or not _some").drop("_in", "_some")


def resolved(terms: DataFrame, catalogue: DataFrame, phrase: str) -> DataFrame:
    """``id, label, confidence``: matching ``terms(id, label)`` with 1.0, 0.8 or 0.5; terms of the catalogue with 0.3 if there is none."""
    score = label_score("label", phrase)
    found = terms.withColumn("confidence", F.when(score == 4, 1.0).when(score == 3, 0.8).when(score == 2, 0.5)).where("confidence is not null")
    last = phrase.lower().split()[-1]
    other = catalogue.where(F.lower("label").contains(last)).withColumn("confidence", F.lit(0.3))
    # one row on the right
    none = found.agg((F.count("*") == 0).alias("_none"))
    other = other.join(F.broadcast(none), how="cross").where("_none").drop("_none")
    return found.unionByName(other)


def tiers(scored: DataFrame, by: str, most: int = 3) -> DataFrame:
    """Of each phrase the at most ``most`` terms of its best tier (4, then 3, then 2); terms in use go before obsolete ones."""
    best = scored.withColumn("_best", F.max("score").over(Window.partitionBy(by))).where("score = _best").drop("_best")
    rank = F.row_number().over(Window.partitionBy(by).orderBy("obsolete", "id"))
    return best.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def rescored(scored: DataFrame, synonyms: DataFrame, by: str, top: int = 5) -> DataFrame:
    """Raise partial matches (below 3) to 3 where the phrase is a synonym of one of its ``top`` best terms."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    equal = synonyms.select("id", F.lower("synonym").alias("_s")).distinct()
    rows = scored.withColumn("_rank", rank).join(equal, (scored.id == equal.id) & (F.lower(by) == F.col("_s")), "left").drop(equal.id)
    return rows.withColumn("score", F.when(F.col("_s").isNotNull() & (F.col("_rank") <= top) & (F.col("score") < 3), 3).otherwise(F.col("score"))).drop("_s", "_rank")


def symbols(genes: DataFrame, names: DataFrame) -> DataFrame:
    """The symbol of each of ``names(name)``: of ``genes(symbol, approved, name)`` an approved one first, then the least."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("approved"), "symbol"))
    rows = genes.withColumn("name", F.lower("name")).join(names.select(F.lower("name").alias("name")).distinct(), "name")
    return rows.withColumn("_rank", rank).where("_rank = 1").select("name", "symbol", "approved")


def looks_like_symbol(text: Column | str) -> Column:
    """True for a short word of capitals and digits that begins with a letter."""
    c = F.col(text) if isinstance(text, str) else text
    return c.rlike("^[A-Z][A-Z0-9-]{1,11}$")


def last_part(iri: Column | str) -> Column:
    """What follows the last slash or hash of an IRI."""
    return F.regexp_extract(iri, "([^/#]*)$", 1)
