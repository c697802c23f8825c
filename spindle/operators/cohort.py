"""Sample search and cohort selection."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pattern with one of these is a regular expression, any other a phrase.
REGEX_CHARS = re.compile(r"[*+?\[\]{}\\^$.]")


def tokens(column: Column | str) -> Column:
    """The text's lower-case words, separated and framed by single spaces."""
    words = F.regexp_replace(F.lower(column), "[^a-z0-9]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def phrase_match(columns: Sequence[str], phrases: Sequence[str]) -> Column:
    """True if one of the columns holds one of the phrases as consecutive words."""
    out = F.lit(False)
    for c in columns:
        text = tokens(F.coalesce(c, F.lit("")))
        for phrase in phrases:
            words = " ".join(re.findall("[a-z0-9]+", phrase.lower()))
            if words:
                out = out | text.contains(f" {words} ")
    return out


def regex_match(columns: Sequence[str], pattern: str) -> Column:
    """True if one of the columns matches, case-insensitively; a pattern that cannot be compiled matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).rlike(f"(?i){pattern}"), F.lit(False))
    return out


def search(rows: DataFrame, pattern: str, phrase_columns: Sequence[str], regex_columns: Sequence[str]) -> DataFrame:
    """Rows that match: as a regular expression if the pattern looks like one, else as phrases separated by ``|``."""
    if REGEX_CHARS.search(pattern):
        return rows.where(regex_match(regex_columns, pattern))
    return rows.where(phrase_match(phrase_columns, pattern.split("|")))


def series(rows: DataFrame, column: str = "series_id", prefix: str = "GSE") -> DataFrame:
    """One row per sample and series; members without the prefix, and null, go."""
    one = F.explode(F.array_distinct(F.split(column, ",")))
    return rows.withColumn("series", one).withColumn("series", F.trim("series")).where(F.col("series").startswith(prefix))


def classified(rows: DataFrame, text: Column, disease: str, control: str) -> DataFrame:
    """Add ``cohort``: test where the disease pattern matches (first), control where the control pattern does."""
    return rows.withColumn("cohort", F.when(text.rlike(f"(?i){disease}"), "test").when(text.rlike(f"(?i){control}"), "control"))


def study_pairs(cohort: DataFrame) -> DataFrame:
    """``series, n_test, n_control`` for every series of a classified, exploded cohort."""
    return cohort.where("cohort is not null").groupBy("series").agg(F.count_if(F.col("cohort") == "test").alias("n_test"), F.count_if(F.col("cohort") == "control").alias("n_control"))


def tissue_filtered(rows: DataFrame, text: Column, include: str, exclude: str) -> DataFrame:
    """Rows whose text matches ``include`` (if given) and not ``exclude`` (if given), in any case."""
    if include:
        rows = rows.where(text.rlike(f"(?i){include}"))
    return rows.where(~text.rlike(f"(?i){exclude}")) if exclude else rows


def matched_cohort(rows: DataFrame, text: Column, disease: str, control: str, include: str = "", exclude: str = "", least: int = 3) -> DataFrame:
    """``series, n_test, n_control`` of the studies with at least ``least`` samples on both sides.

    ``rows`` has a row for each sample and series. Test samples match the
    disease pattern, controls the control pattern and are no test samples. Both
    are filtered by tissue; if no control passes ``include``, controls are
    filtered by ``exclude`` alone.
    """
    test = tissue_filtered(rows.where(text.rlike(f"(?i){disease}")), text, include, exclude)
    found = tissue_filtered(rows.where(text.rlike(f"(?i){control}")), text, "", exclude)
    if include:
        found = found.withColumn("_in", F.coalesce(text.rlike(f"(?i){include}"), F.lit(False)))
        # one row on the right
        found = found.join(F.broadcast(found.agg(F.coalesce(F.bool_or("_in"), F.lit(False)).alias("_any"))), how="cross").where("_in or not _any")
    found = found.join(test.select("sample").distinct(), "sample", "left_anti")
    n = lambda side, name: side.groupBy("series").agg(F.countDistinct("sample").alias(name))
    return n(test, "n_test").join(n(found, "n_control"), "series").where((F.col("n_test") >= least) & (F.col("n_control") >= least))


def analysis_mode(pairs: DataFrame, pooled: DataFrame, least: int = 3) -> DataFrame:
    """One row ``mode, n_studies, reason``: study-matched with ``least`` studies, else study-prioritised if test studies have controls, else pooled.

    ``pairs`` are the matched studies, ``pooled`` one row ``n_test, n_control``
    of samples in test studies.
    """
    facts = pairs.agg(F.count("*").alias("n_studies")).join(pooled.select("n_test", "n_control"), how="cross")
    enough, some = F.col("n_studies") >= least, (F.col("n_test") > 0) & (F.col("n_control") > 0)
    short = F.concat(F.lit("only "), "n_studies", F.lit(f" matched studies, needed {least}"))
    return facts.select(
        F.when(enough, "study-matched").when(some, "study-prioritised").otherwise("pooled").alias("mode"), "n_studies",
        F.when(enough, F.lit(None).cast("string")).when(some, short).otherwise(F.concat(short, F.lit("; no study has test and control samples"))).alias("reason"),
    )


def with_biotype(rows: DataFrame, biotypes: DataFrame, wanted: str) -> DataFrame:
    """Rows of genes whose biotype in ``biotypes(gene, biotype)`` is ``wanted``, in any case."""
    return rows.join(biotypes.where(F.lower("biotype") == wanted.lower()).select("gene").distinct(), "gene", "left_semi")


def directions(rows: DataFrame, by: list[str], share: float = 0.6) -> DataFrame:
    """Genes up and down in each group of ``rows(gene, log2fc)``, and the direction that has at least ``share`` of them, without a test.

    A gene counts by the sign of its mean; zero counts on neither side.
    """
    genes = rows.groupBy(*by, "gene").agg(F.avg("log2fc").alias("mean"))
    out = genes.groupBy(*by).agg(F.count_if(F.col("mean") > 0).alias("up"), F.count_if(F.col("mean") < 0).alias("down"), F.count("*").alias("genes"))
    total = F.col("up") + F.col("down")
    return out.withColumn("direction", F.when(F.col("up") >= share * total, F.when(total > 0, "up")).when(F.col("down") >= share * total, "down").otherwise("mixed"))
