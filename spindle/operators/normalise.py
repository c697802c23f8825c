"""Filters and normalisations of long count tables ``counts(gene, sample, count)``.

A pair of gene and sample without a row has a count of zero, rows of one pair
are summed. Nulls in any of the columns take the row out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.lineage import stored
from spindle.operators.statistics import quantile_normalised


def summed(counts: DataFrame) -> DataFrame:
    """One row for each gene and sample."""
    some = counts.where("gene is not null and sample is not null and `count` is not null")
    return some.groupBy("gene", "sample").agg(F.sum("count").alias("count"))


def dense(counts: DataFrame) -> DataFrame:
    """Every gene with every sample, zero where there is no row; the grid is the result, so it is made by a join of both lists."""
    one = summed(counts)
    grid = one.select("gene").distinct().join(one.select("sample").distinct(), how="cross")
    return grid.join(one, ["gene", "sample"], "left").select("gene", "sample", F.coalesce("count", F.lit(0)).alias("count"))


def expressed(counts: DataFrame, reads: int = 50, share: float = 0.05) -> DataFrame:
    """``gene, n_expressed``: genes with at least ``reads`` in at least ``share`` of all samples."""
    one = summed(counts)
    samples = one.agg(F.countDistinct("sample").alias("n"))
    genes = one.groupBy("gene").agg(F.count_if(F.col("count") >= reads).alias("n_expressed"))
    # one row on the right
    return genes.join(F.broadcast(samples), how="cross").where((F.col("n_expressed") >= share * F.col("n")) & (F.col("n_expressed") > 0)).drop("n")


def log_quantile(counts: DataFrame) -> DataFrame:
    """``gene, sample, value, normal``: log2(count + 1) of the whole grid, and its quantile-normalised value (ties by gene)."""
    return quantile_normalised(dense(counts).select("gene", "sample", F.log2(F.col("count") + 1).alias("value")))


def tmm_factors(counts: DataFrame, trim_ratio: float = 0.3, trim_level: float = 0.05, quartile: float = 0.75) -> DataFrame:
    """``sample, library, factor``: trimmed weighted means of log ratios to a reference sample.

    The reference is the sample whose upper quartile, as a share of its
    library, lies nearest to the mean of all (ties: the smallest sample).
    Ratios are taken over genes with reads in both; of these, the shares
    ``trim_ratio`` of the ratios and ``trim_level`` of the levels are cut at
    both ends by rank (mid-ranks), and the rest is weighted by inverse
    variances. Factors are scaled to a geometric mean of one. A sample without
    reads has no factor (null), one that shares too few genes has the
    reference's. Windows hold one sample's genes.
    """
    one = stored(summed(counts).where("`count` > 0"), "counts")
    all_samples = summed(counts).groupBy("sample").agg(F.sum("count").alias("library"))
    libraries = one.groupBy("sample").agg(F.sum("count").alias("library"), F.count("*").alias("k"))
    genes = one.agg(F.countDistinct("gene").alias("g"))
    # the quantile's place among the genes, of which those without a row come first
    place = (F.col("g") - 1) * F.lit(quartile)
    row = F.row_number().over(Window.partitionBy("sample").orderBy("count", "gene"))
    ranked = one.withColumn("row", row).join(libraries, "sample").join(F.broadcast(genes), how="cross")
    at = lambda p: F.max(F.when(F.col("row") == p - (F.col("g") - F.col("k")) + 1, F.col("count") / F.col("library")))
    low, high = F.coalesce(at(F.floor(place)), F.lit(0.0)), F.coalesce(at(F.ceil(place)), F.lit(0.0))
    quartiles = ranked.groupBy("sample").agg((low + (high - low) * F.first(place - F.floor(place))).alias("q"))
    mean = quartiles.agg(F.avg("q").alias("mean"))
    reference = quartiles.join(F.broadcast(mean), how="cross").orderBy(F.abs(F.col("q") - F.col("mean")), "sample").limit(1).select("sample")
    shares = one.join(libraries.drop("k"), "sample")
    # one sample's genes: a row for each gene at most
    base = shares.join(F.broadcast(reference), "sample", "left_semi").select("gene", F.col("count").alias("r"), F.col("library").alias("nr"))
    y, n, r, nr = (F.col(c).cast("double") for c in ("count", "library", "r", "nr"))
    pairs = shares.join(base, "gene").select(
        "sample", "gene", F.log2((y / n) / (r / nr)).alias("m"), (F.log2(y / n * (r / nr)) / 2).alias("a"), ((n - y) / n / y + (nr - r) / nr / r).alias("v")
    )
    rank = lambda c: F.rank().over(Window.partitionBy("sample").orderBy(c)) + (F.count("*").over(Window.partitionBy("sample", c)) - 1) / 2
    size = F.count("*").over(Window.partitionBy("sample"))
    ranks = pairs.withColumn("rm", rank("m")).withColumn("ra", rank("a")).withColumn("n", size)
    inside = lambda c, share: F.col(c).between(F.floor(F.col("n") * share) + 1, F.col("n") - F.floor(F.col("n") * share))
    keep = inside("rm", trim_ratio) & inside("ra", trim_level) & (F.col("v") > 0)
    made = ranks.groupBy("sample").agg(F.max(F.abs("m")).alias("far"), F.sum(F.when(keep, F.col("m") / F.col("v"))).alias("up"), F.sum(F.when(keep, 1 / F.col("v"))).alias("w"))
    log = F.when(F.col("far") < 1e-6, 0.0).otherwise(F.coalesce(F.try_divide("up", "w"), F.lit(0.0)))
    logs = libraries.select("sample").join(made.select("sample", log.alias("log")), "sample", "left").select("sample", F.coalesce("log", F.lit(0.0)).alias("log"))
    centre = logs.agg(F.avg("log").alias("centre"))
    factors = logs.join(F.broadcast(centre), how="cross").select("sample", F.pow(F.lit(2.0), F.col("log") - F.col("centre")).alias("factor"))
    return all_samples.join(factors, "sample", "left")


def tmm(counts: DataFrame) -> DataFrame:
    """``gene, sample, value``: counts per million of the library times its factor; samples without reads go."""
    factors = tmm_factors(counts).where("factor is not null")
    return summed(counts).join(factors, "sample").select("gene", "sample", (F.col("count") / (F.col("library") * F.col("factor")) * 1e6).alias("value"))
