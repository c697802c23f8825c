"""A negative-binomial test of two groups of samples, gene by gene.

Library sizes are brought together by medians of ratios. A gene's counts have
mean s q, with a sample's size factor s and a level q of its group, and
variance m + a m^2. The levels and the dispersion a are those of greatest
likelihood, found for many genes at a time; the fold change is tested against
its standard error (Wald). Dispersions are each gene's own: they are not drawn
towards a trend over genes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions.special import erfc, log_gamma
from spindle.operators.normalise import dense, summed
from spindle.operators.statistics import benjamini_hochberg

#: Counts that a task fits at a time, about.
CELLS = 1_000_000
#: Ends of the search for the logarithm of the dispersion, and its steps (each leaves 62 % of the range).
LOW, HIGH, STEPS = np.log(1e-8), np.log(100.0), 60


def size_factors(counts: DataFrame) -> DataFrame:
    """``sample, factor``: the median over genes of a sample's count divided by the gene's geometric mean.

    Genes with reads in all samples count. Where there is none, geometric means
    are those of all samples with a logarithm of zero where there are no reads,
    and a sample's median is over its own genes; factors are scaled to a
    geometric mean of one. A sample without reads has no factor.
    """
    one = summed(counts).where("`count` > 0")
    n = summed(counts).agg(F.countDistinct("sample").alias("n"))
    logs = one.groupBy("gene").agg(F.sum(F.log("count")).alias("total"), F.count("*").alias("k"))
    # one row on the right
    genes = logs.join(F.broadcast(n), how="cross").select("gene", (F.col("total") / F.col("n")).alias("log_mean"), (F.col("k") == F.col("n")).alias("full"))
    some = genes.agg(F.coalesce(F.bool_or("full"), F.lit(False)).alias("some"))
    used = genes.join(F.broadcast(some), how="cross").where("full or not some")
    # one sample's genes in an aggregate: a value for each gene at most
    logs = one.join(used, "gene").groupBy("sample").agg(F.median(F.log("count") - F.col("log_mean")).alias("log"), F.first("some").alias("some"))
    centre = logs.agg(F.avg("log").alias("centre"))
    return logs.join(F.broadcast(centre), how="cross").select("sample", F.exp(F.when(F.col("some"), F.col("log")).otherwise(F.col("log") - F.col("centre"))).alias("factor"))


def _levels(k: np.ndarray, s: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The most likely level of each row of counts for its dispersion, by Newton's method on the logarithm."""
    total = k.sum(1)
    some = total > 0
    q = np.where(some, total / s.sum(), 1.0)
    for _ in range(100):
        m = s * q[:, None]
        w = 1 + a[:, None] * m
        slope = ((k - m) / w).sum(1)
        bend = (m * (1 + a[:, None] * k) / (w * w)).sum(1)
        step = np.clip(np.where(some, slope / np.maximum(bend, 1e-300), 0.0), -2.0, 2.0)
        q = q * np.exp(step)
        if (np.abs(step) < 1e-12).all():
            break
    return np.where(some, q, 0.0)


def _log_likelihood(k: np.ndarray, m: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Without the terms that depend on the counts alone."""
    r = 1 / a[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = np.where(k > 0, log_gamma(k + r) - log_gamma(np.broadcast_to(r, k.shape)) + k * np.log(np.where(m > 0, a[:, None] * m, 1.0)), 0.0)
    return (seen - (k + r) * np.log1p(a[:, None] * m)).sum(1)


def fit(k: np.ndarray, s: np.ndarray, test: np.ndarray) -> dict[str, np.ndarray]:
    """Levels, dispersion, fold change, standard error and p of each row of counts ``k``; ``test`` marks the test group's columns."""

    def profile(log_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.exp(log_a)
        one, two = _levels(k[:, test], s[test], a), _levels(k[:, ~test], s[~test], a)
        return _log_likelihood(k, np.where(test, one[:, None], two[:, None]) * s, a), one, two

    # golden sections of the range of the dispersion's logarithm
    share = (5**0.5 - 1) / 2
    low, high = np.full(len(k), LOW), np.full(len(k), HIGH)
    x, y = high - share * (high - low), low + share * (high - low)
    fx, fy = profile(x)[0], profile(y)[0]
    for _ in range(STEPS):
        left = fx >= fy
        low, high = np.where(left, low, x), np.where(left, y, high)
        new = np.where(left, high - share * (high - low), low + share * (high - low))
        f_new = profile(new)[0]
        x, y, fx, fy = np.where(left, new, y), np.where(left, x, new), np.where(left, f_new, fy), np.where(left, fx, f_new)
    log_a = (low + high) / 2
    _, one, two = profile(log_a)
    a = np.exp(log_a)
    information = lambda q, part: (s[part] * q[:, None] / (1 + a[:, None] * s[part] * q[:, None])).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        fold = np.log2(one / two)
        error = np.sqrt(1 / information(one, test) + 1 / information(two, ~test)) / np.log(2)
        z = fold / error
    known = np.isfinite(z)
    p = np.where(known, erfc(np.abs(np.where(known, z, 0.0)) / np.sqrt(2)), np.nan)
    return {"mean_test": one, "mean_control": two, "dispersion": a, "log2fc": fold, "error": error, "pvalue": p, "known": known}


def negative_binomial_test(counts: DataFrame) -> DataFrame:
    """``gene, base_mean, dispersion, log2fc, error, pvalue, padj`` of ``counts(gene, sample, count, grp)``.

    ``grp`` is test or control; samples without reads and of other groups go.
    A gene without reads in one of the groups has no finite fold change: it
    gets 0, 1 and 1 for fold change, p and adjusted p, and a null error, as has
    every gene where a group has no sample. p-values are adjusted over the
    tested genes (Benjamini-Hochberg).
    """
    some = counts.where("grp in ('test', 'control')")
    factors = size_factors(some)
    groups = some.where("sample is not null").groupBy("sample").agg(F.min("grp").alias("grp")).join(factors, "sample")
    n = groups.count()
    grid = dense(some).join(groups, "sample")
    genes = summed(some).select("gene").distinct().count()
    buckets = max(1, -(-genes * max(n, 1) // CELLS))

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        samples = rows.drop_duplicates("sample").sort_values("sample")
        names, gene = np.unique(rows["gene"].to_numpy(), return_inverse=True)
        column = np.searchsorted(samples["sample"].to_numpy(), rows["sample"].to_numpy())
        k = np.zeros((len(names), len(samples)))
        k[gene, column] = rows["count"]
        s, test = samples["factor"].to_numpy(), (samples["grp"] == "test").to_numpy()
        base = (k / s).mean(1)
        if test.all() or not test.any():
            nothing = np.full(len(names), np.nan)
            found = {"dispersion": nothing, "log2fc": nothing, "error": nothing, "pvalue": nothing, "known": np.zeros(len(names), bool)}
        else:
            found = fit(k, s, test)
        keep = lambda c: pd.Series(np.where(found["known"], found[c], np.nan)).astype(object).where(pd.Series(found["known"]), None)
        return pd.DataFrame({"gene": names, "base_mean": base, "dispersion": keep("dispersion"), "log2fc": keep("log2fc"), "error": keep("error"), "pvalue": keep("pvalue")})

    kind = f"gene {some.schema['gene'].dataType.simpleString()}, base_mean double, dispersion double, log2fc double, error double, pvalue double"
    fitted = grid.groupBy(F.pmod(F.xxhash64("gene"), F.lit(buckets)).alias("bucket")).applyInPandas(of, kind)
    out = benjamini_hochberg(fitted, "pvalue", [])
    one = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    return out.select("gene", "base_mean", "dispersion", one("log2fc", 0.0), "error", one("pvalue", 1.0), one("padj", 1.0))
