"""Per-gene statistics over long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.lineage import stored
from spindle.functions.special import TINY, exact_rank_two_sided, hypergeometric_tail, normal_quantile, normal_two_sided, student_two_sided


def decimal_mean(value: str, places: int = 6):
    """The mean of doubles that are rounded to ``places`` decimal places: summed exactly, so that the order of the rows does not show."""
    unit = 10.0**places
    return F.sum(F.rint(F.col(value) * unit).cast("long")) / unit / F.count(value)


#: p-values are cut at the fourth powers of multiples of 1/256: no part holds over 1.6 % of evenly spread values.
PARTS = 256


def benjamini_hochberg(rows: DataFrame, p: str, by: list[str], name: str = "padj") -> DataFrame:
    """Add the step-up adjusted p-value within the groups ``by`` (none: one group); null p-values are not counted and stay null.

    Equal p-values are adjusted alike, so only different ones are ranked, with
    their counts. They are ranked within parts of the range from 0 to 1, and a
    table of the parts carries counts upwards and least values downwards, so
    that no group is sorted by one task. The rows and the different p-values are
    written once, as several branches read them.
    """
    rows = stored(rows, "tested")
    keys = [F.col(b).alias(f"_k{i}") for i, b in enumerate(by)] or [F.lit(0).alias("_k0")]
    group = [f"_k{i}" for i in range(len(keys))]
    values = rows.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    part = F.floor(F.pow(F.least(F.greatest("_p", F.lit(0.0)), F.lit(1.0)), 0.25) * PARTS)
    up = Window.partitionBy(*group, "_part").orderBy("_p")
    ranked = stored(values, "p-values").withColumn("_part", part).withColumn("_i", F.sum("_c").over(up))
    sums = ranked.groupBy(*group, "_part").agg(F.max("_i").alias("_in"))
    # at most PARTS + 1 rows in a group
    below = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in").over(below), F.lit(0))).withColumn("_n", F.sum("_in").over(Window.partitionBy(*group)))
    ratio = F.col("_p") * F.col("_n") / (F.col("_i") + F.col("_before"))
    ratios = ranked.join(sums.select(*group, "_part", "_before", "_n"), [*group, "_part"]).withColumn("_q", ratio)
    down = Window.partitionBy(*group, "_part").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*group).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    lows = ratios.groupBy(*group, "_part").agg(F.min("_q").alias("_low")).withColumn("_later", F.min("_low").over(above)).drop("_low")
    done = ratios.withColumn("_q", F.min("_q").over(down)).join(lows, [*group, "_part"])
    done = done.select(*group, "_p", F.least(F.lit(1.0), F.col("_q"), F.coalesce("_later", F.lit(1.0))).alias(name))
    match = F.col(p) == F.col("_p")
    for i, b in enumerate(by):
        match = match & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(done, match, "left").drop(*group, "_p")


def log_cpm(counts: DataFrame) -> DataFrame:
    """``counts(gene, sample, grp, count)`` with ``value`` = log2(counts per million + 1); samples without reads go."""
    libraries = counts.groupBy("sample").agg(F.sum("count").alias("library")).where("library > 0")
    return counts.join(libraries, "sample").withColumn("value", F.log2(F.col("count") / F.col("library") * 1e6 + 1)).drop("library")


def group_summary(values: DataFrame, least: int = 3, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """Per gene (or other columns ``by``): means, variances and sizes of both groups and their difference; genes with fewer than ``least`` non-zero values in a group go."""
    in_group = lambda g, x: F.when(F.col("grp") == g, x)
    out = values.groupBy(*by).agg(
        F.avg(in_group("test", F.col("value"))).alias("mean_test"),
        F.avg(in_group("control", F.col("value"))).alias("mean_control"),
        F.var_samp(in_group("test", F.col("value"))).alias("var_test"),
        F.var_samp(in_group("control", F.col("value"))).alias("var_control"),
        F.count_if(F.col("grp") == "test").alias("n_test"),
        F.count_if(F.col("grp") == "control").alias("n_control"),
        F.count_if((F.col("grp") == "test") & (F.col("value") > 0)).alias("nonzero_test"),
        F.count_if((F.col("grp") == "control") & (F.col("value") > 0)).alias("nonzero_control"),
    )
    return out.where((F.col("nonzero_test") >= least) & (F.col("nonzero_control") >= least)).withColumn("log2fc", F.col("mean_test") - F.col("mean_control"))


def mann_whitney(values: DataFrame) -> DataFrame:
    """Per gene the rank-sum statistic ``u`` of the test group and ``z`` (ties corrected, continuity 0.5); z is 0 without spread.

    Ranks are mid-ranks within the gene: the rank of a value and the number of
    its ties come from two windows, the rest is one aggregation.
    """
    gene = Window.partitionBy("gene").orderBy("value")
    same = Window.partitionBy("gene", "value")
    ranked = values.withColumn("ties", F.count("*").over(same)).withColumn("rank", F.rank().over(gene) + (F.col("ties") - 1) / 2)
    sums = ranked.groupBy("gene").agg(
        F.sum(F.when(F.col("grp") == "test", F.col("rank"))).alias("r"),
        F.count_if(F.col("grp") == "test").alias("n1"),
        F.count_if(F.col("grp") == "control").alias("n2"),
        # each of t tied values adds t^2 - 1, which makes t^3 - t for the tie
        F.sum((F.col("ties") * F.col("ties") - 1).cast("double")).alias("tie"),
    ).where("n1 > 0 and n2 > 0")
    return _rank_test(sums, ["gene"])


def _rank_test(sums: DataFrame, by: list[str]) -> DataFrame:
    """``u`` and ``z`` from the rank sum ``r`` of the test group, the sizes ``n1, n2`` and ``tie``, the sum of t^3 - t."""
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    n = F.col("n1") + F.col("n2")
    spread = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    off = F.greatest(F.abs(u - F.col("n1") * F.col("n2") / 2) - 0.5, F.lit(0.0))
    z = F.when(spread > 0, F.signum(u - F.col("n1") * F.col("n2") / 2) * off / spread).otherwise(0.0)
    return sums.select(*by, u.alias("u"), z.alias("z"), "n1", "n2", (F.col("tie") > 0).alias("tied"))


def rank_p(tested: DataFrame, exact: int = 8) -> DataFrame:
    """Add the two-sided ``pvalue`` of a rank test: exact where a group has at most ``exact`` values and no value is tied, else normal (1 without spread)."""
    small = (F.least("n1", "n2") <= exact) & ~F.col("tied")
    normal = F.coalesce(normal_two_sided("z"), F.lit(1.0))
    # the exact distribution is only made for rows that take it
    ends = [F.when(small, F.col(c)).cast("double") for c in ("u", "n1", "n2")]
    return tested.withColumn("pvalue", F.coalesce(exact_rank_two_sided(*ends), normal))


def mann_whitney_of_groups(values: DataFrame, by: list[str], parts: int = 1024) -> DataFrame:
    """``mann_whitney`` for few, large groups ``by``: no group is sorted by one task.

    Different values are counted first; ranks are counted within parts of a
    group's range of values, and a table of the parts carries them upwards.
    """
    one = values.where("value is not null and grp in ('test', 'control')").groupBy(*by, "value").agg(F.count("*").alias("t"), F.count_if(F.col("grp") == "test").alias("k"))
    ends = values.groupBy(*by).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    width = F.col("_high") - F.col("_low")
    part = F.when(width > 0, F.floor((F.col("value") - F.col("_low")) / width * parts)).otherwise(0)
    counted = one.join(F.broadcast(ends), by).withColumn("part", part)
    inner = Window.partitionBy(*by, "part").orderBy("value")
    counted = counted.withColumn("up_to", F.sum("t").over(inner))
    sums = counted.groupBy(*by, "part").agg(F.sum("t").alias("all"))
    # at most parts + 1 rows in a group
    before = F.coalesce(F.sum("all").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counted.join(sums.withColumn("before", before).drop("all"), [*by, "part"])
    middle = F.col("before") + F.col("up_to") - (F.col("t") - 1) / 2
    t = F.col("t").cast("double")
    tested = ranked.groupBy(*by).agg(
        F.sum(F.col("k") * middle).alias("r"), F.sum("k").alias("n1"), (F.sum("t") - F.sum("k")).alias("n2"), F.sum(t * t * t - t).alias("tie")
    ).where("n1 > 0 and n2 > 0")
    return _rank_test(tested, by)


def medians(values: DataFrame, by: list[str], parts: int = 1024) -> DataFrame:
    """``by, median`` of ``value`` for few, large groups: no group is sorted or held by one task.

    Different values are counted; the places of the middle values are counted
    within parts of a group's range, and a table of the parts carries the
    counts upwards. Null values are left out.
    """
    known = values.where("value is not null").select(*by, F.col("value").cast("double").alias("value"))
    one = known.groupBy(*by, "value").agg(F.count("*").alias("t"))
    ends = known.groupBy(*by).agg(F.min("value").alias("_low"), F.max("value").alias("_high"), F.count("*").alias("_n"))
    width = F.col("_high") - F.col("_low")
    part = F.when(width > 0, F.floor((F.col("value") - F.col("_low")) / width * parts)).otherwise(0)
    counted = one.join(ends, by).withColumn("part", part).withColumn("up_to", F.sum("t").over(Window.partitionBy(*by, "part").orderBy("value")))
    sums = counted.groupBy(*by, "part").agg(F.sum("t").alias("all"))
    # at most parts + 1 rows in a group
    before = F.coalesce(F.sum("all").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counted.join(sums.withColumn("before", before).drop("all"), [*by, "part"])
    last, first = F.col("before") + F.col("up_to"), F.col("before") + F.col("up_to") - F.col("t")
    holds = lambda place: F.max(F.when((first < place) & (place <= last), F.col("value")))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    return ranked.groupBy(*by).agg(((holds(low) + holds(high)) / 2).alias("median"))


def mann_whitney_p(values: DataFrame) -> DataFrame:
    return rank_p(mann_whitney(values))


def welch(summary: DataFrame) -> DataFrame:
    """``group_summary`` with Welch's ``t``, its degrees of freedom and two-sided p; without spread p is 1."""
    a, b = F.col("var_test") / F.col("n_test"), F.col("var_control") / F.col("n_control")
    some = (F.col("n_test") > 1) & (F.col("n_control") > 1) & (a + b > 0)
    t = F.when(some, (F.col("mean_test") - F.col("mean_control")) / F.sqrt(a + b))
    df = F.when(some, (a + b) * (a + b) / (a * a / (F.col("n_test") - 1) + b * b / (F.col("n_control") - 1)))
    return summary.withColumn("t", t).withColumn("df", df).withColumn("pvalue", F.coalesce(student_two_sided("t", "df"), F.lit(1.0)))


def stouffer(studies: DataFrame, least: int = 2) -> DataFrame:
    """Per gene in at least ``least`` studies: weighted Z, its p, and the weighted fold change; weights are root sizes.

    ``studies`` has gene, study, p, log2fc, n. Null p-values are left out and
    zeros are raised to the smallest double.
    """
    p = F.greatest("p", F.lit(TINY))
    w = F.sqrt("n")
    one = studies.where("p is not null and not isnan(p)").withColumn("zz", -normal_quantile(p / 2) * F.signum("log2fc")).withColumn("w", w)
    sums = one.groupBy("gene").agg(
        F.countDistinct("study").alias("n_studies"), (F.sum(F.col("w") * F.col("zz")) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("z"),
        (F.sum(F.col("w") * F.col("log2fc")) / F.sum("w")).alias("log2fc"),
    ).where(F.col("n_studies") >= least)
    return sums.withColumn("pvalue", F.greatest(normal_two_sided("z"), F.lit(TINY)))


def fisher(studies: DataFrame, least: int = 2) -> DataFrame:
    """Per gene in at least ``least`` studies: Fisher's statistic and its p, in closed form for even degrees of freedom."""
    logs = studies.where("p is not null and not isnan(p)").groupBy("gene").agg(
        F.countDistinct("study").alias("n_studies"), F.count("*").alias("k"), (-2 * F.sum(F.log(F.greatest("p", F.lit(TINY))))).alias("x")
    )
    half = F.col("x") / 2
    # sum of half^i / i! for i below k, each term from the one before
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("k"), F.lit(1)).cast("int")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct((acc["term"] * half / i).alias("term"), (acc["sum"] + acc["term"]).alias("sum")),
        lambda acc: acc["sum"],
    )
    return logs.where(F.col("n_studies") >= least).withColumn("pvalue", F.least(F.lit(1.0), F.exp(-half) * total))


def over_representation(genes: DataFrame, sets: DataFrame, background: int, least: int = 5, by: tuple[str, ...] = (), correction: str = "bh") -> DataFrame:
    """Per term: sizes, overlap, precision, recall, hypergeometric p and ``padj`` over the terms.

    ``genes`` (gene and the columns ``by``, which tell lists apart, such as a
    direction) are the queries, ``sets`` (term, gene) the annotation; a list of
    fewer than ``least`` genes gives no rows. ``correction`` is bh or
    bonferroni, within each list.
    """
    if correction not in ("bh", "bonferroni"):
        raise ValueError(f"unknown correction: {correction}")
    query = genes.select(*by, "gene").where("gene is not null").distinct()
    size = query.groupBy(*by).agg(F.count("*").alias("query_size")).where(F.col("query_size") >= least)
    known = sets.select("term", "gene").where("term is not null and gene is not null").distinct()
    sizes = known.groupBy("term").agg(F.count("*").alias("term_size"))
    hits = known.join(query, "gene").groupBy("term", *by).agg(F.count("*").alias("overlap"))
    # without columns there is one list, one row on the right
    out = hits.join(size, list(by)) if by else hits.join(F.broadcast(size), how="cross")
    out = out.join(sizes, "term")
    out = out.withColumn("pvalue", hypergeometric_tail("overlap", "query_size", "term_size", F.lit(background)))
    out = out.withColumn("precision", F.col("overlap") / F.col("query_size")).withColumn("recall", F.col("overlap") / F.col("term_size"))
    if correction == "bh":
        return benjamini_hochberg(out, "pvalue", list(by))
    out = stored(out, "terms")
    tests = out.groupBy(*by).agg(F.count("*").alias("n_tests"))
    out = out.join(tests, list(by)) if by else out.join(F.broadcast(tests), how="cross")
    return out.withColumn("padj", F.least(F.lit(1.0), F.col("pvalue") * F.col("n_tests"))).drop("n_tests")


def quantile_normalised(values: DataFrame) -> DataFrame:
    """Replace each value by the mean, over samples, of the values of its rank (ties by gene)."""
    rank = F.row_number().over(Window.partitionBy("sample").orderBy("value", "gene"))
    ranked = values.withColumn("rank", rank)
    means = ranked.groupBy("rank").agg(F.avg("value").alias("normal"))
    return ranked.join(means, "rank").drop("rank")
