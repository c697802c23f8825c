"""From a search term to a differential-expression result: expansion, cohort, choice of the mode, and the tests of that mode."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions.lineage import stored
from spindle.operators.cohort import analysis_mode, series, study_pairs, tokens
from spindle.operators.statistics import benjamini_hochberg, fisher, log_cpm, mann_whitney_p

RESULT = "strategy string, mode string, gene {}, n_studies long, n_test long, n_control long, log2fc double, pvalue double, padj double"


def expanded(term: str, groups: Mapping[str, Sequence[str]]) -> list[str]:
    """The term and the words of the synonym groups that it names.

    A group is named by its key or one of its words as the whole term, or by
    its key inside the term; keys of at most two letters only as whole words.
    """
    text = term.lower()
    words = set(tokens_of(text))
    out = {term}
    for key, synonyms in groups.items():
        inside = key in words if len(key) <= 2 else key in text
        if inside or text in synonyms:
            out |= set(synonyms)
    return sorted(out)


def tokens_of(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def ontology_phrases(term: str, labels: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """``phrase``: labels of the terms that are called ``term``, and of those directly below them.

    ``labels(id, label)`` may hold several names of a term, ``hierarchy(child,
    parent)`` its direct parents.
    """
    found = labels.where(F.lower("label") == term.lower()).select("id").distinct()
    below = hierarchy.join(found.withColumnRenamed("id", "parent"), "parent").select(F.col("child").alias("id"))
    return labels.join(found.unionByName(below).distinct(), "id").select(F.col("label").alias("phrase")).distinct()


def phrases_found(rows: DataFrame, key: str, columns: Sequence[str], phrases: DataFrame) -> DataFrame:
    """``key, phrase``: which phrases a row holds as consecutive words of one of the columns.

    Runs of words are joined with the phrases, so that thousands of them cost
    one join and no pattern each. Case and other characters than letters and
    digits do not matter; phrases without any are left out.
    """
    wanted = phrases.select("phrase", F.trim(tokens("phrase")).alias("run")).where("run <> ''").distinct()
    sizes = [r.n for r in wanted.select(F.size(F.split("run", " ")).alias("n")).distinct().collect()]  # the lengths that occur
    if not sizes:
        return rows.select(key).withColumn("phrase", F.lit(None).cast("string")).limit(0)
    one = rows.select(key, F.explode(F.array(*(F.split(F.trim(tokens(F.coalesce(c, F.lit("")))), " ") for c in columns))).alias("words"))
    runs = lambda n: F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.array_join(F.slice("words", i, n), " "))).otherwise(F.array().cast("array<string>"))
    each = one.select(key, F.explode(F.array_distinct(F.concat(*(runs(n) for n in sorted(sizes))))).alias("run"))
    return each.join(wanted, "run").select(key, "phrase").distinct()


def _cohort(samples: DataFrame, test: DataFrame, control: Column) -> DataFrame:
    """``sample, series, cohort`` of the test samples and of the controls that are none."""
    marked = samples.join(test.select("sample").distinct().withColumn("_test", F.lit(True)), "sample", "left")
    cohort = F.when(F.col("_test"), "test").when(control, "control")
    return series(marked.withColumn("cohort", cohort).where("cohort is not null")).select("sample", "series", "cohort").distinct()


def _tested(counts: DataFrame, by: list[str]) -> DataFrame:
    """Rank tests of ``counts(gene, sample, count, grp)`` within ``by`` and each gene, on log counts per million."""
    values = log_cpm(counts).withColumn("gene", F.struct(*by, "gene"))
    of = lambda g: F.avg(F.when(F.col("grp") == g, F.col("value")))
    n = lambda g: F.count_if(F.col("grp") == g)
    means = values.groupBy("gene").agg((of("test") - of("control")).alias("log2fc"), n("test").alias("n_test"), n("control").alias("n_control"))
    out = mann_whitney_p(values).select("gene", "pvalue").join(means, "gene")
    return out.select("gene.*", "log2fc", "n_test", "n_control", "pvalue")


def analyse(samples: DataFrame, counts: DataFrame, phrases: DataFrame, control: Column, columns: Sequence[str] = ("title",), least: int = 3, least_samples: int = 3) -> DataFrame:
    """``strategy, mode, gene, n_studies, n_test, n_control, log2fc, pvalue, padj`` of a disease against controls.

    ``phrases(strategy, phrase)`` describe the disease; strategies are tried in
    the order of their names and the first that finds a sample is taken.
    Samples (``sample, series_id`` and text columns) that hold a phrase are
    tests, others that meet ``control`` controls. A study with ``least_samples`` on both sides is matched.
    With ``least`` matched studies each is tested by itself and the p-values
    are combined (Fisher; fold changes by size). Otherwise tests are held
    against the controls of test studies, or where there are none, against all
    controls. ``counts(gene, sample, count)`` without rows for the cohort, or
    a search without a match, give no rows.
    """
    spark = samples.sparkSession
    kind = RESULT.format(counts.schema["gene"].dataType.simpleString())
    own = samples.where("sample is not null")
    found = phrases_found(own, "sample", columns, phrases.select("phrase")).join(phrases, "phrase")
    found = stored(found.select("strategy", "sample").distinct(), "found")
    strategy = found.agg(F.min("strategy")).first()[0]
    if strategy is None:
        return spark.createDataFrame([], kind)
    cohort = stored(_cohort(own, found.where(F.col("strategy") == strategy), control), "cohort")
    pairs = study_pairs(cohort)
    matched = pairs.where((F.col("n_test") >= least_samples) & (F.col("n_control") >= least_samples))
    near = pairs.where("n_test > 0")
    one = near.agg(F.coalesce(F.sum("n_test"), F.lit(0)).alias("n_test"), F.coalesce(F.sum("n_control"), F.lit(0)).alias("n_control"))
    mode = analysis_mode(matched, one, least).first().mode
    if mode == "study-matched":
        rows = cohort.join(matched.select("series"), "series", "left_semi").select("sample", "series", F.col("cohort").alias("grp"))
        each = stored(_tested(counts.join(rows, "sample").withColumn("sample", F.struct("series", "sample")), ["series"]), "studies")
        weight = F.col("n_test") + F.col("n_control")
        sums = each.groupBy("gene").agg((F.sum(weight * F.col("log2fc")) / F.sum(weight)).alias("log2fc"), F.sum("n_test").alias("n_test"), F.sum("n_control").alias("n_control"))
        tested = fisher(each.select("gene", F.col("series").alias("study"), F.col("pvalue").alias("p")), least=1).select("gene", "n_studies", "pvalue").join(sums, "gene")
    else:
        rows = cohort if mode == "pooled" else cohort.join(near.select("series"), "series", "left_semi")
        rows = rows.select("sample", F.col("cohort").alias("grp")).distinct()
        tested = _tested(counts.join(rows, "sample"), []).withColumn("n_studies", F.lit(None).cast("long"))
    out = benjamini_hochberg(tested, "pvalue", [])
    out = out.withColumn("strategy", F.lit(strategy)).withColumn("mode", F.lit(mode))
    return out.select(*(F.col(c.split()[0]).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in kind.split(", ")))
