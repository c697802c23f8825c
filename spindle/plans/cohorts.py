"""Queries over samples, expression values, cells and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindle.operators.cohort import classified, phrase_match, search, series, study_pairs, tokens
from spindle.operators.normalise import dense
from spindle.operators.statistics import benjamini_hochberg, group_summary, log_cpm, mann_whitney, mann_whitney_of_groups, mann_whitney_p, medians, over_representation, quantile_normalised, rank_p, welch
from spindle.plans.registry import query
from spindle.sources.views import cells, expression, read, samples, sql

#: Used by several oracles: samples by series, as the splitting operator gives them.
BY_SERIES = ", bys AS (SELECT DISTINCT sample, platform, title, source_name, series FROM (SELECT *, unnest(string_split(series_id, ',')) AS series FROM samples) WHERE starts_with(series, 'GSE'))"
COHORT = BY_SERIES + ", coh AS (SELECT *, CASE WHEN regexp_matches(lower(title), 'idiot|stupid') THEN 'test' WHEN regexp_matches(lower(title), 'that') THEN 'control' END AS cohort FROM bys)"


def _cohort(spark, d):
    return classified(series(samples(spark, d)), F.col("title"), "idiot|stupid", "that")


@query("P17_phrase_search", sql("samples", " SELECT sample FROM samples WHERE contains(' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ', ' of the ') OR contains(' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ', ' de la ')"))
def p17(spark, d):
    return search(samples(spark, d), "of the|de la", ["sample", "title", "source_name"], ["title", "source_name"]).select("sample")


@query("P18_regex_search", sql("samples", " SELECT sample FROM samples WHERE regexp_matches(lower(title), 'th[ae]t .{2,4} ') OR regexp_matches(lower(source_name), 'th[ae]t .{2,4} ')"))
def p18(spark, d):
    return search(samples(spark, d), "th[ae]t .{2,4} ", ["title"], ["title", "source_name"]).select("sample")


@query("P20_include_then_exclude", sql("samples", " SELECT count(*) AS total, count(*) FILTER (WHERE regexp_matches(lower(t), 'the')) AS included, count(*) FILTER (WHERE regexp_matches(lower(t), 'the') AND NOT regexp_matches(lower(t), '!!')) AS kept FROM (SELECT source_name || ' ' || title AS t FROM samples)"))
def p20(spark, d):
    t = F.lower(F.concat_ws(" ", "source_name", "title"))
    took = t.rlike("the")
    return samples(spark, d).agg(F.count("*").alias("total"), F.count_if(took).alias("included"), F.count_if(took & ~t.rlike("!!")).alias("kept"))


@query("P21_test_or_control", sql("samples", COHORT + " SELECT cohort, count(DISTINCT sample) AS n FROM coh GROUP BY cohort"))
def p21(spark, d):
    return _cohort(spark, d).groupBy("cohort").agg(F.countDistinct("sample").alias("n"))


@query("G12_samples_per_series", sql("samples", BY_SERIES + " SELECT series, count(*) AS n FROM bys GROUP BY series"))
def g12(spark, d):
    return series(samples(spark, d)).groupBy("series").agg(F.count("*").alias("n"))


@query("G13_study_summary", sql("samples", BY_SERIES + ", r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY sample) AS i FROM bys) SELECT series, count(*) AS n, string_agg(left(title, 20), '; ' ORDER BY sample) FILTER (WHERE i <= 3) AS titles FROM r GROUP BY series"))
def g13(spark, d):
    rows = series(samples(spark, d)).select("series", "sample", F.left("title", F.lit(20)).alias("t"))
    # the rank is a filter of its own, so that Spark limits each source before the shuffle
    ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy("series").orderBy("sample"))).where("i <= 3")
    first = F.sort_array(F.collect_list(F.struct("sample", "t")))
    titles = ranked.groupBy(F.col("series").alias("of")).agg(F.array_join(F.transform(first, lambda x: x["t"]), "; ").alias("titles"))
    counts = rows.groupBy("series").agg(F.count("*").alias("n"))
    return counts.join(titles, F.col("series").eqNullSafe(F.col("of"))).drop("of")


@query("G14_search_statistics", sql("samples", COHORT + " SELECT count(DISTINCT sample) FILTER (WHERE cohort = 'test') AS n_test, count(DISTINCT sample) FILTER (WHERE cohort = 'control') AS n_control, count(DISTINCT series) AS n_series, round(count(DISTINCT sample) FILTER (WHERE cohort = 'test') / nullif(count(DISTINCT sample) FILTER (WHERE cohort = 'control'), 0), 6) AS ratio FROM coh WHERE cohort IS NOT NULL"))
def g14(spark, d):
    n = lambda g: F.countDistinct(F.when(F.col("cohort") == g, F.col("sample")))
    rows = _cohort(spark, d).where("cohort is not null")
    out = rows.agg(n("test").alias("n_test"), n("control").alias("n_control"), F.countDistinct("series").alias("n_series"))
    return out.withColumn("ratio", F.round(F.try_divide("n_test", "n_control"), 6))


@query("G15_study_breakdown", sql("samples", COHORT + " SELECT series, count(*) FILTER (WHERE cohort = 'test') AS n_test, count(*) FILTER (WHERE cohort = 'control') AS n_control FROM coh WHERE cohort IS NOT NULL GROUP BY series ORDER BY n_test + n_control DESC, series LIMIT 20"))
def g15(spark, d):
    return study_pairs(_cohort(spark, d)).orderBy(F.desc(F.col("n_test") + F.col("n_control")), "series").limit(20)


@query("J12_studies_with_both_groups", sql("samples", COHORT + ", p AS (SELECT series, count(*) FILTER (WHERE cohort = 'test') AS n_test, count(*) FILTER (WHERE cohort = 'control') AS n_control FROM coh WHERE cohort IS NOT NULL GROUP BY series) SELECT series, n_test, n_control FROM p WHERE n_test >= 3 AND n_control >= 3"))
def j12(spark, d):
    return study_pairs(_cohort(spark, d)).where("n_test >= 3 and n_control >= 3")


@query("J10_controls_not_in_test", sql("samples", """ SELECT c.sample, c.platform FROM samples c WHERE regexp_matches(lower(c.title), 'that') AND c.sample NOT IN (SELECT sample FROM samples WHERE regexp_matches(lower(title), 'idiot|stupid'))"""))
def j10(spark, d):
    rows = samples(spark, d)
    test = rows.where(F.col("title").rlike("(?i)idiot|stupid")).select("sample")
    return rows.where(F.col("title").rlike("(?i)that")).join(test, "sample", "left_anti").select("sample", "platform")


@query("J11_controls_of_test_studies", sql("samples", COHORT + " SELECT DISTINCT sample FROM coh WHERE cohort = 'control' AND series IN (SELECT series FROM coh WHERE cohort = 'test' AND platform = 'en')"))
def j11(spark, d):
    rows = _cohort(spark, d)
    studies = rows.where("cohort = 'test' and platform = 'en'").select("series").distinct()
    return rows.where("cohort = 'control'").join(studies, "series", "left_semi").select("sample").distinct()


@query("G16_majority_platform", sql("samples", BY_SERIES + ", c AS (SELECT series, platform, count(*) AS n, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, platform) AS i FROM bys GROUP BY series, platform) SELECT series, platform, n FROM c WHERE i = 1"))
def g16(spark, d):
    counted = series(samples(spark, d)).groupBy("series", "platform").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("platform", "n"), F.struct(-F.col("n"), "platform"))
    return counted.groupBy("series").agg(best.alias("x")).select("series", "x.*")


@query("U03_union_conflict_is_test", sql("samples", COHORT + " SELECT sample, CASE WHEN bool_or(cohort = 'test') THEN 'test' ELSE 'control' END AS cohort FROM coh WHERE cohort IS NOT NULL GROUP BY sample"))
def u03(spark, d):
    rows = _cohort(spark, d).where("cohort is not null")
    return rows.groupBy("sample").agg(F.max("cohort").alias("cohort"))


@query("W08_quota_per_group", sql("cells", " SELECT disease, cell FROM (SELECT disease, cell, row_number() OVER (PARTITION BY disease ORDER BY cell) AS i FROM cells) WHERE i <= 100"))
def w08(spark, d):
    rank = F.row_number().over(Window.partitionBy("disease").orderBy("cell"))
    return cells(spark, d).withColumn("i", rank).where("i <= 100").select("disease", "cell")


@query("W09_seeded_sample")
def w09(spark, d):
    """A fixed random sample: the 50 samples of least hash."""
    return samples(spark, d).select("sample").orderBy(F.xxhash64("sample", F.lit(42)), "sample").limit(50)


@query("W10_matched_first_then_budget", sql("samples", COHORT + ", c AS (SELECT sample, max(CASE WHEN series IN (SELECT series FROM coh WHERE cohort = 'test' AND platform = 'en') THEN 1 ELSE 0 END) AS matched FROM coh WHERE cohort = 'control' GROUP BY sample) SELECT sample, matched::BIGINT AS matched FROM c ORDER BY matched DESC, sample LIMIT 120"))
def w10(spark, d):
    rows = _cohort(spark, d)
    studies = rows.where("cohort = 'test' and platform = 'en'").select("series").distinct().withColumn("hit", F.lit(1).cast("long"))
    control = rows.where("cohort = 'control'").join(studies, "series", "left").groupBy("sample").agg(F.max(F.coalesce("hit", F.lit(0))).alias("matched"))
    return control.orderBy(F.desc("matched"), "sample").limit(120)


@query("G17_library_sizes", sql("expr", " SELECT sample, sum(count)::BIGINT AS library FROM expr GROUP BY sample HAVING sum(count) >= 3000"))
def g17(spark, d):
    return expression(spark, d).groupBy("sample").agg(F.sum("count").alias("library")).where("library >= 3000")


@query("G18_gene_totals", sql("expr", " SELECT gene, sum(count)::BIGINT AS total FROM expr GROUP BY gene HAVING sum(count) >= 10"))
def g18(spark, d):
    return expression(spark, d).groupBy("gene").agg(F.sum("count").alias("total")).where("total >= 10")


@query("G19_log_cpm", sql("expr", ", l AS (SELECT sample, sum(count) AS library FROM expr GROUP BY sample) SELECT gene, expr.sample, round(log2(count / library * 1e6 + 1), 8) AS value FROM expr JOIN l ON expr.sample = l.sample"))
def g19(spark, d):
    return log_cpm(expression(spark, d)).select("gene", "sample", F.round("value", 8).alias("value"))


CPM = ", l AS (SELECT sample, sum(count) AS library FROM expr GROUP BY sample), v AS (SELECT gene, expr.sample, grp, log2(count / library * 1e6 + 1) AS value FROM expr JOIN l ON expr.sample = l.sample)"


@query("G20_group_means", sql("expr", CPM + " SELECT gene, round(avg(value) FILTER (WHERE grp = 'test'), 8) AS mean_test, round(avg(value) FILTER (WHERE grp = 'control'), 8) AS mean_control, round(avg(value) FILTER (WHERE grp = 'test') - avg(value) FILTER (WHERE grp = 'control'), 8) + 0.0 AS log2fc FROM v GROUP BY gene HAVING count(*) FILTER (WHERE grp = 'test' AND value > 0) >= 3 AND count(*) FILTER (WHERE grp = 'control' AND value > 0) >= 3"))
def g20(spark, d):
    out = group_summary(log_cpm(expression(spark, d)))
    return out.select("gene", F.round("mean_test", 8).alias("mean_test"), F.round("mean_control", 8).alias("mean_control"), (F.round("log2fc", 8) + 0.0).alias("log2fc"))


@query("X02_mann_whitney_z", sql("expr", CPM + """, r AS (SELECT gene, grp, count(*) OVER (PARTITION BY gene, round(value, 9)) AS t, rank() OVER (PARTITION BY gene ORDER BY round(value, 9)) AS k FROM v),
  s AS (SELECT gene, sum(k + (t - 1) / 2.0) FILTER (WHERE grp = 'test') AS r1, count(*) FILTER (WHERE grp = 'test')::DOUBLE AS n1, count(*) FILTER (WHERE grp = 'control')::DOUBLE AS n2, sum(t * t - 1)::DOUBLE AS tie FROM r GROUP BY gene)
  SELECT gene, (r1 - n1 * (n1 + 1) / 2)::DOUBLE AS u, round(sign(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) * greatest(abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1)))), 8) + 0.0 AS z FROM s WHERE n1 > 0 AND n2 > 0"""))
def x02(spark, d):
    values = log_cpm(expression(spark, d)).withColumn("value", F.round("value", 9))
    return mann_whitney(values).select("gene", F.col("u").cast("double").alias("u"), (F.round("z", 8) + 0.0).alias("z"))


@query("X01_differential_expression")
def x01(spark, d):
    """Filters, normalisation, rank test, adjustment and significance in one job."""
    counts = expression(spark, d)
    libraries = counts.groupBy("sample").agg(F.sum("count").alias("library")).where("library >= 1000").select("sample")
    genes = counts.groupBy("gene").agg(F.sum("count").alias("total")).where("total >= 10").select("gene")
    values = log_cpm(counts.join(libraries, "sample", "left_semi").join(genes, "gene", "left_semi"))
    tested = mann_whitney_p(values).join(group_summary(values).select("gene", "log2fc"), "gene")
    return benjamini_hochberg(tested, "pvalue", []).select("gene", "log2fc", "pvalue", "padj")


@query("X03_welch_t", sql("expr", CPM + """, s AS (SELECT gene, avg(value) FILTER (WHERE grp = 'test') AS m1, avg(value) FILTER (WHERE grp = 'control') AS m2, var_samp(value) FILTER (WHERE grp = 'test') / count(*) FILTER (WHERE grp = 'test') AS a,
  var_samp(value) FILTER (WHERE grp = 'control') / count(*) FILTER (WHERE grp = 'control') AS b, count(*) FILTER (WHERE grp = 'test') AS n1, count(*) FILTER (WHERE grp = 'control') AS n2 FROM v GROUP BY gene)
  SELECT gene, round((m1 - m2) / sqrt(a + b), 6) + 0.0 AS t, round((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)), 4) AS df FROM s WHERE n1 > 2 AND n2 > 2"""))
def x03(spark, d):
    out = welch(group_summary(log_cpm(expression(spark, d))))
    return out.select("gene", (F.round("t", 6) + 0.0).alias("t"), F.round("df", 4).alias("df"))


@query("X14_quantile_normalised", sql("expr", ", r AS (SELECT gene, sample, row_number() OVER (PARTITION BY sample ORDER BY count, gene) AS k, count FROM expr), m AS (SELECT k, avg(count) AS normal FROM r GROUP BY k) SELECT gene, sample, round(normal, 8) AS normal FROM r JOIN m ON r.k = m.k"))
def x14(spark, d):
    values = expression(spark, d).withColumnRenamed("count", "value")
    return quantile_normalised(values).select("gene", "sample", F.round("normal", 8).alias("normal"))


@query("X12_over_representation")
def x12(spark, d):
    part = read(spark, d, "part")
    sets = part.select(F.concat_ws(" ", "p_brand", "p_type").alias("term"), F.col("p_partkey").alias("gene"))
    genes = read(spark, d, "lineitem").where("l_discount = 0.1 and l_tax = 0.08").select(F.col("l_partkey").alias("gene"))
    return over_representation(genes, sets, background=2_000_000)


@query("G22_cell_type_statistics", sql("cells", " SELECT cell_type, count(*) AS n, round(avg(value), 8) AS mean, median(value) AS median, round(stddev_pop(value), 8) AS std, round(100.0 * count(*) FILTER (WHERE value > 0) / count(*), 8) AS percent FROM cells GROUP BY cell_type HAVING count(*) >= 10"))
def g22(spark, d):
    out = cells(spark, d).groupBy("cell_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"), F.round(F.stddev_pop("value"), 8).alias("std"),
        F.round(F.lit(100.0) * F.count_if(F.col("value") > 0) / F.count("*"), 8).alias("percent"),
    )
    return out.where("n >= 10").join(medians(cells(spark, d), ["cell_type"]), "cell_type")


#: P(|Z| >= |@|): the error function as a series without cancellation, its terms from the logarithm of the gamma function.
NORMAL_P = "CASE WHEN abs(@) > 8 THEN 0 ELSE 1 - 2 / sqrt(pi()) * exp(-@ * @ / 2) * list_sum(list_transform(range(0, 240), lambda i: exp((2 * i + 1) * ln(greatest(abs(@) / sqrt(2), 1e-300)) + i * ln(2) - ((i + 1) * ln(2) + lgamma(i + 1.5) - ln(pi()) / 2)))) END"

#: The rank test of cases against normal cells within groups.
RANK_TEST = """, r AS (SELECT @, disease, count(*) OVER (PARTITION BY @, value) AS t, rank() OVER (PARTITION BY @ ORDER BY value) AS k FROM cells),
  s AS (SELECT @, sum(k + (t - 1) / 2.0) FILTER (WHERE disease = 'case') AS r1, (count(*) FILTER (WHERE disease = 'case'))::DOUBLE AS n1, (count(*) FILTER (WHERE disease = 'normal'))::DOUBLE AS n2, sum(t * t - 1)::DOUBLE AS tie FROM r GROUP BY @),
  w AS (SELECT @, sign(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) * greatest(abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1)))) AS w FROM s WHERE n1 > 0 AND n2 > 0),
  z AS (SELECT @, round(w, 6) + 0.0 AS z, round(""" + NORMAL_P.replace("@", "w") + """, 6) + 0.0 AS pvalue FROM w)"""


def rank_z(spark, d, by: str):
    rows = cells(spark, d).withColumn("grp", F.when(F.col("disease") == "case", "test").otherwise("control"))
    return rank_p(mann_whitney_of_groups(rows, [by])).select(by, (F.round("z", 6) + 0.0).alias("z"), (F.round("pvalue", 6) + 0.0).alias("pvalue"))


@query("G24_condition_comparison", sql("cells", RANK_TEST.replace("@", "cell_type") + " SELECT cells.cell_type, count(*) FILTER (WHERE disease = 'case') AS n_case, count(*) FILTER (WHERE disease = 'normal') AS n_normal, round(log2((avg(value) FILTER (WHERE disease = 'case') + 0.01) / (avg(value) FILTER (WHERE disease = 'normal') + 0.01)), 8) + 0.0 AS log2fc, min(z) AS z, min(pvalue) AS pvalue FROM cells JOIN z ON cells.cell_type = z.cell_type GROUP BY cells.cell_type HAVING count(*) FILTER (WHERE disease = 'case') >= 20 AND count(*) FILTER (WHERE disease = 'normal') >= 20"))
def g24(spark, d):
    of = lambda g, x: F.when(F.col("disease") == g, x)
    ratio = (F.avg(of("case", F.col("value"))) + 0.01) / (F.avg(of("normal", F.col("value"))) + 0.01)
    out = cells(spark, d).groupBy("cell_type").agg(F.count_if(F.col("disease") == "case").alias("n_case"), F.count_if(F.col("disease") == "normal").alias("n_normal"), (F.round(F.log2(ratio), 8) + 0.0).alias("log2fc"))
    return out.where("n_case >= 20 and n_normal >= 20").join(rank_z(spark, d, "cell_type"), "cell_type")


@query("G25_dataset_rollup", sql("cells", " SELECT dataset, count(*) AS n, string_agg(DISTINCT cell_type, ',' ORDER BY cell_type) AS cell_types, string_agg(DISTINCT disease, ',' ORDER BY disease) AS diseases FROM cells GROUP BY dataset"))
def g25(spark, d):
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return cells(spark, d).groupBy("dataset").agg(F.count("*").alias("n"), joined("cell_type").alias("cell_types"), joined("disease").alias("diseases"))


@query("G26_strongest_cell_type", sql("cells", ", m AS (SELECT dataset, cell_type, avg(value) AS a FROM cells GROUP BY ALL) SELECT dataset, arg_max(cell_type, a) AS cell_type, round(max(a), 8) AS mean, count(*) FILTER (WHERE a > 10) AS high FROM m GROUP BY dataset"))
def g26(spark, d):
    m = cells(spark, d).groupBy("dataset", "cell_type").agg(F.avg("value").alias("a"))
    return m.groupBy("dataset").agg(F.max_by("cell_type", "a").alias("cell_type"), F.round(F.max("a"), 8).alias("mean"), F.count_if(F.col("a") > 10).alias("high"))


@query("G27_mean_of_study_means", sql("cells", ", s AS (SELECT cell_type, disease, dataset, avg(value) AS a FROM cells GROUP BY ALL), m AS (SELECT cell_type, disease, avg(a) AS a FROM s GROUP BY ALL) SELECT cell_type, round(log2((max(a) FILTER (WHERE disease = 'case') + 1) / (max(a) FILTER (WHERE disease = 'normal') + 1)), 8) + 0.0 AS log2fc FROM m GROUP BY cell_type"))
def g27(spark, d):
    s = cells(spark, d).groupBy("cell_type", "disease", "dataset").agg(F.avg("value").alias("a")).groupBy("cell_type", "disease").agg(F.avg("a").alias("a"))
    of = lambda g: F.max(F.when(F.col("disease") == g, F.col("a"))) + 1
    return s.groupBy("cell_type").agg((F.round(F.log2(of("case") / of("normal")), 8) + 0.0).alias("log2fc"))


@query("J17_sparse_to_dense", sql("expr", ", g AS (SELECT DISTINCT gene FROM expr), s AS (SELECT DISTINCT sample FROM expr) SELECT g.gene, s.sample, coalesce(count, 0)::BIGINT AS count FROM g CROSS JOIN s LEFT JOIN expr ON expr.gene = g.gene AND expr.sample = s.sample"))
def j17(spark, d):
    return dense(expression(spark, d))


@query("J22_merge_matrices", sql("expr", ", a AS (SELECT gene, sum(count)::BIGINT AS left_count FROM expr WHERE sample % 2 = 0 GROUP BY gene), b AS (SELECT gene, sum(count)::BIGINT AS right_count FROM expr WHERE sample % 2 = 1 GROUP BY gene) SELECT coalesce(a.gene, b.gene) AS gene, left_count, right_count FROM a FULL JOIN b ON a.gene = b.gene"))
def j22(spark, d):
    rows = expression(spark, d)
    a = rows.where("sample % 2 = 0").groupBy("gene").agg(F.sum("count").alias("left_count"))
    b = rows.where("sample % 2 = 1").groupBy("gene").agg(F.sum("count").alias("right_count"))
    return a.join(b, "gene", "full_outer")


@query("J13_lookup_with_fallback", sql("assoc", " SELECT DISTINCT symbol, coalesce(CASE WHEN gene % 3 = 0 THEN 'ENSG' || lpad(gene::VARCHAR, 11, '0') END, symbol) AS mapped FROM assoc"))
def j13(spark, d):
    from spindle.sources.views import associations

    genes = associations(spark, d).select("gene", "symbol").distinct()
    table = read(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("gene"), F.concat(F.lit("ENSG"), F.lpad(F.col("p_partkey").cast("string"), 11, "0")).alias("id"))
    return genes.join(table, "gene", "left").select("symbol", F.coalesce("id", "symbol").alias("mapped"))


@query("J14_case_insensitive_fallback", "WITH q AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT upper(p_brand) FROM part UNION SELECT DISTINCT 'x' || p_brand FROM part), t AS (SELECT p_brand AS key, min(p_partkey) AS id FROM part GROUP BY p_brand) SELECT q.name, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL THEN 'exact' WHEN b.id IS NOT NULL THEN 'case' ELSE 'none' END AS how FROM q LEFT JOIN t a ON q.name = a.key LEFT JOIN t b ON lower(q.name) = lower(b.key)")
def j14(spark, d):
    part = read(spark, d, "part").select("p_brand", "p_partkey")
    brand = part.select("p_brand").distinct()
    asked = brand.select(F.col("p_brand").alias("name")).union(brand.select(F.upper("p_brand"))).union(brand.select(F.concat(F.lit("x"), "p_brand"))).distinct()
    table = part.groupBy("p_brand").agg(F.min("p_partkey").alias("id"))
    exact = table.select(F.col("p_brand").alias("name"), F.col("id").alias("a"))
    case = table.groupBy(F.lower("p_brand").alias("low")).agg(F.min("id").alias("b"))
    rows = asked.join(exact, "name", "left").withColumn("low", F.lower("name")).join(case, "low", "left")
    how = F.when(F.col("a").isNotNull(), "exact").when(F.col("b").isNotNull(), "case").otherwise("none")
    return rows.select("name", F.coalesce("a", "b").alias("id"), how.alias("how"))


@query("P26_gene_prefix_filters", "SELECT p_partkey AS id, p_name AS name FROM part WHERE NOT (starts_with(upper(p_name), 'RED') OR starts_with(upper(p_name), 'BLUE'))")
def p26(spark, d):
    low = F.upper("p_name")
    return read(spark, d, "part").where(~(low.startswith("RED") | low.startswith("BLUE"))).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("B13_mapping_coverage", "WITH curated AS (SELECT DISTINCT 'GENE' || p_partkey AS gene FROM part WHERE p_partkey % 3 = 0), known AS (SELECT DISTINCT upper(p_name) AS symbol FROM part WHERE p_size > 40), g AS (SELECT 'GENE' || p_partkey AS gene, upper(p_name) AS symbol FROM part) SELECT CASE WHEN curated.gene IS NOT NULL THEN 'curated' WHEN known.symbol IS NOT NULL THEN 'symbol' ELSE 'unmapped' END AS how, count(*) AS n FROM g LEFT JOIN curated ON g.gene = curated.gene LEFT JOIN known ON g.symbol = known.symbol GROUP BY 1")
def b13(spark, d):
    """Genes found in a curated table, else by their symbol in any case, else not at all."""
    part = read(spark, d, "part")
    genes = part.select(F.concat(F.lit("GENE"), "p_partkey").alias("gene"), F.upper("p_name").alias("symbol"))
    curated = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("GENE"), "p_partkey").alias("gene")).distinct().withColumn("curated", F.lit(True))
    known = part.where("p_size > 40").select(F.upper("p_name").alias("symbol")).distinct().withColumn("known", F.lit(True))
    how = F.when(F.col("curated"), "curated").when(F.col("known"), "symbol").otherwise("unmapped")
    return genes.join(curated, "gene", "left").join(known, "symbol", "left").groupBy(how.alias("how")).agg(F.count("*").alias("n"))


@query("B20_token_frequencies", sql("samples", ", w AS (SELECT unnest(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM samples) SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word"))
def b20(spark, d):
    words = samples(spark, d).select(F.explode(F.split(F.trim(tokens("title")), " ")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@query("B10_phrase_counts", sql("samples", " SELECT platform, count(*) FILTER (WHERE contains(' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ', ' in the ')) AS n FROM samples GROUP BY platform"))
def b10(spark, d):
    return samples(spark, d).groupBy("platform").agg(F.count_if(phrase_match(["title"], ["in the"])).alias("n"))
