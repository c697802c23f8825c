"""Queries over counts: filters, normalisations, exact rank tests, enrichment by direction."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindle.operators.analysis import analyse, expanded, ontology_phrases
from spindle.operators.negative_binomial import negative_binomial_test, size_factors
from spindle.operators.normalise import expressed, log_quantile, tmm, tmm_factors
from spindle.operators.statistics import decimal_mean, mann_whitney_p, over_representation
from spindle.plans.cohorts import NORMAL_P
from spindle.plans.registry import query
from spindle.sources.views import associations, expression, hierarchy, read, samples, sql

DENSE = ", dense AS (SELECT g.gene, s.sample, coalesce(count, 0)::BIGINT AS count FROM (SELECT DISTINCT gene FROM expr) g CROSS JOIN (SELECT DISTINCT sample FROM expr) s LEFT JOIN expr ON expr.gene = g.gene AND expr.sample = s.sample)"


@query("X14_expressed_genes", sql("expr", " SELECT gene, count(*) FILTER (WHERE count >= 50) AS n_expressed FROM expr GROUP BY gene HAVING count(*) FILTER (WHERE count >= 50) >= 0.05 * (SELECT count(DISTINCT sample) FROM expr) AND n_expressed > 0"))
def x14_expressed(spark, d):
    return expressed(expression(spark, d), reads=50, share=0.05)


@query("X14_log_quantile", sql("expr", DENSE + ", r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY log2(count + 1), gene) AS k FROM dense), m AS (SELECT k, avg(log2(count + 1)) AS normal FROM r GROUP BY k) SELECT gene, sample, round(log2(count + 1), 8) AS value, round(normal, 8) AS normal FROM r JOIN m ON r.k = m.k"))
def x14_log_quantile(spark, d):
    out = log_quantile(expression(spark, d))
    return out.select("gene", "sample", F.round("value", 8).alias("value"), F.round("normal", 8).alias("normal"))


TMM = DENSE + """, own AS (SELECT dense.*, sum(count) OVER (PARTITION BY sample)::DOUBLE AS library FROM dense WHERE gene IN (SELECT gene FROM expr WHERE count > 0)),
  q AS (SELECT sample, quantile_cont(count / library, 0.75) AS q FROM own WHERE library > 0 GROUP BY sample), ref AS (SELECT sample FROM q ORDER BY abs(q - (SELECT avg(q) FROM q)), sample LIMIT 1),
  p AS (SELECT a.sample, log2((a.count / a.library) / (b.count / b.library)) AS m, log2((a.count / a.library) * (b.count / b.library)) / 2 AS a, (a.library - a.count) / a.library / a.count + (b.library - b.count) / b.library / b.count AS v
    FROM own a JOIN own b ON a.gene = b.gene AND b.sample IN (SELECT sample FROM ref) AND a.count > 0 AND b.count > 0),
  k AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n, rank() OVER (PARTITION BY sample ORDER BY m) + (count(*) OVER (PARTITION BY sample, m) - 1) / 2 AS rm, rank() OVER (PARTITION BY sample ORDER BY a) + (count(*) OVER (PARTITION BY sample, a) - 1) / 2 AS ra FROM p),
  f AS (SELECT sample, coalesce(CASE WHEN max(abs(m)) < 1e-6 THEN 0 ELSE sum(m / v) FILTER (WHERE ok) / sum(1 / v) FILTER (WHERE ok) END, 0) AS log FROM (SELECT *, rm BETWEEN floor(n * 0.3) + 1 AND n - floor(n * 0.3) AND ra BETWEEN floor(n * 0.05) + 1 AND n - floor(n * 0.05) AND v > 0 AS ok FROM k) GROUP BY sample),
  factors AS (SELECT sample, library, pow(2, coalesce(log, 0) - avg(coalesce(log, 0)) OVER ()) AS factor FROM (SELECT DISTINCT sample, library FROM own WHERE library > 0) LEFT JOIN f USING (sample))"""


@query("X14_tmm_factors", sql("expr", TMM + " SELECT sample, library::BIGINT AS library, round(factor, 8) AS factor FROM factors"))
def x14_tmm_factors(spark, d):
    return tmm_factors(expression(spark, d)).select("sample", "library", F.round("factor", 8).alias("factor"))


@query("X14_tmm", sql("expr", TMM + " SELECT gene, sample, round(count / (library * factor) * 1e6, 4) AS value FROM expr JOIN factors USING (sample)"))
def x14_tmm(spark, d):
    return tmm(expression(spark, d)).select("gene", "sample", F.round("value", 4).alias("value"))


#: Order prices of a customer as values of a gene: some customers have few orders, and no two prices are equal.
RANKED = """WITH RECURSIVE v AS (SELECT o_custkey AS gene, o_totalprice AS value, CASE WHEN o_orderstatus = 'O' THEN 'test' ELSE 'control' END AS grp FROM orders),
  r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) AS k, count(*) OVER (PARTITION BY gene, value) AS t FROM v),
  s AS (SELECT gene, sum(k + (t - 1) / 2.0) FILTER (WHERE grp = 'test') - count(*) FILTER (WHERE grp = 'test') * (count(*) FILTER (WHERE grp = 'test') + 1) / 2 AS u, count(*) FILTER (WHERE grp = 'test') AS n1, count(*) FILTER (WHERE grp = 'control') AS n2, sum(t * t - 1) AS tie FROM r GROUP BY gene HAVING n1 > 0 AND n2 > 0),
  z AS (SELECT *, sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s),
  pairs AS (SELECT DISTINCT least(n1, n2) AS m, greatest(n1, n2) AS n FROM s WHERE tie = 0 AND least(n1, n2) <= 8),
  -- the coefficients of a Gaussian binomial, one factor a step
  g AS (SELECT m, n, 0::BIGINT AS i, list_transform(range(0, m * n + 1), lambda u: CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS c FROM pairs
    UNION ALL SELECT m, n, i + 1, list_transform(range(0, m * n + 1), lambda u: list_sum(list_transform(range(0, u // (i + 1) + 1), lambda j: c[u - j * (i + 1) + 1] - CASE WHEN u - j * (i + 1) >= n + i + 1 THEN c[u - j * (i + 1) - n - i] ELSE 0 END))) FROM g WHERE i < m),
  d AS (SELECT m, n, c, list_sum(c) AS total FROM g WHERE i = m)
"""


@query("X02_rank_test", RANKED + f" SELECT gene, z.u::DOUBLE AS u, n1, n2, round(CASE WHEN d.m IS NOT NULL THEN least(1, 2 * list_sum(c[1:least(z.u, n1 * n2 - z.u)::BIGINT + 1]) / total) ELSE {NORMAL_P.replace('@', 'z')} END, 8) + 0.0 AS pvalue FROM z LEFT JOIN d ON tie = 0 AND d.m = least(n1, n2) AND d.n = greatest(n1, n2)")
def x02_rank_test(spark, d):
    """Exact where a customer has few open or few other orders, normal otherwise."""
    o = read(spark, d, "orders")
    values = o.select(F.col("o_custkey").alias("gene"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderstatus") == "O", "test").otherwise("control").alias("grp"))
    return mann_whitney_p(values).select("gene", F.col("u").cast("double").alias("u"), "n1", "n2", (F.round("pvalue", 8) + 0.0).alias("pvalue"))


#: Genes by the sign of their mean fold change, brands and kinds of parts as terms.
LISTS = sql("assoc", """, up AS (SELECT gene, CASE WHEN avg(log2fc) > 0 THEN 'up' ELSE 'down' END AS direction FROM assoc WHERE abs(log2fc) >= 0.1 AND adj_p <= 0.05 GROUP BY gene HAVING avg(log2fc) <> 0),
  sets AS (SELECT p_partkey AS gene, p_brand || ' ' || p_type AS term FROM part UNION SELECT p_partkey, p_type FROM part), sizes AS (SELECT term, count(DISTINCT gene) AS term_size FROM sets GROUP BY term),
  q AS (SELECT direction, count(*) AS query_size FROM up GROUP BY direction HAVING count(*) >= 5), hits AS (SELECT direction, term, count(*) AS overlap FROM up JOIN sets USING (gene) GROUP BY ALL),
  t AS (SELECT direction, term, overlap, query_size, term_size FROM hits JOIN q USING (direction) JOIN sizes USING (term)),
  p AS (SELECT *, least(1, list_sum(list_transform(range(overlap, least(query_size, term_size) + 1), lambda i: exp(lgamma(term_size + 1) - lgamma(i + 1) - lgamma(term_size - i + 1) + lgamma(20000 - term_size + 1.0) - lgamma(query_size - i + 1) - lgamma(20000 - term_size - query_size + i + 1.0) - lgamma(20001.0) + lgamma(query_size + 1) + lgamma(20000 - query_size + 1.0))))) AS p FROM t)""")


def _lists(spark, d):
    a = associations(spark, d).where((F.abs("log2fc") >= 0.1) & (F.col("adj_p") <= 0.05))
    means = a.groupBy("gene").agg(decimal_mean("log2fc").alias("m")).where("m <> 0")
    part = read(spark, d, "part")
    kinds = part.select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("term"))
    sets = part.select(F.col("p_partkey").alias("gene"), F.concat_ws(" ", "p_brand", "p_type").alias("term")).unionByName(kinds)
    return means.select("gene", F.when(F.col("m") > 0, "up").otherwise("down").alias("direction")), sets


COLUMNS = ("direction", "term", "overlap", "query_size", "term_size")


@query("X12_enrichment_by_direction", LISTS + " SELECT direction, term, overlap, query_size, term_size, round(p, 8) AS pvalue, round(least(1, min(p * n / k) OVER (PARTITION BY direction ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 6) AS padj FROM (SELECT *, max(i) OVER (PARTITION BY direction, round(p, 12)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY direction) AS n, row_number() OVER (PARTITION BY direction ORDER BY p) AS i FROM p))")
def x12_by_direction(spark, d):
    """Separate lists of genes that go up and down, adjusted within each."""
    genes, sets = _lists(spark, d)
    out = over_representation(genes, sets, background=20_000, by=("direction",))
    return out.select(*COLUMNS, F.round("pvalue", 8).alias("pvalue"), F.round("padj", 6).alias("padj"))


@query("X12_enrichment_bonferroni", LISTS + " SELECT direction, term, overlap, query_size, term_size, round(p, 8) AS pvalue, round(least(1, p * count(*) OVER (PARTITION BY direction)), 6) AS padj FROM p")
def x12_bonferroni(spark, d):
    genes, sets = _lists(spark, d)
    out = over_representation(genes, sets, background=20_000, by=("direction",), correction="bonferroni")
    return out.select(*COLUMNS, F.round("pvalue", 8).alias("pvalue"), F.round("padj", 6).alias("padj"))


@query("X04_size_factors", sql("expr", """, one AS (SELECT * FROM expr WHERE count > 0), n AS (SELECT count(DISTINCT sample) AS n FROM expr), g AS (SELECT gene, sum(ln(count)) / (SELECT n FROM n) AS m, count(*) = (SELECT n FROM n) AS whole FROM one GROUP BY gene),
  u AS (SELECT * FROM g WHERE whole OR NOT (SELECT bool_or(whole) FROM g)), l AS (SELECT sample, median(ln(count) - m) AS log FROM one JOIN u USING (gene) GROUP BY sample)
  SELECT sample, round(exp(CASE WHEN (SELECT bool_or(whole) FROM g) THEN log ELSE log - avg(log) OVER () END), 8) AS factor FROM l"""))
def x04_size_factors(spark, d):
    return size_factors(expression(spark, d)).select("sample", F.round("factor", 8).alias("factor"))


@query("X04_negative_binomial")
def x04(spark, d):
    """Maximum-likelihood dispersions and Wald tests of all genes; tested against a plain-Python likelihood."""
    return negative_binomial_test(expression(spark, d))


#: Counts of 40 genes by sample, and titles that name the disease or a control.
ANALYSED = sql("samples", """, cnt AS (SELECT l_partkey % 40 AS gene, 'GSM' || (l_orderkey % 200) AS sample, sum(l_quantity)::BIGINT AS count FROM lineitem GROUP BY ALL), bys AS (SELECT DISTINCT sample, title, series FROM (SELECT *, trim(unnest(string_split(series_id, ','))) AS series FROM samples) WHERE starts_with(series, 'GSE')),
  t AS (SELECT DISTINCT sample FROM samples WHERE contains(' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ', ' of the ')), coh AS (SELECT DISTINCT sample, series, CASE WHEN sample IN (SELECT sample FROM t) THEN 'test' ELSE 'control' END AS grp FROM bys WHERE sample IN (SELECT sample FROM t) OR contains(lower(title), 'e')),
  near AS (SELECT series FROM coh WHERE grp = 'test'), rows AS (SELECT DISTINCT sample, grp FROM coh WHERE series IN (SELECT series FROM near)), l AS (SELECT sample, sum(count) AS library FROM cnt WHERE sample IN (SELECT sample FROM rows) GROUP BY sample HAVING sum(count) > 0),
  v AS (SELECT gene, grp, log2(count / library * 1e6 + 1) AS value FROM cnt JOIN rows USING (sample) JOIN l USING (sample)), r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) AS k, count(*) OVER (PARTITION BY gene, value) AS ties FROM v),
  s AS (SELECT gene, avg(value) FILTER (WHERE grp = 'test') - avg(value) FILTER (WHERE grp = 'control') AS log2fc, sum(k + (ties - 1) / 2.0) FILTER (WHERE grp = 'test') - count(*) FILTER (WHERE grp = 'test') * (count(*) FILTER (WHERE grp = 'test') + 1) / 2 AS u, count(*) FILTER (WHERE grp = 'test') AS n_test, count(*) FILTER (WHERE grp = 'control') AS n_control, sum(ties * ties - 1) AS tie FROM r GROUP BY gene HAVING n_test > 8 AND n_control > 8),
  z AS (SELECT *, sign(u - n_test * n_control / 2) * greatest(abs(u - n_test * n_control / 2) - 0.5, 0) / sqrt(n_test * n_control / 12 * ((n_test + n_control + 1) - tie / ((n_test + n_control) * (n_test + n_control - 1)))) AS z FROM s)""")


@query("B12_analysis_by_mode", ANALYSED + f" SELECT '2 keyword' AS strategy, 'study-prioritised' AS mode, gene, n_test, n_control, round(log2fc, 8) + 0.0 AS log2fc, round({NORMAL_P.replace('@', 'z')}, 7) + 0.0 AS pvalue FROM z")
def b12_by_mode(spark, d):
    """The terms of the ontology are in no title, so keywords find the tests; too few studies are asked to match, so tests meet the controls of their studies."""
    counts = read(spark, d, "lineitem").groupBy((F.col("l_partkey") % 40).alias("gene"), F.concat(F.lit("GSM"), F.col("l_orderkey") % 200).alias("sample")).agg(F.sum("l_quantity").cast("long").alias("count"))
    labels = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("term "), "p_partkey").alias("label"))
    terms = ontology_phrases("term 2", labels, hierarchy(spark, d)).withColumn("strategy", F.lit("1 ontology"))
    words = spark.createDataFrame([("2 keyword", p) for p in expanded("of the", {"of the": ["of the"]})], "strategy string, phrase string")
    out = analyse(samples(spark, d), counts, terms.select("strategy", "phrase").unionByName(words), F.lower("title").contains("e"), least=100_000)
    return out.where("n_test > 8 and n_control > 8").select("strategy", "mode", "gene", "n_test", "n_control", (F.round("log2fc", 8) + 0.0).alias("log2fc"), (F.round("pvalue", 7) + 0.0).alias("pvalue"))
