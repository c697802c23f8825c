"""Queries over cohorts: study-matched selection, modes of analysis, per-study tests, and filters on samples and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindle.functions.lineage import stored
from spindle.operators.cohort import analysis_mode, directions, matched_cohort, search, series, with_biotype
from spindle.operators.graph import match, optional
from spindle.operators.statistics import group_summary, log_cpm, welch
from spindle.plans.catalogue import IS_DATASET, has
from spindle.plans.cohorts import BY_SERIES
from spindle.plans.registry import query
from spindle.sources.views import RDF_TYPE, DATASET, SCHEMA, associations, expression, read, samples, sql, triples

ROR_ORG = "https://ror.org/org"
#: Samples with a test pattern and controls without it, all with a tissue filter.
MATCHED = BY_SERIES + """, t AS (SELECT sample, series FROM bys WHERE regexp_matches(lower(title), 'idiot|stupid') AND regexp_matches(lower(title), 'the') AND NOT regexp_matches(lower(title), '!!')),
  c0 AS (SELECT sample, series, regexp_matches(lower(title), 'the') AS i FROM bys WHERE regexp_matches(lower(title), 'that') AND NOT regexp_matches(lower(title), '!!')),
  c AS (SELECT sample, series FROM c0 WHERE (i OR NOT (SELECT bool_or(i) FROM c0)) AND sample NOT IN (SELECT sample FROM t)),
  pairs AS (SELECT series, n_test, n_control FROM (SELECT series, count(DISTINCT sample) AS n_test FROM t GROUP BY series) JOIN (SELECT series, count(DISTINCT sample) AS n_control FROM c GROUP BY series) USING (series) WHERE n_test >= 3 AND n_control >= 3)"""


def _pairs(spark, d, include="the"):
    return matched_cohort(series(samples(spark, d)), F.col("title"), "idiot|stupid", "that", include, "!!")


@query("B11_study_matched_cohort", sql("samples", MATCHED + " SELECT * FROM pairs"))
def b11(spark, d):
    return _pairs(spark, d)


@query("B11_controls_without_include", sql("samples", BY_SERIES + """, t AS (SELECT sample, series FROM bys WHERE regexp_matches(lower(title), 'idiot') AND regexp_matches(lower(title), 'idiot')), c AS (SELECT sample, series FROM bys WHERE regexp_matches(lower(title), 'that') AND NOT regexp_matches(lower(title), 'idiot'))
  SELECT series, n_test, n_control FROM (SELECT series, count(DISTINCT sample) AS n_test FROM t GROUP BY series) JOIN (SELECT series, count(DISTINCT sample) AS n_control FROM c WHERE sample NOT IN (SELECT sample FROM t) GROUP BY series) USING (series)"""))
def b11b(spark, d):
    """No control passes the include filter (it excludes them), so that controls are only held against the exclude filter."""
    rows = series(samples(spark, d))
    # controls with the included word are taken out beforehand
    rows = rows.where(~(F.lower("title").rlike("that") & F.lower("title").rlike("idiot")) | F.lower("title").rlike("idiot"))
    test = rows.where(F.lower("title").rlike("idiot")).withColumn("title", F.lit("idiot"))
    control = rows.where(F.lower("title").rlike("that") & ~F.lower("title").rlike("idiot")).withColumn("title", F.lit("that"))
    return matched_cohort(test.unionByName(control), F.col("title"), "idiot", "that", include="idiot", least=1)


@query("B11_include_without_controls", sql("samples", BY_SERIES + """, t AS (SELECT sample, series FROM bys WHERE contains(lower(title), 'idiot')), c AS (SELECT sample, series FROM bys WHERE contains(lower(title), 'that') AND NOT contains(lower(title), 'idiot'))
  SELECT series, n_test, n_control FROM (SELECT series, count(DISTINCT sample) AS n_test FROM t GROUP BY series) JOIN (SELECT series, count(DISTINCT sample) AS n_control FROM c GROUP BY series) USING (series)"""))
def b11_fallback(spark, d):
    """The control pattern takes only titles without the included word, so that no control passes the include filter and all of them count."""
    return matched_cohort(series(samples(spark, d)), F.col("title"), "idiot", r"^(?![\s\S]*idiot)[\s\S]*that", include="idiot", least=1)


@query("X11_mode_selection", sql("samples", MATCHED + """, p AS (SELECT count(DISTINCT t.sample) AS n_test, count(DISTINCT c.sample) AS n_control FROM t JOIN c USING (series)), n AS (SELECT least_n, (SELECT count(*) FROM pairs) AS n_studies, n_test, n_control FROM p, (SELECT unnest([1, 3, 100000]) AS least_n))
  SELECT least_n, CASE WHEN n_studies >= least_n THEN 'study-matched' WHEN n_test > 0 AND n_control > 0 THEN 'study-prioritised' ELSE 'pooled' END AS mode, n_studies,
  CASE WHEN n_studies >= least_n THEN NULL ELSE 'only ' || n_studies || ' matched studies, needed ' || least_n || CASE WHEN n_test > 0 AND n_control > 0 THEN '' ELSE '; no study has test and control samples' END END AS reason FROM n"""))
def x11(spark, d):
    pairs = stored(_pairs(spark, d), "pairs")
    rows = series(samples(spark, d)).where(~F.lower("title").rlike("!!"))
    one = matched_cohort(rows, F.col("title"), "idiot|stupid", "that", "the", "!!", least=1)
    pooled = one.agg(F.coalesce(F.sum("n_test"), F.lit(0)).alias("n_test"), F.coalesce(F.sum("n_control"), F.lit(0)).alias("n_control"))
    out = None
    for least in (1, 3, 100_000):
        own = analysis_mode(pairs, pooled, least).withColumn("least_n", F.lit(least))
        out = own if out is None else out.unionByName(own)
    return out


@query("B12_analysis_dispatch", sql("samples", MATCHED + ", n AS (SELECT count(*) AS n FROM pairs) SELECT series, n_test, n_control, CASE WHEN n >= 3 THEN 'study-matched' ELSE 'pooled' END AS mode FROM pairs, n"))
def b12(spark, d):
    pairs = _pairs(spark, d)
    # one row on the right
    n = pairs.agg(F.count("*").alias("n"))
    return pairs.join(F.broadcast(n), how="cross").select("series", "n_test", "n_control", F.when(F.col("n") >= 3, "study-matched").otherwise("pooled").alias("mode"))


@query("B14_search_strategies", sql("samples", BY_SERIES + ", p AS (SELECT *, contains(' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ', ' the ') AS phrase, regexp_matches(lower(title), 'the.?') AS pattern FROM bys) SELECT 'phrase' AS strategy, count(DISTINCT sample) AS n, count(DISTINCT series) AS studies FROM p WHERE phrase UNION ALL SELECT 'pattern', count(DISTINCT sample), count(DISTINCT series) FROM p WHERE pattern UNION ALL SELECT 'both', count(DISTINCT sample), count(DISTINCT series) FROM p WHERE phrase AND pattern"))
def b14(spark, d):
    rows = series(samples(spark, d))
    phrase, pattern = search(rows, "the", ["title"], ["title"]), search(rows, "the.?", ["title"], ["title"])
    both = phrase.join(pattern.select("sample").distinct(), "sample", "left_semi")
    count = lambda rows, name: rows.agg(F.lit(name).alias("strategy"), F.countDistinct("sample").alias("n"), F.countDistinct("series").alias("studies"))
    return count(phrase, "phrase").unionByName(count(pattern, "pattern")).unionByName(count(both, "both"))


@query("B16_biotype_filter", sql("expr", ", b AS (SELECT p_partkey AS gene FROM part WHERE lower(p_type) = 'promo') SELECT gene, count(*) AS samples, sum(count)::BIGINT AS total FROM expr WHERE gene IN (SELECT gene FROM b) GROUP BY gene"))
def b16(spark, d):
    types = read(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("biotype"))
    return with_biotype(expression(spark, d), types, "Promo").groupBy("gene").agg(F.count("*").alias("samples"), F.sum("count").alias("total"))


#: Expression by study: the last of eight studies has test samples only.
STUDY_EXPR = ", e AS (SELECT *, sample // 50 AS study FROM expr WHERE NOT (sample // 50 = 7 AND grp = 'control')), l AS (SELECT sample, sum(count) AS library FROM e GROUP BY sample), v AS (SELECT study, gene, e.sample, grp, log2(count / library * 1e6 + 1) AS value FROM e JOIN l ON e.sample = l.sample)"


def _by_study(spark, d):
    rows = expression(spark, d).withColumn("study", F.floor(F.col("sample") / 50))
    return log_cpm(rows.where(~((F.col("study") == 7) & (F.col("grp") == "control"))))


@query("X10_per_study_tests", sql("expr", STUDY_EXPR + """, s AS (SELECT study, gene, avg(value) FILTER (WHERE grp = 'test') AS m1, avg(value) FILTER (WHERE grp = 'control') AS m2, var_samp(value) FILTER (WHERE grp = 'test') / count(*) FILTER (WHERE grp = 'test') AS a,
  var_samp(value) FILTER (WHERE grp = 'control') / count(*) FILTER (WHERE grp = 'control') AS b, count(*) FILTER (WHERE grp = 'test') AS n1, count(*) FILTER (WHERE grp = 'control') AS n2 FROM v GROUP BY ALL)
  SELECT study, gene, n1 AS n_test, n2 AS n_control, round(m1 - m2, 6) + 0.0 AS log2fc, CASE WHEN n1 > 1 AND n2 > 1 AND a + b > 0 THEN round((m1 - m2) / sqrt(a + b), 5) + 0.0 END AS t FROM s WHERE n1 >= 1 AND n2 >= 1"""))
def x10(spark, d):
    """One job for all studies; none is filtered by significance, and a study without controls gives no rows."""
    out = welch(group_summary(_by_study(spark, d), least=0, by=("study", "gene")).where("n_test >= 1 and n_control >= 1"))
    return out.select("study", "gene", "n_test", "n_control", (F.round("log2fc", 6) + 0.0).alias("log2fc"), (F.round("t", 5) + 0.0).alias("t"))


@query("X15_directional_validation", sql("assoc", ", g AS (SELECT experiment, label, gene, avg(log2fc) AS m FROM assoc GROUP BY ALL), s AS (SELECT experiment, label, count(*) FILTER (WHERE m > 0) AS up, count(*) FILTER (WHERE m < 0) AS down, count(*) AS genes FROM g GROUP BY ALL) SELECT *, CASE WHEN up >= 0.6 * (up + down) THEN CASE WHEN up + down > 0 THEN 'up' END WHEN down >= 0.6 * (up + down) THEN 'down' ELSE 'mixed' END AS direction FROM s"))
def x15(spark, d):
    rows = associations(spark, d).select("experiment", "label", "gene", "log2fc")
    return directions(rows, ["experiment", "label"])


@query("G06_global_summary", sql("assoc", " SELECT count(DISTINCT gene) AS genes, string_agg(DISTINCT symbol, ', ' ORDER BY symbol) AS symbols FROM (SELECT gene, symbol FROM assoc WHERE log2fc > 0.1 AND experiment = 'E-GEOD-5' AND label = 'PROMO' UNION SELECT gene, symbol FROM assoc WHERE log2fc < -0.1 AND experiment = 'E-GEOD-5' AND label = 'PROMO')"))
def g06(spark, d):
    rows = associations(spark, d).where((F.col("experiment") == "E-GEOD-5") & (F.col("label") == "PROMO"))
    both = rows.where("log2fc > 0.1").select("gene", "symbol").unionByName(rows.where("log2fc < -0.1").select("gene", "symbol"))
    # the symbols of one contrast and term
    return both.agg(F.countDistinct("gene").alias("genes"), F.array_join(F.sort_array(F.collect_set("symbol")), ", ").alias("symbols")).withColumn("symbols", F.nullif("symbols", F.lit("")))


@query("P16_language_tag", "SELECT doc_id, length(text) AS n FROM documents WHERE lang = 'en' AND text IS NOT NULL")
def p16(spark, d):
    """Literals with a language tag in N-Triples; those in English."""
    docs = read(spark, d, "documents").where("text is not null and lang is not null").select("doc_id", "lang", "text")
    # the line ends with the tag; the text stands before it as one quoted literal
    lines = docs.select("doc_id", F.concat(F.to_json(F.struct(F.col("text").alias("v"))), F.lit("@"), "lang", F.lit(" .")).alias("line"))
    tagged = lines.withColumn("tag", F.regexp_extract(F.substring_index("line", '"}', -1), "^@([A-Za-z]+(?:-[A-Za-z0-9]+)*) \\.$", 1)).where("tag = 'en'")
    return tagged.select("doc_id", F.length(F.get_json_object(F.expr("left(line, length(line) - length(tag) - 3)"), "$.v")).cast("long").alias("n"))


@query("P23_repository_restriction", sql("cat", " SELECT dataset FROM cat WHERE regexp_matches('https://data.example.org/view/' || o_orderkey, '/view/1[0-9]*$') OR (o_orderkey % 3 = 0 AND regexp_matches('https://doi.org/10.5555/' || o_orderkey, '5555/2')) OR regexp_matches(dataset, '_low/7[0-9]*$')"))
def p23(spark, d):
    t = triples(spark, d)
    rows = optional(optional(match(t, [IS_DATASET]), t, [has("?dataset", "url", "?url")]), t, [has("?dataset", "sameAs", "?same")])
    of = lambda c, pattern: F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return rows.where(of("url", "/view/1[0-9]*$") | of("same", "5555/2") | of("dataset", "_low/7[0-9]*$")).select("dataset").distinct()


@query("P24_control_exclusion", sql("assoc", " SELECT label, experiment, count(*) AS n FROM assoc WHERE NOT regexp_matches(lower(label), 'promo|small|healthy') GROUP BY ALL"))
def p24(spark, d):
    rows = associations(spark, d).where(~F.col("label").rlike("(?i)promo|small|healthy"))
    return rows.groupBy("label", "experiment").agg(F.count("*").alias("n"))


@query("P25_source_filter", "WITH s AS (SELECT n_nationkey, n_name, r_name AS type, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS datasets FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT n_name AS source, CASE WHEN n_name IN ('NATION_3', 'NATION_4') THEN 'explicitly excluded' WHEN type = (SELECT min(r_name) FROM region) THEN 'not a dataset repository' WHEN datasets = 0 THEN 'no datasets' END AS reason, datasets FROM s")
def p25(spark, d):
    counts = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("datasets"))
    sources = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(counts, "n_nationkey", "left").withColumn("datasets", F.coalesce("datasets", F.lit(0)))
    # one row on the right: the type that holds no datasets
    tools = read(spark, d, "region").agg(F.min("r_name").alias("tools"))
    reason = F.when(F.col("n_name").isin("NATION_3", "NATION_4"), "explicitly excluded").when(F.col("r_name") == F.col("tools"), "not a dataset repository").when(F.col("datasets") == 0, "no datasets")
    return sources.join(F.broadcast(tools), how="cross").select(F.col("n_name").alias("source"), reason.alias("reason"), "datasets")


@query("P28_iri_lookup", sql("cat", f" SELECT DISTINCT '{SCHEMA}healthCondition' AS p, condition AS o, condition_name AS label FROM cat WHERE o_orderkey = 7 UNION SELECT '{SCHEMA}species', taxon, taxon_name FROM cat WHERE o_orderkey = 7 UNION SELECT '{SCHEMA}name', name, NULL FROM cat WHERE o_orderkey = 7"))
def p28(spark, d):
    t = triples(spark, d)
    one = t.where(F.col("p").isin(SCHEMA + "healthCondition", SCHEMA + "species", SCHEMA + "name")).where(F.col("s").startswith(DATASET) & F.col("s").endswith("/7"))
    names = t.where(F.col("p") == SCHEMA + "name").groupBy(F.col("s").alias("o")).agg(F.min("o").alias("label"))
    return one.select("p", "o").join(names, "o", "left").select("p", "o", "label")


@query("J04_nested_optional", sql("cat", f" SELECT dataset, '{ROR_ORG}' || c_nationkey AS affiliation, 'University of ' || condition_name AS affiliation_name, CASE WHEN o_orderkey % 3 = 0 THEN 'https://doi.org/10.5555/' || o_orderkey END AS doi FROM cat"))
def j04(spark, d):
    """An inner optional part depends on what the outer one bound."""
    t = triples(spark, d, only=[RDF_TYPE, "author", "affiliation", "name", "sameAs"])
    rows = optional(match(t, [IS_DATASET]), t, [has("?dataset", "author", "?person")])
    rows = optional(rows, t, [has("?person", "affiliation", "?affiliation")])
    rows = optional(rows, t, [has("?affiliation", "name", "?affiliation_name")])
    return optional(rows, t, [has("?dataset", "sameAs", "?doi")]).select("dataset", "affiliation", "affiliation_name", "doi")
