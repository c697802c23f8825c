"""A query for each building block: forms of patterns, filters, joins, aggregations and rankings by themselves."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindle.functions.lineage import stored
from spindle.operators.cohort import classified, search, series, study_pairs
from spindle.operators.graph import match, optional
from spindle.operators.statistics import benjamini_hochberg
from spindle.plans.catalogue import IS_DATASET, NAME, has
from spindle.plans.cohorts import BY_SERIES
from spindle.plans.registry import query
from spindle.sources.views import AGENT, DATASET, MONDO, RDF_TYPE, ROR, SCHEMA, TAXON, associations, cells, read, samples, sql, triples


def facts(spark, d, *predicates: str):
    return triples(spark, d, only=[RDF_TYPE, *predicates])


@query("P01_distinct_projection", sql("cat", " SELECT DISTINCT condition_name AS disease, taxon_name AS species FROM cat"))
def p01(spark, d):
    rows = match(facts(spark, d, "healthCondition", "species", "name"), [has("?dataset", "healthCondition", "?c"), has("?c", "name", "?disease"), has("?dataset", "species", "?t"), has("?t", "name", "?species")])
    return rows.select("disease", "species").distinct()


@query("P02_triple_pattern", sql("cat", f" SELECT DISTINCT dataset FROM cat WHERE condition = '{MONDO}0000003'"))
def p02(spark, d):
    return match(facts(spark, d, "healthCondition"), [has("?dataset", "healthCondition", MONDO + "0000003")])


@query("P03_predicate_alternation", sql("cat", " SELECT DISTINCT dataset, modified AS day FROM cat WHERE modified IS NOT NULL UNION SELECT DISTINCT dataset, published FROM cat WHERE published IS NOT NULL"))
def p03(spark, d):
    return match(facts(spark, d, "dateModified", "datePublished"), [("?dataset", (SCHEMA + "dateModified", SCHEMA + "datePublished"), "?day")]).distinct()


@query("P05_bound_expressions", sql("cat", " SELECT DISTINCT dataset, modified[1:4]::INTEGER AS year, upper(name) || ' (' || modified || ')' AS title FROM cat WHERE modified IS NOT NULL"))
def p05(spark, d):
    rows = match(facts(spark, d, "name", "dateModified"), [NAME, has("?dataset", "dateModified", "?day")])
    return rows.select("dataset", F.left("day", F.lit(4)).cast("int").alias("year"), F.concat(F.upper("name"), F.lit(" ("), "day", F.lit(")")).alias("title"))


@query("P06_equality_lists", sql("cat", f" SELECT DISTINCT dataset, condition FROM cat WHERE condition = '{MONDO}0000001' OR condition = '{MONDO}0000009' OR condition = '{MONDO}0000012'"))
def p06(spark, d):
    rows = match(facts(spark, d, "healthCondition"), [has("?dataset", "healthCondition", "?condition")])
    return rows.where((F.col("condition") == MONDO + "0000001") | (F.col("condition") == MONDO + "0000009") | (F.col("condition") == MONDO + "0000012"))


@query("P07_contains", sql("cat", " SELECT DISTINCT dataset, condition_name AS disease FROM cat WHERE contains(lower(condition_name), 'ion_1')"))
def p07(spark, d):
    return match(facts(spark, d, "healthCondition", "name"), [has("?dataset", "healthCondition", "?c"), has("?c", "name", "?disease")]).where(F.lower("disease").contains("ion_1")).select("dataset", "disease")


@query("P08_equality_in_any_case", sql("cat", " SELECT DISTINCT taxon AS node, taxon_name AS name FROM cat WHERE lower(taxon_name) = lower('EUROPE')"))
def p08(spark, d):
    return match(facts(spark, d, "name"), [has("?node", "name", "?name")]).where(F.lower("name") == "europe").distinct()


@query("P09_prefix_test", sql("cat", f" SELECT DISTINCT dataset AS s FROM cat WHERE starts_with(dataset, '{DATASET}2_high/')"))
def p09(spark, d):
    return match(facts(spark, d), [("?s", RDF_TYPE, "?kind")]).where(F.col("s").startswith(DATASET + "2_high/")).select("s").distinct()


@query("P10_escaped_alternation", "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'red w') OR contains(lower(p_name), '(x)')")
def p10(spark, d):
    pattern = "(?i)" + "|".join(map(re.escape, ("RING", "Red w", "(x)")))
    return read(spark, d, "part").where(F.col("p_name").rlike(pattern)).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("P11_bound_or_not", sql("cat", " SELECT modified IS NOT NULL AS has_modified, o_orderkey % 3 = 0 AS has_doi, count(*) AS n FROM cat GROUP BY ALL"))
def p11(spark, d):
    t = facts(spark, d, "dateModified", "sameAs")
    rows = optional(optional(match(t, [IS_DATASET]), t, [has("?dataset", "dateModified", "?day")]), t, [has("?dataset", "sameAs", "?doi")])
    return rows.groupBy(F.col("day").isNotNull().alias("has_modified"), F.col("doi").isNotNull().alias("has_doi")).agg(F.count("*").alias("n"))


@query("P12_membership", sql("assoc", " SELECT experiment, count(*) AS n FROM assoc WHERE experiment IN ('E-GEOD-1', 'E-GEOD-5', 'E-GEOD-77') AND symbol NOT IN ('GENE1', 'GENE2') GROUP BY experiment"))
def p12(spark, d):
    rows = associations(spark, d).where(F.col("experiment").isin("E-GEOD-1", "E-GEOD-5", "E-GEOD-77") & ~F.col("symbol").isin("GENE1", "GENE2"))
    return rows.groupBy("experiment").agg(F.count("*").alias("n"))


@query("P13_numeric_thresholds", sql("assoc", " SELECT contrast, gene, log2fc, adj_p FROM assoc WHERE adj_p <= 0.01 AND abs(log2fc) >= 0.08 AND (log2fc > 0.1 OR log2fc < -0.09)"))
def p13(spark, d):
    rows = associations(spark, d).where((F.col("adj_p") <= 0.01) & (F.abs("log2fc") >= 0.08) & ((F.col("log2fc") > 0.1) | (F.col("log2fc") < -0.09)))
    return rows.select("contrast", "gene", "log2fc", "adj_p")


@query("P14_different_pairs", sql("assoc", " SELECT a.gene, a.experiment AS one, b.experiment AS two FROM (SELECT DISTINCT gene, experiment FROM assoc) a JOIN (SELECT DISTINCT gene, experiment FROM assoc) b ON a.gene = b.gene AND a.experiment < b.experiment"))
def p14(spark, d):
    """Pairs of experiments of one gene: there are as many as nations at most."""
    own = associations(spark, d).select("gene", "experiment").distinct()
    return own.withColumnRenamed("experiment", "one").join(own.withColumnRenamed("experiment", "two"), "gene").where("one < two").select("gene", "one", "two")


@query("P15_kinds_of_objects", sql("cat", f" SELECT '{SCHEMA}healthCondition' AS p, true AS iri, count(DISTINCT dataset) AS n FROM cat UNION ALL SELECT '{SCHEMA}dateModified', false, count(DISTINCT dataset) FROM cat WHERE modified IS NOT NULL"))
def p15(spark, d):
    rows = facts(spark, d, "healthCondition", "dateModified").where(F.col("p") != RDF_TYPE)
    return rows.groupBy("p", "iri").agg(F.count("*").alias("n"))


@query("P19_mode_switch", sql("samples", " SELECT 'of the' AS term, sample FROM samples WHERE contains(' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ', ' of the ') UNION ALL SELECT 'of.the', sample FROM samples WHERE regexp_matches(lower(title), 'of.the')"))
def p19(spark, d):
    """A term with a special character is a regular expression, any other a phrase."""
    s = samples(spark, d)
    found = [search(s, term, ["title"], ["title"]).select(F.lit(term).alias("term"), "sample") for term in ("of the", "of.the")]
    return found[0].unionByName(found[1])


@query("P22_keywords", sql("samples", " SELECT sample, contains(lower(title), 'the') AND contains(lower(title), 'that') AS every FROM samples WHERE contains(lower(title), 'the') OR contains(lower(title), 'that')"))
def p22(spark, d):
    one = [F.lower("title").contains(k) for k in ("the", "that")]
    return samples(spark, d).where(one[0] | one[1]).select("sample", (one[0] & one[1]).alias("every"))


@query("J01_star_and_chain", sql("cat", f" SELECT DISTINCT a.dataset, a.name, a.grant_name, b.funder FROM cat a JOIN (SELECT DISTINCT grant_iri, funder FROM cat) b ON a.grant_iri = b.grant_iri WHERE a.agent = '{AGENT}7'"))
def j01(spark, d):
    t = stored(facts(spark, d, "name", "funding", "funder", "infectiousAgent"), "facts")
    rows = match(t, [NAME, has("?dataset", "infectiousAgent", AGENT + "7"), has("?dataset", "funding", "?g"), has("?g", "name", "?grant_name"), has("?g", "funder", "?funder")])
    return rows.select("dataset", "name", "grant_name", "funder").distinct()


@query("J02_optional", sql("cat", " SELECT dataset, name, modified FROM cat"))
def j02(spark, d):
    t = facts(spark, d, "name", "dateModified")
    return optional(match(t, [NAME]).where(F.col("dataset").startswith(DATASET)), t, [has("?dataset", "dateModified", "?modified")])


@query("J03_optional_with_filter", sql("cat", " SELECT dataset, CASE WHEN modified < '1995' THEN modified END AS old FROM cat"))
def j03(spark, d):
    """The filter belongs to the match: datasets that were modified later stay, without a day."""
    t = facts(spark, d, "dateModified")
    return optional(match(t, [IS_DATASET]), t, [has("?dataset", "dateModified", "?old")], "old < '1995'")


@query("J06_opposite_signs", sql("assoc", " SELECT gene, max(log2fc) FILTER (WHERE log2fc > 0) AS most, min(log2fc) FILTER (WHERE log2fc < 0) AS least, count(*) FILTER (WHERE log2fc > 0) * count(*) FILTER (WHERE log2fc < 0) AS pairs FROM assoc GROUP BY gene HAVING most IS NOT NULL AND least IS NOT NULL"))
def j06(spark, d):
    """Each gene's pairs of associations with opposite signs, counted without making them, and the widest of them."""
    up, down = F.col("log2fc") > 0, F.col("log2fc") < 0
    out = associations(spark, d).groupBy("gene").agg(F.max(F.when(up, F.col("log2fc"))).alias("most"), F.min(F.when(down, F.col("log2fc"))).alias("least"), (F.count_if(up) * F.count_if(down)).alias("pairs"))
    return out.where("most is not null and least is not null")


@query("G01_count_distinct", sql("assoc", " SELECT count(DISTINCT contrast) AS contrasts, count(DISTINCT gene) AS genes, count(DISTINCT label) AS labels FROM assoc"))
def g01(spark, d):
    return associations(spark, d).agg(*(F.count_distinct(c).alias(f"{c}s") for c in ("contrast", "gene", "label")))


@query("G02_counts_per_group", sql("cat", " SELECT agent, agent_name, count(*) AS n FROM cat GROUP BY ALL ORDER BY n DESC, agent LIMIT 10"))
def g02(spark, d):
    rows = match(facts(spark, d, "infectiousAgent", "name"), [has("?dataset", "infectiousAgent", "?agent"), has("?agent", "name", "?agent_name")])
    return rows.groupBy("agent", "agent_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "agent").limit(10)


@query("G03_experiment_coverage", sql("assoc", " SELECT experiment, count(DISTINCT contrast) AS contrasts, count(DISTINCT gene) AS genes, count(*) AS n FROM assoc WHERE symbol IN ('GENE1', 'GENE17', 'GENE99', 'GENE150') GROUP BY experiment"))
def g03(spark, d):
    rows = associations(spark, d).where(F.col("symbol").isin("GENE1", "GENE17", "GENE99", "GENE150"))
    return rows.groupBy("experiment").agg(F.count_distinct("contrast").alias("contrasts"), F.count_distinct("gene").alias("genes"), F.count("*").alias("n"))


@query("G04_consistent_direction", sql("assoc", " SELECT gene, symbol, CASE WHEN min(log2fc) > 0 THEN 'up' ELSE 'down' END AS direction, count(DISTINCT experiment) AS experiments FROM assoc WHERE abs(log2fc) > 0.03 GROUP BY gene, symbol HAVING (min(log2fc) > 0 OR max(log2fc) < 0) AND count(DISTINCT experiment) >= 2"))
def g04(spark, d):
    out = associations(spark, d).where(F.abs("log2fc") > 0.03).groupBy("gene", "symbol").agg(F.min("log2fc").alias("low"), F.max("log2fc").alias("high"), F.count_distinct("experiment").alias("experiments"))
    return out.where("(low > 0 or high < 0) and experiments >= 2").select("gene", "symbol", F.when(F.col("low") > 0, "up").otherwise("down").alias("direction"), "experiments")


@query("G05_joined_attributes", sql("assoc", " SELECT contrast, string_agg(DISTINCT label, '; ' ORDER BY label) AS labels, string_agg(DISTINCT array_design, '; ' ORDER BY array_design) AS designs, string_agg(DISTINCT taxon::VARCHAR, '; ' ORDER BY taxon::VARCHAR) AS taxa, max(abs(log2fc)) AS strongest FROM assoc GROUP BY contrast"))
def g05(spark, d):
    """Values of a contrast joined in order; a contrast has as many rows as a supplier's lines of one number."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), "; ")
    return associations(spark, d).groupBy("contrast").agg(joined("label").alias("labels"), joined("array_design").alias("designs"), joined("taxon").alias("taxa"), F.max(F.abs("log2fc")).alias("strongest"))


@query("G28_concordance", sql("assoc", ", q AS (SELECT DISTINCT gene FROM assoc WHERE taxon = 1 AND log2fc > 0.05) SELECT experiment, count(DISTINCT gene) AS detected, (SELECT count(*) FROM q) AS asked, round(count(DISTINCT gene) / (SELECT count(*) FROM q), 8) AS concordance FROM assoc WHERE log2fc > 0.05 AND gene IN (SELECT gene FROM q) GROUP BY experiment"))
def g28(spark, d):
    rows = associations(spark, d).where("log2fc > 0.05")
    asked = rows.where("taxon = 1").select("gene").distinct()
    n = asked.agg(F.count("*").alias("asked"))
    found = rows.join(asked, "gene", "left_semi").groupBy("experiment").agg(F.count_distinct("gene").alias("detected"))
    # one row on the right
    return found.join(F.broadcast(n), how="cross").select("experiment", "detected", "asked", F.round(F.col("detected") / F.col("asked"), 8).alias("concordance"))


@query("W11_sorted_and_limited", sql("assoc", " SELECT experiment, gene, adj_p, log2fc, contrast FROM assoc ORDER BY adj_p, log2fc DESC, experiment, gene, contrast LIMIT least(500, 60)"))
def w11(spark, d):
    order = ["adj_p", F.desc("log2fc"), "experiment", "gene", "contrast"]
    return associations(spark, d).select("experiment", "gene", "adj_p", "log2fc", "contrast").orderBy(*order).limit(min(500, 60))


@query("W12_mid_ranks", sql("cells", " SELECT cell, dataset, rank() OVER (PARTITION BY dataset ORDER BY value) + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2.0::DOUBLE AS rank FROM cells"))
def w12(spark, d):
    """Average ranks of tied values in each dataset, from the counts of different values."""
    c = cells(spark, d)
    counted = c.groupBy("dataset", "value").agg(F.count("*").alias("t"))
    up = F.sum("t").over(Window.partitionBy("dataset").orderBy("value"))
    ranks = counted.withColumn("rank", (up - (F.col("t") - 1) / 2).cast("double")).select("dataset", "value", "rank")
    return c.select("cell", "dataset", "value").join(ranks, ["dataset", "value"]).select("cell", "dataset", "rank")


@query("W13_step_up", sql("assoc", ", p AS (SELECT gene, min(adj_p) + 0.001::DOUBLE * (gene % 37) AS p FROM assoc GROUP BY gene), r AS (SELECT *, count(*) OVER () AS n, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS k FROM p) SELECT gene, round(least(1, min(p * n / k) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 10) AS padj FROM r"))
def w13(spark, d):
    p = associations(spark, d).groupBy("gene").agg((F.min("adj_p") + F.lit(0.001) * (F.col("gene") % 37)).alias("p"))
    return benjamini_hochberg(p, "p", []).select("gene", F.round("padj", 10).alias("padj"))


@query("W15_study_pairs", sql("samples", BY_SERIES + ", c AS (SELECT *, CASE WHEN regexp_matches(lower(title), 'idiot|stupid') THEN 'test' WHEN regexp_matches(lower(title), 'that') THEN 'control' END AS cohort FROM bys) SELECT series, count(*) FILTER (WHERE cohort = 'test') AS n_test, count(*) FILTER (WHERE cohort = 'control') AS n_control, row_number() OVER (ORDER BY count(*) DESC, series)::INTEGER AS place FROM c WHERE cohort IS NOT NULL GROUP BY series ORDER BY place LIMIT 20"))
def w15(spark, d):
    """The twenty studies with the most samples on both sides together."""
    pairs = study_pairs(classified(series(samples(spark, d)), F.col("title"), "idiot|stupid", "that"))
    first = pairs.orderBy(F.desc(F.col("n_test") + F.col("n_control")), "series").limit(20)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.col("n_test") + F.col("n_control")), "series")))  # of twenty rows


@query("U04_intersection", sql("assoc", " SELECT gene FROM assoc WHERE taxon = 1 AND log2fc > 0.05 INTERSECT SELECT gene FROM assoc WHERE taxon = 2 AND log2fc > 0.05 INTERSECT SELECT gene FROM assoc WHERE taxon = 3 AND log2fc > 0.05"))
def u04(spark, d):
    rows = associations(spark, d).where("log2fc > 0.05")
    of = lambda t: rows.where(F.col("taxon") == t).select("gene")
    return of(1).intersect(of(2)).intersect(of(3))


@query("S17_pattern_over_a_graph", sql("cat", f" SELECT DISTINCT dataset, '{ROR}machinery' AS funder FROM cat WHERE taxon = '{TAXON}3' AND grant_iri IN (SELECT grant_iri FROM cat WHERE funder = '{ROR}machinery')"))
def s17(spark, d):
    """A basic graph pattern with two fixed ends over the local triples."""
    t = stored(facts(spark, d, "species", "funding", "funder"), "facts")
    return match(t, [IS_DATASET, has("?dataset", "species", TAXON + "3"), has("?dataset", "funding", "?g"), has("?g", "funder", "?funder")]).where(F.col("funder") == ROR + "machinery").select("dataset", "funder").distinct()


@query("S22_inline_values", sql("cat", f" SELECT DISTINCT dataset, condition, rank FROM cat JOIN (VALUES ('{MONDO}0000004', 1), ('{MONDO}0000011', 2), ('{MONDO}9999999', 3)) v(c, rank) ON condition = c"))
def s22(spark, d):
    values = spark.createDataFrame([(MONDO + "0000004", 1), (MONDO + "0000011", 2), (MONDO + "9999999", 3)], "condition string, rank int")
    rows = match(facts(spark, d, "healthCondition"), [has("?dataset", "healthCondition", "?condition")])
    return rows.join(F.broadcast(values), "condition").select("dataset", "condition", "rank")  # three rows
