"""Queries over the catalogue graph: competency questions, lookups, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions.lineage import stored
from spindle.operators.graph import closure, match, neighbourhood, optional
from spindle.plans.registry import query
from spindle.sources.views import DATASET, DOI, GRANT, MONDO, RDF_TYPE, ROR, SCHEMA, TAXON, hierarchy, read, sql, triples

IS_DATASET = ("?dataset", RDF_TYPE, SCHEMA + "Dataset")
NAME = ("?dataset", SCHEMA + "name", "?name")


def _resource():
    return F.regexp_replace("dataset", "^" + DATASET.replace(".", r"\.") + "([^/]+)/.*$", "$1").alias("resource")


def has(s: str, p: str, o: str):
    return (s, SCHEMA + p, o)


@query("Q01_dataset_count", sql("cat", f" SELECT count(DISTINCT dataset) AS n FROM cat WHERE dataset LIKE '{DATASET}1_urgent/%'"))
def q01(spark, d):
    return match(triples(spark, d), [IS_DATASET]).where(F.col("dataset").startswith(DATASET + "1_urgent/")).agg(F.countDistinct("dataset").alias("n"))


@query("Q02_datasets_for_disease", sql("cat", f" SELECT DISTINCT dataset, name, condition_name AS disease FROM cat WHERE condition = '{MONDO}0000007' OR contains(lower(condition_name), 'nation_1')"))
def q02(spark, d):
    t = triples(spark, d)
    rows = match(t, [IS_DATASET, NAME, has("?dataset", "healthCondition", "?condition"), has("?condition", "name", "?disease")])
    return rows.where((F.col("condition") == MONDO + "0000007") | F.lower("disease").contains("nation_1")).select("dataset", "name", "disease").distinct()


@query("Q03_datasets_for_species", sql("cat", f" SELECT DISTINCT dataset, name, taxon_name AS species FROM cat WHERE taxon = '{TAXON}2' OR regexp_matches(lower(taxon_name), 'europe|afr')"))
def q03(spark, d):
    rows = match(triples(spark, d), [IS_DATASET, NAME, has("?dataset", "species", "?taxon"), has("?taxon", "name", "?species")])
    return rows.where((F.col("taxon") == TAXON + "2") | F.lower("species").rlike("europe|afr")).select("dataset", "name", "species").distinct()


@query("Q04_datasets_by_condition_iri", sql("cat", f" SELECT DISTINCT dataset, name, resource FROM cat WHERE condition = '{MONDO}0000003'"))
def q04(spark, d):
    return match(triples(spark, d), [IS_DATASET, NAME, has("?dataset", "healthCondition", MONDO + "0000003")]).select("dataset", "name", _resource()).distinct()


@query("Q05_dataset_dois", sql("cat", f" SELECT DISTINCT dataset, name, '{DOI}10.5555/' || o_orderkey AS doi FROM cat WHERE o_orderkey % 3 = 0 ORDER BY name, dataset LIMIT 50"))
def q05(spark, d):
    rows = match(triples(spark, d), [IS_DATASET, NAME, has("?dataset", "sameAs", "?doi")]).where(F.col("doi").rlike("^https://doi\\.org/"))
    return rows.select("dataset", "name", "doi").distinct().orderBy("name", "dataset").limit(50)


@query("Q06_datasets_by_funder", sql("cat", f" SELECT DISTINCT dataset, name, grant_name FROM cat WHERE grant_iri IN (SELECT grant_iri FROM cat WHERE funder = '{ROR}building')"))
def q06(spark, d):
    t = triples(spark, d)
    grants = match(t, [has("?grant", "funder", ROR + "building"), has("?grant", "name", "?grant_name")])
    return match(t, [IS_DATASET, NAME, has("?dataset", "funding", "?grant")]).join(grants, "grant").select("dataset", "name", "grant_name").distinct()


@query("Q07_unique_funders", sql("cat", " SELECT count(DISTINCT funder) AS n FROM cat"))
def q07(spark, d):
    return match(triples(spark, d), [IS_DATASET, has("?dataset", "funding", "?grant"), has("?grant", "funder", "?funder")]).agg(F.countDistinct("funder").alias("n"))


@query("Q08_datasets_by_affiliation", sql("cat", " SELECT DISTINCT dataset, name, c_name AS author, 'University of ' || condition_name AS affiliation FROM cat WHERE c_nationkey = 4 OR contains(lower(condition_name), 'nation_24')"))
def q08(spark, d):
    t = triples(spark, d)
    people = match(t, [has("?person", "name", "?author"), has("?person", "affiliation", "?org"), has("?org", "name", "?affiliation")])
    people = people.where((F.col("org") == ROR + "org4") | F.lower("affiliation").contains("nation_24"))
    return match(t, [IS_DATASET, NAME, has("?dataset", "author", "?person")]).join(people, "person").select("dataset", "name", "author", "affiliation").distinct()


@query("Q09_infectious_agents", sql("cat", " SELECT agent, agent_name, count(dataset) AS n FROM cat GROUP BY ALL ORDER BY n DESC, agent LIMIT 20"))
def q09(spark, d):
    rows = match(triples(spark, d, only=[RDF_TYPE, "infectiousAgent", "name"]), [IS_DATASET, has("?dataset", "infectiousAgent", "?agent"), has("?agent", "name", "?agent_name")])
    return rows.groupBy("agent", "agent_name").agg(F.count("dataset").alias("n")).orderBy(F.desc("n"), "agent").limit(20)


@query("Q10_disease_and_species", sql("cat", f" SELECT DISTINCT dataset, name FROM cat WHERE (condition = '{MONDO}0000006' OR contains(lower(condition_name), 'nation_6')) AND (taxon = '{TAXON}9' OR regexp_matches(lower(taxon_name), 'america'))"))
def q10(spark, d):
    rows = match(triples(spark, d), [
        IS_DATASET, NAME, has("?dataset", "healthCondition", "?condition"), has("?condition", "name", "?disease"),
        has("?dataset", "species", "?taxon"), has("?taxon", "name", "?species"),
    ])
    disease = (F.col("condition") == MONDO + "0000006") | F.lower("disease").contains("nation_6")
    species = (F.col("taxon") == TAXON + "9") | F.lower("species").rlike("america")
    return rows.where(disease & species).select("dataset", "name").distinct()


@query("Q11_datasets_per_resource", sql("cat", " SELECT resource, count(DISTINCT dataset) AS n FROM cat GROUP BY resource"))
def q11(spark, d):
    return match(triples(spark, d), [IS_DATASET]).select("dataset", _resource()).groupBy("resource").agg(F.countDistinct("dataset").alias("n"))


@query("Q12_free_datasets", sql("cat", " SELECT DISTINCT dataset, name, resource, 'https://data.example.org/view/' || o_orderkey AS url FROM cat WHERE o_orderstatus = 'O' ORDER BY resource, name, dataset LIMIT 50"))
def q12(spark, d):
    rows = match(triples(spark, d), [IS_DATASET, NAME, has("?dataset", "url", "?url"), has("?dataset", "isAccessibleForFree", "true")])
    return rows.select("dataset", "name", _resource(), "url").distinct().orderBy("resource", "name", "dataset").limit(50)


@query("Q13_datasets_of_a_year", sql("cat", " SELECT DISTINCT dataset, name, modified, published FROM cat WHERE modified LIKE '1997%' OR published LIKE '1997%' ORDER BY modified DESC NULLS LAST, published DESC NULLS LAST, dataset LIMIT 50"))
def q13(spark, d):
    t = triples(spark, d, only=[RDF_TYPE, "name", "dateModified", "datePublished"])
    rows = optional(match(t, [IS_DATASET, NAME]), t, [has("?dataset", "dateModified", "?modified")])
    rows = optional(rows, t, [has("?dataset", "datePublished", "?published")]).where("modified like '1997%' or published like '1997%'")
    order = [F.desc_nulls_last("modified"), F.desc_nulls_last("published"), "dataset"]
    return rows.select("dataset", "name", "modified", "published").distinct().orderBy(*order).limit(50)


@query("Q14_funder_condition_species", sql("cat", f" SELECT DISTINCT dataset, name, grant_name FROM cat WHERE condition = '{MONDO}0000008' AND grant_iri IN (SELECT grant_iri FROM cat WHERE funder = '{ROR}machinery') AND regexp_matches(lower(taxon_name), 'europe')"))
def q14(spark, d):
    # eight patterns read the facts, so they are made once
    facts = stored(triples(spark, d, only=[RDF_TYPE, "name", "healthCondition", "species", "funding", "funder"]), "facts")
    rows = match(facts, [
        IS_DATASET, NAME, has("?dataset", "healthCondition", MONDO + "0000008"), has("?dataset", "species", "?taxon"), has("?taxon", "name", "?species"),
        has("?dataset", "funding", "?grant"), has("?grant", "funder", ROR + "machinery"), has("?grant", "name", "?grant_name"),
    ])
    return rows.where(F.lower("species").rlike("europe")).select("dataset", "name", "grant_name").distinct()


@query("Q15_techniques_of_disease", sql("cat", " SELECT 'Technique ' || (o_orderkey % 7) AS technique, count(DISTINCT dataset) AS n FROM cat WHERE contains(lower(condition_name), 'nation_2') GROUP BY 1"))
def q15(spark, d):
    rows = match(triples(spark, d), [
        IS_DATASET, has("?dataset", "healthCondition", "?condition"), has("?condition", "name", "?disease"),
        has("?dataset", "measurementTechnique", "?tech"), has("?tech", "name", "?technique"),
    ])
    return rows.where(F.lower("disease").contains("nation_2")).groupBy("technique").agg(F.countDistinct("dataset").alias("n"))


@query("C01_dataset_search", sql("cat", """, hit AS (SELECT dataset, name, condition_name, taxon_name FROM cat WHERE regexp_matches(lower(condition_name), 'nation_(1|3)$') AND taxon_name = 'America')
  SELECT dataset, min(name) AS name, string_agg(DISTINCT condition_name, ' | ' ORDER BY condition_name) AS conditions, string_agg(DISTINCT taxon_name, ' | ' ORDER BY taxon_name) AS species FROM hit GROUP BY dataset ORDER BY dataset LIMIT 100"""))
def c01(spark, d):
    rows = match(triples(spark, d), [
        IS_DATASET, NAME, has("?dataset", "healthCondition", "?condition"), has("?condition", "name", "?disease"),
        has("?dataset", "species", "?taxon"), has("?taxon", "name", "?species_name"),
    ]).where(F.col("disease").rlike("(?i)nation_(1|3)$") & (F.lower("species_name") == "america"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), " | ")
    return rows.groupBy("dataset").agg(F.min("name").alias("name"), joined("disease").alias("conditions"), joined("species_name").alias("species")).orderBy("dataset").limit(100)


@query("C02_doi_dataset_search", sql("cat", f" SELECT DISTINCT dataset, name, '{DOI}10.5555/' || o_orderkey AS doi FROM cat WHERE o_orderkey % 3 = 0 AND regexp_matches(o_orderkey::VARCHAR, '^1[0-9]*5$')"))
def c02(spark, d):
    rows = match(triples(spark, d), [IS_DATASET, NAME, has("?dataset", "sameAs", "?doi")])
    return rows.where(F.col("doi").rlike("/1[0-9]*5$")).select("dataset", "name", "doi").distinct()


@query("C03_entity_lookup", sql("cat", f" SELECT DISTINCT agent AS entity, agent_name AS name FROM cat WHERE regexp_matches(lower(agent_name), 'agent 1')  UNION SELECT grant_iri, grant_name FROM cat WHERE grant_iri LIKE '{GRANT}49%'"))
def c03(spark, d):
    t = triples(spark, d)
    named = match(t, [has("?entity", "name", "?name")])
    label = named.where(F.lower("name").rlike("^agent 1"))
    iri = named.where(F.col("entity").startswith(GRANT + "49"))
    return label.unionByName(iri).select("entity", "name").distinct()


@query("C12_label_grounding", sql("cat", """ SELECT DISTINCT condition AS iri, condition_name AS label, 'exact' AS how FROM cat WHERE lower(condition_name) = 'nation_1'
  UNION SELECT DISTINCT condition, condition_name, 'prefix' FROM cat WHERE starts_with(lower(condition_name), 'nation_1') AND lower(condition_name) <> 'nation_1'
  UNION SELECT DISTINCT condition, condition_name, 'part' FROM cat WHERE contains(lower(condition_name), 'n_2') AND NOT starts_with(lower(condition_name), 'nation_1')"""))
def c12(spark, d):
    named = match(triples(spark, d), [has("?iri", "name", "?label")]).where(F.col("iri").startswith(MONDO)).distinct()
    low = F.lower("label")
    how = F.when(low == "nation_1", "exact").when(low.startswith("nation_1"), "prefix").when(low.contains("n_2"), "part")
    return named.withColumn("how", how).where("how is not null").select("iri", "label", "how")


@query("C14_encoding_probe", sql("cat", " SELECT count(*) AS n, count(*) FILTER (WHERE condition LIKE 'http%') AS iris, CASE WHEN count(*) FILTER (WHERE condition LIKE 'http%') * 2 >= count(*) THEN 'iri' ELSE 'curie' END AS encoding FROM (SELECT DISTINCT condition FROM cat ORDER BY condition LIMIT 10)"))
def c14(spark, d):
    rows = match(triples(spark, d), [has("?dataset", "healthCondition", "?condition")]).select("condition").distinct().orderBy("condition").limit(10)
    iris = F.count_if(F.col("condition").startswith("http"))
    return rows.agg(F.count("*").alias("n"), iris.alias("iris"), F.when(iris * 2 >= F.count("*"), "iri").otherwise("curie").alias("encoding"))


@query("C19_keyword_search", sql("cat", " SELECT DISTINCT dataset, name FROM cat WHERE regexp_matches(lower(name), '77') AND (regexp_matches(lower(name), 'o$') OR regexp_matches(coalesce(modified, ''), '^1995'))"))
def c19(spark, d):
    t = triples(spark, d)
    rows = optional(match(t, [IS_DATASET, NAME]), t, [has("?dataset", "dateModified", "?modified")])
    low = F.lower("name")
    return rows.where(low.rlike("77") & (low.rlike("o$") | F.coalesce("modified", F.lit("")).rlike("^1995"))).select("dataset", "name").distinct()


@query("C21_disease_or_organism", sql("cat", """, hit AS (SELECT dataset, name, CASE WHEN condition_name = 'Nation_17' THEN condition_name END AS disease, CASE WHEN taxon_name = 'Asia' THEN taxon_name END AS organism FROM cat)
  SELECT dataset, min(name) AS name, string_agg(DISTINCT disease, ' | ') AS diseases, string_agg(DISTINCT organism, ' | ') AS organisms FROM hit WHERE disease IS NOT NULL OR organism IS NOT NULL GROUP BY dataset"""))
def c21(spark, d):
    t = triples(spark, d)
    rows = optional(match(t, [IS_DATASET, NAME]), t, [has("?dataset", "healthCondition", "?c"), has("?c", "name", "?disease")], "disease = 'Nation_17'")
    rows = optional(rows, t, [has("?dataset", "species", "?x"), has("?x", "name", "?organism")], "organism = 'Asia'").where("disease is not null or organism is not null")
    joined = lambda c: F.nullif(F.array_join(F.sort_array(F.collect_set(c)), " | "), F.lit(""))
    return rows.groupBy("dataset").agg(F.min("name").alias("name"), joined("disease").alias("diseases"), joined("organism").alias("organisms"))


@query("C22_condition_summary", sql("cat", " SELECT count(DISTINCT agent) AS n_agents, string_agg(DISTINCT agent_name, ', ' ORDER BY agent_name) AS agents FROM cat WHERE condition_name = 'Nation_14'"))
def c22(spark, d):
    t = triples(spark, d)
    rows = match(t, [has("?dataset", "healthCondition", "?condition"), has("?condition", "name", "Nation_14"), has("?dataset", "infectiousAgent", "?agent"), has("?agent", "name", "?agent_name")])
    return rows.agg(F.countDistinct("agent").alias("n_agents"), F.array_join(F.sort_array(F.collect_set("agent_name")), ", ").alias("agents"))


@query("C15_datasets_by_iri_or_curie", sql("cat", f" SELECT DISTINCT dataset, condition, 'MONDO:' || replace(condition, '{MONDO}', '') AS curie FROM cat WHERE condition IN ('{MONDO}0000001', '{MONDO}0000012')"))
def c15(spark, d):
    rows = match(triples(spark, d), [IS_DATASET, has("?dataset", "healthCondition", "?condition")])
    wanted = spark.createDataFrame([("MONDO:0000001",), ("MONDO:0000012",)], "curie string")
    wanted = wanted.withColumn("condition", F.regexp_replace("curie", "^MONDO:", MONDO))
    return rows.join(wanted, "condition").select("dataset", "condition", "curie").distinct()


@query("J20_multi_hop_plan", sql("cat", """, c AS (SELECT DISTINCT agent FROM cat WHERE condition_name = 'Nation_12' AND modified LIKE '1998-01%')
  SELECT DISTINCT dataset, agent FROM cat WHERE agent IN (SELECT agent FROM c) AND taxon_name = 'Africa'"""))
def j20(spark, d):
    t = triples(spark, d)
    first = match(t, [has("?x", "healthCondition", "?condition"), has("?condition", "name", "Nation_12"), has("?x", "dateModified", "?day"), has("?x", "infectiousAgent", "?agent")])
    agents = first.where(F.col("day").startswith("1998-01")).select("agent").distinct()
    second = match(t, [has("?dataset", "infectiousAgent", "?agent"), has("?dataset", "species", "?taxon"), has("?taxon", "name", "Africa")])
    return second.join(agents, "agent", "left_semi").select("dataset", "agent").distinct()


@query("J19_preferred_then_fallback_xref", sql("cat", f""", x AS (SELECT DISTINCT condition, c_nationkey AS k FROM cat)
  SELECT condition, CASE WHEN k % 3 = 0 THEN 'DOID:' || k ELSE 'EFO:' || k END AS xref, CASE WHEN k % 3 = 0 THEN 'preferred' ELSE 'fallback' END AS origin FROM x WHERE k % 3 = 0 OR k % 2 = 0"""))
def j19(spark, d):
    conditions = match(triples(spark, d), [has("?dataset", "healthCondition", "?condition")]).select("condition").distinct()
    # two tables of cross-references
    n = read(spark, d, "nation").select(F.concat(F.lit(MONDO), F.lpad(F.col("n_nationkey").cast("string"), 7, "0")).alias("condition"), F.col("n_nationkey").alias("k"))
    xrefs = lambda where, prefix: n.where(where).select("condition", F.concat(F.lit(prefix), "k").alias("xref"))
    preferred = conditions.join(xrefs("k % 3 = 0", "DOID:"), "condition").withColumn("origin", F.lit("preferred"))
    second = conditions.join(xrefs("k % 2 = 0", "EFO:"), "condition").withColumn("origin", F.lit("fallback"))
    return preferred.unionByName(second.join(preferred, "condition", "left_anti"))


@query("P04_subclass_closure", sql("hier", """, up AS (SELECT DISTINCT child AS start, child AS node FROM hier
  UNION SELECT start, parent FROM up JOIN hier ON node = child) SELECT start, node FROM up""", recursive=True))
def p04(spark, d):
    edges = hierarchy(spark, d)
    return closure(edges, edges.select(F.col("child").alias("node")))


@query("A03_gene_neighbourhood", sql("cat", f""" SELECT DISTINCT 'in' AS direction, '{SCHEMA}infectiousAgent' AS predicate, dataset AS other, name AS label FROM cat WHERE o_custkey % 40 = 7
  UNION SELECT 'out', '{SCHEMA}name', 'Agent 7', NULL FROM cat WHERE o_custkey % 40 = 7"""))
def a03(spark, d):
    return neighbourhood(triples(spark, d, exploded=True), "https://data.example.org/agent/7", SCHEMA + "name")


@query("G07_class_histogram", sql("cat", f" SELECT '{SCHEMA}Dataset' AS class, count(DISTINCT dataset) AS n FROM cat"))
def g07(spark, d):
    return triples(spark, d).where(F.col("p") == RDF_TYPE).groupBy(F.col("o").alias("class")).agg(F.countDistinct("s").alias("n"))


@query("G08_predicate_histogram", sql("cat", f""", t AS (SELECT DISTINCT dataset FROM cat) SELECT p AS predicate, n FROM (
  SELECT '{SCHEMA}healthCondition' AS p, count(DISTINCT dataset) AS n FROM cat UNION ALL SELECT '{SCHEMA}sameAs', count(DISTINCT dataset) FROM cat WHERE o_orderkey % 3 = 0
  UNION ALL SELECT '{SCHEMA}dateModified', count(DISTINCT dataset) FROM cat WHERE modified IS NOT NULL UNION ALL SELECT '{SCHEMA}url', count(DISTINCT dataset) FROM cat)"""))
def g08(spark, d):
    some = [SCHEMA + x for x in ("healthCondition", "sameAs", "dateModified", "url")]
    t = triples(spark, d).where(F.col("p").isin(*some))
    return t.groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("n"))


@query("G09_namespace_prefixes", sql("cat", """, ns AS (SELECT regexp_extract(o, '^(.*[/#])', 1) AS namespace, count(*) AS n FROM (
  SELECT DISTINCT dataset, condition AS o FROM cat UNION ALL SELECT DISTINCT dataset, taxon FROM cat UNION ALL SELECT DISTINCT dataset, grant_iri FROM cat) GROUP BY 1)
  SELECT namespace, n, 'ns' || row_number() OVER (ORDER BY n DESC, namespace) AS prefix FROM ns"""))
def g09(spark, d):
    from pyspark.sql import Window

    t = triples(spark, d).where(F.col("p").isin(*(SCHEMA + x for x in ("healthCondition", "species", "funding"))))
    counted = t.groupBy(F.regexp_extract("o", "^(.*[/#])", 1).alias("namespace")).agg(F.count("*").alias("n"))
    # one row for each namespace of the vocabulary
    return counted.withColumn("prefix", F.concat(F.lit("ns"), F.row_number().over(Window.orderBy(F.desc("n"), "namespace"))))


@query("G10_coverage_profile", sql("cat", " SELECT resource, count(*) AS total, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS with_doi, count(modified) AS with_modified, count(*) FILTER (WHERE o_orderkey % 3 = 0 AND modified IS NOT NULL) AS with_both FROM cat GROUP BY resource"))
def g10(spark, d):
    t = triples(spark, d)
    rows = optional(match(t, [IS_DATASET]), t, [has("?dataset", "sameAs", "?doi")])
    rows = optional(rows, t, [has("?dataset", "dateModified", "?modified")])
    both = F.col("doi").isNotNull() & F.col("modified").isNotNull()
    return rows.groupBy(_resource()).agg(F.count("*").alias("total"), F.count("doi").alias("with_doi"), F.count("modified").alias("with_modified"), F.count_if(both).alias("with_both"))


@query("G35_ask", sql("cat", " SELECT count(*) > 0 AS answer FROM cat WHERE condition_name = 'Atlantis'"))
def g35(spark, d):
    found = match(triples(spark, d), [has("?condition", "name", "Atlantis")]).limit(1)
    return found.agg((F.count("*") > 0).alias("answer"))


#: Parts that the graphs are united in; up to 200, Spark writes a shuffle without holding its rows.
UNION_PARTS = 200


def united(*graphs):
    """The distinct triples of all graphs."""
    # triples of a subject meet in a part before they are compared: else each task that reads a table holds all of its different triples, and few tasks hold all parts
    return reduce(DataFrame.unionByName, graphs).repartition(UNION_PARTS, "s").distinct()


@query("U07_graph_union", sql("cat", f" SELECT count(*) AS n FROM (SELECT dataset, condition FROM cat UNION SELECT dataset, taxon FROM cat)"))
def u07(spark, d):
    first, second = (triples(spark, d, only=only, repeated=True).select("s", "p", "o") for only in (("healthCondition", "species"), ("species",)))
    return united(first, second).agg(F.count("*").alias("n"))
