"""Queries that cross graphs: presets, drug and disease bridges, paths, discovery."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindle.operators.graph import closure, match, optional
from spindle.operators.statistics import fisher
from spindle.plans.cohorts import RANK_TEST, rank_z
from spindle.plans.registry import query
from spindle.sources.views import DATASET, GRANT, MONDO, RDF_TYPE, SCHEMA, TAXON, associations, cells, expression, hierarchy, read, samples, sql, triples

IS_DATASET = ("?dataset", RDF_TYPE, SCHEMA + "Dataset")
JOINED = lambda c: F.array_join(F.sort_array(F.collect_set(c)), " | ")


def has(s: str, p: str, o: str):
    return (s, SCHEMA + p, o)


@query("C11_drug_datasets", sql("cat", """, a AS (SELECT DISTINCT condition FROM cat WHERE agent_name = 'Agent 3'), ds AS (SELECT DISTINCT dataset, o_orderkey, condition_name FROM cat WHERE condition IN (SELECT condition FROM a) AND taxon_name = 'Africa')
  SELECT condition_name AS disease, count(*) AS datasets, count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount = 0.1)) AS with_expression FROM ds GROUP BY condition_name"""))
def c11(spark, d):
    t = triples(spark, d)
    diseases = match(t, [has("?x", "infectiousAgent", "?agent"), has("?agent", "name", "Agent 3"), has("?x", "healthCondition", "?condition")]).select("condition").distinct()
    found = match(t, [has("?dataset", "healthCondition", "?condition"), has("?condition", "name", "?disease"), has("?dataset", "species", "?taxon"), has("?taxon", "name", "Africa")])
    found = found.join(diseases, "condition", "left_semi").select("dataset", "disease").distinct()
    covered = read(spark, d, "lineitem").where("l_discount = 0.1").select(F.col("l_orderkey").cast("string").alias("key")).distinct().withColumn("covered", F.lit(True))
    rows = found.withColumn("key", F.substring_index("dataset", "/", -1)).join(covered, "key", "left")
    return rows.groupBy("disease").agg(F.count("*").alias("datasets"), F.count("covered").alias("with_expression"))


@query("C13_synonym_expansion", sql("cat", " SELECT condition AS iri, condition_name AS label, string_agg(DISTINCT grant_name, ' | ' ORDER BY grant_name) AS synonyms FROM cat WHERE c_nationkey IN (2, 9) GROUP BY ALL"))
def c13(spark, d):
    t = triples(spark, d)
    wanted = spark.createDataFrame([(MONDO + "0000002",), (MONDO + "0000009",)], "iri string")
    named = match(t, [has("?iri", "name", "?label")]).join(wanted, "iri", "left_semi")
    also = match(t, [has("?dataset", "healthCondition", "?iri"), has("?dataset", "funding", "?grant"), has("?grant", "name", "?synonym")]).select("iri", "synonym")
    return named.join(also, "iri", "left").groupBy("iri", "label").agg(JOINED("synonym").alias("synonyms"))


@query("C16_datasets_by_species", sql("cat", f" SELECT DISTINCT dataset, taxon FROM cat WHERE taxon IN ('{TAXON}1', '{TAXON}4')"))
def c16(spark, d):
    rows = match(triples(spark, d), [IS_DATASET, has("?dataset", "species", "?taxon")])
    return rows.where(F.col("taxon").isin(TAXON + "1", TAXON + "4")).select("dataset", "taxon").distinct()


@query("C20_diseases_of_agent", sql("cat", " SELECT agent_name, string_agg(DISTINCT condition_name, ' | ' ORDER BY condition_name) AS diseases, count(DISTINCT dataset) AS datasets FROM cat WHERE agent_name IN ('Agent 5', 'Agent 6') GROUP BY agent_name"))
def c20(spark, d):
    rows = match(triples(spark, d), [has("?agent", "name", "?agent_name"), has("?dataset", "infectiousAgent", "?agent"), has("?dataset", "healthCondition", "?c"), has("?c", "name", "?disease")])
    return rows.where(F.col("agent_name").isin("Agent 5", "Agent 6")).groupBy("agent_name").agg(JOINED("disease").alias("diseases"), F.countDistinct("dataset").alias("datasets"))


@query("R01_preset_agents_of_disease", sql("cat", " SELECT DISTINCT agent, agent_name FROM cat WHERE lower(condition_name) = 'nation_20' UNION SELECT DISTINCT agent, agent_name FROM cat WHERE grant_name = 'Grant 8'"))
def r01(spark, d):
    t = triples(spark, d)
    agent = [has("?dataset", "infectiousAgent", "?agent"), has("?agent", "name", "?agent_name")]
    one = match(t, [*agent, has("?dataset", "healthCondition", "?c"), has("?c", "name", "?disease")]).where(F.lower("disease") == "nation_20")
    two = match(t, [*agent, has("?dataset", "funding", "?g"), has("?g", "name", "Grant 8")])
    return one.select("agent", "agent_name").unionByName(two.select("agent", "agent_name")).distinct()


@query("R02_preset_optional_attributes", sql("cat", " SELECT DISTINCT dataset, name, modified, CASE WHEN o_orderstatus = 'O' THEN 'true' END AS free FROM cat WHERE condition_name = 'Nation_22' AND published LIKE '1999-0%'"))
def r02(spark, d):
    t = triples(spark, d)
    rows = match(t, [IS_DATASET, has("?dataset", "name", "?name"), has("?dataset", "healthCondition", MONDO + "0000022"), has("?dataset", "datePublished", "?published")])
    rows = rows.where(F.col("published").startswith("1999-0"))
    rows = optional(rows, t, [has("?dataset", "dateModified", "?modified")])
    return optional(rows, t, [has("?dataset", "isAccessibleForFree", "?free")]).select("dataset", "name", "modified", "free").distinct()


@query("R03_preset_grouped_attributes", sql("cat", " SELECT c_name AS author, string_agg(DISTINCT condition_name, ' | ' ORDER BY condition_name) AS diseases, string_agg(DISTINCT agent_name, ' | ' ORDER BY agent_name) AS agents, min(name) AS first_name FROM cat GROUP BY c_name"))
def r03(spark, d):
    rows = match(triples(spark, d), [
        has("?dataset", "author", "?person"), has("?person", "name", "?author"), has("?dataset", "healthCondition", "?c"), has("?c", "name", "?disease"),
        has("?dataset", "infectiousAgent", "?a"), has("?a", "name", "?agent_name"), has("?dataset", "name", "?name"),
    ])
    return rows.groupBy("author").agg(JOINED("disease").alias("diseases"), JOINED("agent_name").alias("agents"), F.min("name").alias("first_name"))


@query("R04_preset_gene_up", sql("assoc", " SELECT DISTINCT experiment, label, log2fc FROM assoc WHERE lower(symbol) = 'gene42' AND log2fc > 0"))
def r04(spark, d):
    return associations(spark, d).where((F.lower("symbol") == "gene42") & (F.col("log2fc") > 0)).select("experiment", "label", "log2fc").distinct()


@query("J08_cross_source_bridge", sql("assoc", ", g AS (SELECT gene, count(*) AS n FROM assoc WHERE log2fc > 0.05 GROUP BY gene) SELECT p_brand AS drug, count(DISTINCT gene) AS genes, sum(n)::BIGINT AS evidence FROM part JOIN g ON p_partkey = gene WHERE p_size < 10 GROUP BY p_brand"))
def j08(spark, d):
    genes = associations(spark, d).where("log2fc > 0.05").groupBy("gene").agg(F.count("*").alias("n"))
    drugs = read(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("drug"))
    return drugs.join(genes, "gene").groupBy("drug").agg(F.countDistinct("gene").alias("genes"), F.sum("n").alias("evidence"))


@query("J09_batched_semi_join", sql("assoc", " SELECT gene, label, min(log2fc) AS least FROM assoc WHERE gene IN (SELECT p_partkey FROM part WHERE p_size = 7) AND log2fc < 0 GROUP BY ALL"))
def j09(spark, d):
    wanted = read(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("gene"))
    return associations(spark, d).where("log2fc < 0").join(wanted, "gene", "left_semi").groupBy("gene", "label").agg(F.min("log2fc").alias("least"))


@query("A02_gene_disease_paths", sql("assoc hier", """, note AS (SELECT p_partkey AS gene, p_type AS label FROM part WHERE p_size > 45), strong AS (SELECT DISTINCT contrast, gene, label FROM assoc WHERE abs(log2fc) > 0.1),
  paths AS (SELECT 'expression' AS path, gene, label FROM strong UNION SELECT 'annotation', gene, label FROM note UNION SELECT 'parent', child, label FROM hier JOIN note ON parent = gene
  UNION SELECT 'contrast', s.gene, n.label FROM strong s JOIN strong t ON s.contrast = t.contrast AND s.gene <> t.gene JOIN note n ON t.gene = n.gene) SELECT path, label, count(*) AS genes FROM paths GROUP BY ALL"""))
def a02(spark, d):
    """Four kinds of paths from a gene to a disease: its expression, its annotation, its parent's, and that of another gene in one of its contrasts."""
    note = read(spark, d, "part").where("p_size > 45").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("label"))
    strong = associations(spark, d).where(F.abs("log2fc") > 0.1).select("contrast", "gene", "label").distinct()
    parent = hierarchy(spark, d).join(note, F.col("parent") == F.col("gene")).select(F.col("child").alias("gene"), "label")
    # of the annotated genes of a contrast only their labels count, and one gene where it is alone
    labels = strong.select("contrast", F.col("gene").alias("other")).join(note.withColumnRenamed("gene", "other"), "other").groupBy("contrast", F.col("label").alias("of")).agg(F.min("other").alias("least"), F.max("other").alias("most"))
    near = strong.select("contrast", "gene").join(labels, "contrast").where("gene <> least or gene <> most").select("gene", F.col("of").alias("label"))
    kinds = {"expression": strong, "annotation": note, "parent": parent, "contrast": near}
    paths = [rows.select(F.lit(kind).alias("path"), "gene", "label") for kind, rows in kinds.items()]
    return paths[0].unionByName(paths[1]).unionByName(paths[2]).unionByName(paths[3]).distinct().groupBy("path", "label").agg(F.count("*").alias("genes"))


@query("A06_ontology_discovery", sql("hier samples", """, up AS (SELECT DISTINCT child AS start, child AS node FROM hier UNION SELECT start, parent FROM up JOIN hier ON node = child), terms AS (SELECT DISTINCT start FROM up WHERE node IN (3, 11))
  SELECT platform, count(*) AS n FROM samples WHERE replace(sample, 'GSM', '')::BIGINT IN (SELECT start FROM terms) GROUP BY platform""", recursive=True))
def a06(spark, d):
    edges = hierarchy(spark, d)
    # downwards from the resolved terms: parents become children
    down = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    terms = closure(down, spark.createDataFrame([(3,), (11,)], "node long")).select("node").join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_semi").distinct()
    rows = samples(spark, d).withColumn("node", F.regexp_replace("sample", "^GSM", "").cast("long"))
    return rows.join(terms, "node", "left_semi").groupBy("platform").agg(F.count("*").alias("n"))


@query("A07_studies_by_condition_ids", sql("cat", f" SELECT DISTINCT dataset, condition, taxon_name AS species FROM cat WHERE condition IN ('{MONDO}0000005', '{MONDO}0000010', '{MONDO}0000015') AND dataset LIKE '{DATASET}5_low/%'"))
def a07(spark, d):
    ids = spark.createDataFrame([(f"{MONDO}{i:07d}",) for i in (5, 10, 15)], "condition string")
    rows = match(triples(spark, d), [IS_DATASET, has("?dataset", "healthCondition", "?condition"), has("?dataset", "species", "?t"), has("?t", "name", "?species")])
    return rows.where(F.col("dataset").startswith(DATASET + "5_low/")).join(F.broadcast(ids), "condition").select("dataset", "condition", "species").distinct()


@query("A05_layered_gene_set", sql("hier assoc", """, up AS (SELECT DISTINCT child AS start, child AS node FROM hier UNION SELECT start, parent FROM up JOIN hier ON node = child), g AS (SELECT DISTINCT start AS gene FROM up WHERE node = 7)
  SELECT experiment, count(DISTINCT assoc.gene) AS genes, round(count(DISTINCT assoc.gene) / (SELECT count(*) FROM g), 8) AS concordance FROM assoc JOIN g ON assoc.gene = g.gene WHERE log2fc > 0 GROUP BY experiment""", recursive=True))
def a05(spark, d):
    edges = hierarchy(spark, d)
    # downwards from the term, so that no other branch is walked
    below = closure(edges.select(F.col("parent").alias("child"), F.col("child").alias("parent")), spark.createDataFrame([(7,)], "node long"))
    genes = below.select(F.col("node").alias("gene")).join(edges.select(F.col("child").alias("gene")).distinct(), "gene", "left_semi")
    total = genes.agg(F.count("*").alias("total"))
    rows = associations(spark, d).where("log2fc > 0").join(genes, "gene", "left_semi")
    counted = rows.groupBy("experiment").agg(F.countDistinct("gene").alias("genes"))
    # one row on the right
    return counted.join(F.broadcast(total), how="cross").select("experiment", "genes", F.round(F.col("genes") / F.col("total"), 8).alias("concordance"))


@query("G21_duplicate_symbols", "WITH e AS (SELECT l_partkey % 50 AS symbol, l_partkey AS gene, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL) SELECT symbol, arg_min(n, gene) AS first, round(avg(n), 8) AS mean, sum(n)::BIGINT AS total FROM e GROUP BY symbol")
def g21(spark, d):
    e = read(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("symbol"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").cast("long").alias("n"))
    return e.groupBy("symbol").agg(F.min_by("n", "gene").alias("first"), F.round(F.avg("n"), 8).alias("mean"), F.sum("n").alias("total"))


@query("G23_two_conditions", sql("cells", RANK_TEST.replace("@", "dataset") + """, m AS (SELECT dataset, avg(value) FILTER (WHERE disease = 'normal') AS a, avg(value) FILTER (WHERE disease = 'case') AS b, count(*) FILTER (WHERE disease = 'normal') AS n_a, count(*) FILTER (WHERE disease = 'case') AS n_b, list_sort(list(DISTINCT cell_type)) AS types FROM cells GROUP BY dataset)
  SELECT dataset, round(a, 8) AS a, round(b, 8) AS b, round((b + 0.01) / (a + 0.01), 8) AS ratio, round(log2((b + 0.01) / (a + 0.01)), 8) + 0.0 AS log2fc, n_a, n_b, z, pvalue, len(types) AS n_types, array_to_string(types[1:10], ',') AS types FROM m JOIN z USING (dataset) WHERE n_a >= 5 AND n_b >= 5"""))
def g23(spark, d):
    """Means of both conditions, their ratio with 0.01 added to each, rank test, sizes, and the first ten kinds of cells; both need five cells."""
    value, count = (lambda g: F.avg(F.when(F.col("disease") == g, F.col("value")))), (lambda g: F.count_if(F.col("disease") == g))
    means = cells(spark, d).groupBy("dataset").agg(
        value("normal").alias("a"), value("case").alias("b"), count("normal").alias("n_a"), count("case").alias("n_b"), F.sort_array(F.collect_set("cell_type")).alias("types")
    ).where("n_a >= 5 and n_b >= 5")
    ratio = (F.col("b") + 0.01) / (F.col("a") + 0.01)
    out = means.join(rank_z(spark, d, "dataset"), "dataset")
    return out.select(
        "dataset", F.round("a", 8).alias("a"), F.round("b", 8).alias("b"), F.round(ratio, 8).alias("ratio"), (F.round(F.log2(ratio), 8) + 0.0).alias("log2fc"), "n_a", "n_b", "z", "pvalue",
        F.size("types").cast("long").alias("n_types"), F.array_join(F.slice("types", 1, 10), ",").alias("types"),
    )


@query("G33_encoding_vote", "SELECT CASE WHEN count(*) FILTER (WHERE url LIKE 'https%') * 2 >= count(*) THEN 'https' ELSE 'http' END AS vote FROM (SELECT url FROM pages ORDER BY page_id LIMIT 10)")
def g33(spark, d):
    first = read(spark, d, "pages").orderBy("page_id").limit(10)
    return first.agg(F.when(F.count_if(F.col("url").startswith("https")) * 2 >= F.count("*"), "https").otherwise("http").alias("vote"))


@query("G34_genes_per_term", sql("assoc", " SELECT label, count(DISTINCT gene) AS n, min(gene) AS first FROM assoc GROUP BY label"))
def g34(spark, d):
    return associations(spark, d).groupBy("label").agg(F.countDistinct("gene").alias("n"), F.min("gene").alias("first"))


@query("W02_top_terms_per_group", "SELECT lang, source, n FROM (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS i FROM documents GROUP BY lang, source) WHERE i <= 5")
def w02(spark, d):
    counted = read(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return counted.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source"))).where("i <= 5").drop("i")


@query("B15_metadata_by_ids", sql("samples", " SELECT sample, series_id, platform FROM samples WHERE sample IN ('GSM1', 'GSM5', 'GSM77', 'GSM0')"))
def b15(spark, d):
    return samples(spark, d).where(F.col("sample").isin("GSM1", "GSM5", "GSM77", "GSM0")).select("sample", "series_id", "platform")


@query("B17_gene_subset_cpm", sql("expr", ", l AS (SELECT sample, sum(count) AS library FROM expr GROUP BY sample) SELECT gene, expr.sample, round(count / library * 1e6, 6) AS cpm FROM expr JOIN l ON expr.sample = l.sample WHERE gene IN (1, 2, 3)"))
def b17(spark, d):
    rows = expression(spark, d)
    libraries = rows.groupBy("sample").agg(F.sum("count").alias("library"))
    return rows.where(F.col("gene").isin(1, 2, 3)).join(libraries, "sample").select("gene", "sample", F.round(F.col("count") / F.col("library") * 1e6, 6).alias("cpm"))


@query("B18_available_values", sql("cells", " SELECT DISTINCT 'cell_type' AS kind, cell_type AS value FROM cells UNION SELECT DISTINCT 'disease', disease FROM cells"))
def b18(spark, d):
    rows = cells(spark, d)
    one = lambda c: rows.select(F.lit(c).alias("kind"), F.col(c).alias("value"))
    return one("cell_type").unionByName(one("disease")).distinct()


@query("B22_record_fold", sql("cat", " SELECT dataset, min(name) AS name, min(modified) AS modified, count(DISTINCT condition) AS conditions FROM cat WHERE grant_iri = '" + GRANT + "77' GROUP BY dataset"))
def b22(spark, d):
    t = triples(spark, d)
    rows = match(t, [has("?dataset", "funding", GRANT + "77"), has("?dataset", "name", "?name"), has("?dataset", "healthCondition", "?condition")])
    rows = optional(rows, t, [has("?dataset", "dateModified", "?modified")])
    return rows.groupBy("dataset").agg(F.min("name").alias("name"), F.min("modified").alias("modified"), F.countDistinct("condition").alias("conditions"))


@query("B23_symbol_id_resolution", "WITH q AS (SELECT 'GENE' || p_partkey AS x FROM part UNION ALL SELECT p_partkey::VARCHAR FROM part) SELECT x, CASE WHEN starts_with(x, 'GENE') THEN replace(x, 'GENE', '') ELSE 'GENE' || x END AS other FROM q")
def b23(spark, d):
    part = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("GENE"), "p_partkey").alias("symbol"))
    asked = part.select(F.col("symbol").alias("x")).unionByName(part.select(F.col("id").alias("x")))
    both = part.select(F.col("symbol").alias("x"), F.col("id").alias("other")).unionByName(part.select(F.col("id").alias("x"), F.col("symbol").alias("other")))
    return asked.join(both, "x")


@query("B26_examples_and_prefixes", sql("cat", " SELECT 'MONDO' AS ontology, count(DISTINCT condition) AS n FROM cat UNION ALL SELECT 'taxonomy', count(DISTINCT taxon) FROM cat"))
def b26(spark, d):
    o = triples(spark, d, exploded=True).where("iri").select("o").distinct()
    ontology = F.when(F.col("o").contains("/MONDO_"), "MONDO").when(F.col("o").contains("/taxonomy/"), "taxonomy")
    return o.groupBy(ontology.alias("ontology")).agg(F.count("*").alias("n")).where("ontology is not null")


@query("M01_graph_profile", sql("cat", " SELECT resource, count(DISTINCT dataset) AS datasets, count(DISTINCT condition) AS conditions, count(DISTINCT agent) AS agents, count(DISTINCT funder) AS funders FROM cat GROUP BY resource"))
def m01(spark, d):
    facts = triples(spark, d, only=[RDF_TYPE, "healthCondition", "infectiousAgent", "funding", "funder"])
    rows = match(facts, [IS_DATASET, has("?dataset", "healthCondition", "?condition"), has("?dataset", "infectiousAgent", "?agent"), has("?dataset", "funding", "?g"), has("?g", "funder", "?funder")])
    resource = F.regexp_extract("dataset", "/dataset/([^/]+)/", 1)
    return rows.groupBy(resource.alias("resource")).agg(F.countDistinct("dataset").alias("datasets"), F.countDistinct("condition").alias("conditions"), F.countDistinct("agent").alias("agents"), F.countDistinct("funder").alias("funders"))


@query("X09_study_combination", sql("assoc", ", s AS (SELECT gene, experiment, greatest(min(adj_p)::DOUBLE, 2.2250738585072014e-308) AS p, avg(log2fc) AS lfc, count(*) AS n FROM assoc GROUP BY gene, experiment), g AS (SELECT gene, count(*) AS k, -2 * sum(ln(p)) AS x, sum(sqrt(n) * lfc) / sum(sqrt(n)) AS lfc FROM s GROUP BY gene HAVING count(*) >= 2) SELECT gene, k AS studies, round(lfc, 8) + 0.0 AS log2fc, round(x, 6) AS x, round(least(1.0, list_sum(list_transform(range(k), lambda i: exp(i * ln(greatest(x, 1e-300) / 2) - x / 2 - lgamma(i + 1.0))))), 8) AS pvalue FROM g"))
def x09(spark, d):
    s = associations(spark, d).groupBy("gene", F.col("experiment").alias("study")).agg(F.min("adj_p").cast("double").alias("p"), F.avg("log2fc").alias("lfc"), F.count("*").alias("n"))
    folds = s.groupBy("gene").agg((F.round(F.sum(F.sqrt("n") * F.col("lfc")) / F.sum(F.sqrt("n")), 8) + 0.0).alias("log2fc"))
    out = fisher(s).join(folds, "gene")
    return out.select("gene", F.col("n_studies").alias("studies"), "log2fc", F.round("x", 6).alias("x"), F.round("pvalue", 8).alias("pvalue"))
