"""Queries over archive files: the files of an expression archive are written from the tables, and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions.lineage import scratch_path
from spindle.plans.registry import query
from spindle.sources import atlas_files as atlas
from spindle.sources.views import associations, read, sql

TAB = "\t"
ONTOLOGY = "http://purl.obolibrary.org/obo/EFO_"
LINES = range(1, 8)


def saved(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """Write ``lines(name, value)`` as a folder of parts for each name; return the pattern of these folders."""
    path = scratch_path(spark, f"archive-{name}")
    lines.select("name", "value").write.partitionBy("name").text(path)
    return f"{path}/name=*"


def _line(*cells) -> Column:
    return F.concat_ws(TAB, *(F.coalesce(c.cast("string"), F.lit("NA")) for c in cells))


def _file(nation: str, end: str):
    return F.concat(F.lit("E-CURD-"), F.col(nation).cast("string"), F.lit(end))


def idf_files(spark, d) -> str:
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = read(spark, d, "supplier").select("s_nationkey", "s_name")
    lines = [
        n.select(_file("n_nationkey", ".idf.txt").alias("name"), _line(F.lit("Investigation Title"), F.col("n_name")).alias("value")),
        n.select(_file("n_nationkey", ".idf.txt").alias("name"), _line(F.lit("Comment[Region]"), F.col("r_name"), F.lit(""), F.lit(" ")).alias("value")),
        n.select(_file("n_nationkey", ".idf.txt").alias("name"), F.lit("Protocol Name\t\t").alias("value")),
        s.select(_file("s_nationkey", ".idf.txt").alias("name"), _line(F.lit("Person Last Name"), F.col("s_name"), F.lit("")).alias("value")),
    ]
    return saved(spark, reduce(DataFrame.unionByName, lines), "idf")


def sdrf_files(spark, d) -> str:
    c = read(spark, d, "customer").select("c_nationkey", "c_custkey", "c_mktsegment")
    cells = lambda kind, name, value, iri: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.cast("string").alias("value"), iri.alias("iri"))
    own = F.concat(F.lit(ONTOLOGY), F.lower("c_mktsegment"))
    two = F.when(F.col("c_custkey") % 3 != 0, F.concat(own, F.lit(" "), F.lit(ONTOLOGY), (F.col("c_custkey") % 7).cast("string"))).otherwise("")
    rows = c.select("c_nationkey", "c_custkey", F.explode(F.array(
        cells("factor", "disease", F.col("c_mktsegment"), own), cells("characteristic", "age", F.col("c_custkey") % 90, F.lit("")),
        cells("characteristic", "organism part", F.concat(F.lit("patient's "), F.col("c_mktsegment")), two),
    )).alias("x"))
    value = _line(_file("c_nationkey", ""), F.lit(""), F.concat(F.lit("S"), "c_custkey"), F.col("x.kind"), F.col("x.name"), F.col("x.value"), F.col("x.iri"))
    return saved(spark, rows.select(_file("c_nationkey", ".condensed-sdrf.tsv").alias("name"), value.alias("value")), "sdrf")


def configuration_files(spark, d) -> str:
    """An analytics element for each nation and 50 customers; its groups are even and odd customers."""
    c = read(spark, d, "customer").select("c_nationkey", "c_custkey").withColumn("block", F.floor(F.col("c_custkey") / 50))
    group = lambda odd: F.sort_array(F.collect_list(F.when(F.col("c_custkey") % 2 == odd, F.concat(F.lit("<assay>S"), "c_custkey", F.lit("</assay>")))))
    g = c.groupBy("c_nationkey", "block").agg(group(0).alias("g1"), group(1).alias("g2"))
    element = lambda name, label: F.when(F.size(name) > 0, F.concat(F.lit(f'<assay_group id="{name}" label="{label}">'), F.array_join(name, ""), F.lit("</assay_group>"))).otherwise("")
    xml = F.concat(
        F.lit("<analytics><array_design> A-"), "block", F.lit(" </array_design><assay_groups>"), element("g1", "even"), element("g2", "odd"),
        F.lit("</assay_groups><contrasts><contrast id=\"g1_g2\"><name>odd vs even</name><reference_assay_group>g1</reference_assay_group><test_assay_group>g2</test_assay_group></contrast></contrasts></analytics>"),
    )
    name = _file("c_nationkey", "-configuration.xml").alias("name")
    end = lambda i, tag: F.struct(F.lit(i).alias("i"), F.lit(tag).alias("value"))
    ends = c.select(name).distinct().select("name", F.inline(F.array(end(0, "<configuration>"), end(2, "</configuration>"))))
    # a document has one root, so a file is written by one task
    lines = g.select(name, F.lit(1).alias("i"), xml.alias("value")).unionByName(ends)
    return saved(spark, lines.repartition("name").sortWithinPartitions("name", "i"), "configuration")


def analytics_files(spark, d) -> str:
    """A table for each experiment: a row for each gene and design element, columns for seven contrasts."""
    rows = associations(spark, d).select(
        "experiment", "gene", "symbol", "adj_p", "log2fc", F.regexp_extract("contrast", "-g([0-9]+)_g[0-9]+$", 1).alias("probe"), F.regexp_extract("contrast", "_g([0-9]+)$", 1).cast("int").alias("k")
    )
    one = rows.groupBy("experiment", "gene", "symbol", "probe", "k").agg(F.min("adj_p").alias("p"), F.count("*").alias("t"), F.max("log2fc").alias("l"))
    wide = one.groupBy("experiment", "gene", "symbol", "probe").pivot("k", list(LINES)).agg(F.first("p").alias("p"), F.first("t").alias("t"), F.first("l").alias("l"))
    value = _line(F.col("gene"), F.col("symbol"), F.col("probe"), *(F.col(f"{k}_{x}").cast("double") for k in LINES for x in "ptl"))
    name = F.concat("experiment", F.lit("_A-1-analytics.tsv"))
    head = "\t".join(["Gene ID", "Gene Name", "Design Element", *(f"g{k}_g0.{x}" for k in LINES for x in ("p-value", "t-statistic", "log2foldchange"))])
    lines = wide.select(name.alias("name"), value.alias("value"))
    heads = rows.select(name.alias("name")).distinct().select("name", F.lit(head).alias("value"))
    # an undecorated table, which readers skip
    other = heads.select(F.concat("name", F.lit(".undecorated")).alias("name"), "value")
    return saved(spark, lines.unionByName(heads).unionByName(other), "analytics")


def enrichment_rows(spark, d) -> DataFrame:
    rows = associations(spark, d).groupBy("experiment", "label").agg(
        F.countDistinct("gene").alias("size"), F.count_if(F.col("adj_p") < 0.02).alias("significant"), F.count_if(F.col("adj_p") >= 0.02).alias("other"),
        F.min("adj_p").alias("p_value"), F.max("adj_p").alias("p_adj"), F.max("log2fc").alias("effect"),
    )
    source = F.element_at(F.array(F.lit("go"), F.lit("reactome"), F.lit("interpro")), (F.length("label") % 3 + 1).cast("int"))
    return rows.withColumn("source", source)


def enrichment_files(spark, d) -> str:
    rows = enrichment_rows(spark, d)
    name = F.concat("experiment", F.lit(".g1_g2."), "source", F.lit(".gsea.tsv"))
    head = "Term\tAccession\tGenes (tot)\tStat (non-dir.) p\tp adj (non-dir.)\tSignificant..in.gene.set.\tNon.significant..in.gene.set.\teffect.size"
    value = _line(F.concat(F.lit("T:"), "label"), F.col("label"), F.col("size"), F.col("p_value").cast("double"), F.when(F.col("p_adj") < 0.08, F.col("p_adj").cast("double")), F.col("significant"), F.col("other"), F.col("effect"))
    lines = rows.select(name.alias("name"), F.lit(1).alias("i"), value.alias("value"))
    heads = rows.select(name.alias("name")).distinct().select("name", F.lit(0).alias("i"), F.lit(head).alias("value"))
    # the header is the first line of a file, so a file is written by one task
    return saved(spark, lines.unionByName(heads).repartition("name").sortWithinPartitions("name", "i"), "gsea")


GROUPS = "grp AS (SELECT 'E-CURD-' || c_nationkey AS experiment, 'A-' || (c_custkey // 50) AS array_design, 'g' || (1 + c_custkey % 2) AS group_id, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS label, 'S' || c_custkey AS sample, c_mktsegment FROM customer)"


@query("S02_idf_scan", "WITH v AS (SELECT n_nationkey AS n, 'Investigation Title' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'Comment[Region]', r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_nationkey, 'Person Last Name', s_name FROM supplier) SELECT 'E-CURD-' || n AS experiment, key, count(*) AS n, min(value) AS first, max(value) AS last FROM v GROUP BY ALL")
def s02(spark, d):
    rows = atlas.idf(spark, idf_files(spark, d))
    return rows.select("experiment", "key", F.size("values").cast("long").alias("n"), F.array_min("values").alias("first"), F.array_max("values").alias("last"))


SDRF = f"""sdrf AS (SELECT 'E-CURD-' || c_nationkey AS accession, 'S' || c_custkey AS sample, unnest(['factor', 'characteristic', 'characteristic']) AS kind, unnest(['disease', 'age', 'organism part']) AS name,
  unnest([c_mktsegment, (c_custkey % 90)::VARCHAR, 'patient''s ' || c_mktsegment]) AS value,
  unnest(['{ONTOLOGY}' || lower(c_mktsegment), NULL, CASE WHEN c_custkey % 3 <> 0 THEN '{ONTOLOGY}' || lower(c_mktsegment) || ' {ONTOLOGY}' || (c_custkey % 7) END]) AS iri FROM customer)"""


@query("S03_condensed_sdrf_scan", f"WITH {SDRF} SELECT * FROM sdrf")
def s03(spark, d):
    return atlas.condensed_sdrf(spark, sdrf_files(spark, d)).drop("array")


@query("E06_characteristic_nodes", f"WITH {SDRF}, u AS (SELECT name, value, unnest(CASE WHEN iri IS NULL THEN ['https://data.example.org/value/' || replace(replace(value, ' ', '_'), '''', '')] ELSE string_split(iri, ' ') END) AS iri, accession FROM sdrf WHERE name <> 'age') SELECT name, iri, min(value) AS value, count(DISTINCT accession) AS studies FROM u GROUP BY name, iri")
def e06(spark, d):
    rows = atlas.characteristics(atlas.condensed_sdrf(spark, sdrf_files(spark, d)))
    return rows.groupBy("name", "iri").agg(F.min("value").alias("value"), F.countDistinct("accession").alias("studies"))


@query("S04_configuration_groups", f"WITH {GROUPS} SELECT experiment, array_design, group_id, label, sample FROM grp")
def s04(spark, d):
    return atlas.assay_groups(atlas.configuration(spark, configuration_files(spark, d)))


@query("S04_configuration_contrasts", f"WITH {GROUPS} SELECT DISTINCT experiment, array_design, 'g1_g2' AS contrast, 'odd vs even' AS name, 'g1' AS reference_group, 'g2' AS test_group FROM grp")
def s04b(spark, d):
    return atlas.contrasts(atlas.configuration(spark, configuration_files(spark, d)))


@query("J15_sample_group_factor", f"WITH {GROUPS} SELECT experiment, array_design, group_id, 'disease' AS name, c_mktsegment AS value, count(*) AS samples FROM grp GROUP BY ALL")
def j15(spark, d):
    groups = atlas.assay_groups(atlas.configuration(spark, configuration_files(spark, d)))
    factors = atlas.condensed_sdrf(spark, sdrf_files(spark, d)).where("kind = 'factor'").select(F.col("accession").alias("experiment"), "sample", "name", "value")
    return groups.join(factors, ["experiment", "sample"]).groupBy("experiment", "array_design", "group_id", "name", "value").agg(F.count("*").alias("samples"))


@query("J16_contrast_factors", f"WITH {GROUPS} SELECT DISTINCT experiment, 'g1_g2' AS contrast, CASE group_id WHEN 'g1' THEN 'reference' ELSE 'test' END AS side, 'disease' AS name, c_mktsegment AS value FROM grp")
def j16(spark, d):
    config = atlas.configuration(spark, configuration_files(spark, d))
    return atlas.contrast_factors(atlas.contrasts(config), atlas.assay_groups(config), atlas.condensed_sdrf(spark, sdrf_files(spark, d)))


ANALYTICS = "wide AS (SELECT experiment, gene::VARCHAR AS gene_id, symbol AS gene_name, regexp_extract(contrast, '-g([0-9]+)_g[0-9]+$', 1) AS design_element, 'g' || regexp_extract(contrast, '_g([0-9]+)$', 1) || '_g0' AS contrast, min(adj_p)::DOUBLE AS p_value, count(*)::DOUBLE AS t_statistic, max(log2fc)::DOUBLE AS log2fc FROM assoc GROUP BY ALL)"


@query("S05_analytics_scan", sql("assoc", f", {ANALYTICS} SELECT * FROM wide"))
def s05(spark, d):
    return atlas.analytics(spark, analytics_files(spark, d))


@query("E10_top_edges_per_contrast", sql("assoc", f", {ANALYTICS}, r AS (SELECT *, row_number() OVER (PARTITION BY experiment, contrast ORDER BY p_value, gene_id, design_element) AS i FROM wide) SELECT experiment, contrast, gene_id, design_element, p_value, log2fc, CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END AS direction FROM r WHERE i <= 50"))
def e10(spark, d):
    rows = atlas.analytics(spark, analytics_files(spark, d)).withColumn("tie", F.struct("gene_id", "design_element"))
    top = atlas.top_per_contrast(rows, ["experiment", "contrast"], "p_value", "tie", 50)
    return top.select("experiment", "contrast", "gene_id", "design_element", "p_value", "log2fc", F.when(F.col("log2fc") > 0, "up").otherwise("down").alias("direction"))


GSEA = "gsea AS (SELECT experiment, 'g1_g2' AS contrast, ['go', 'reactome', 'interpro'][length(label) % 3 + 1] AS source, 'T:' || label AS term_id, label AS term_name, count(DISTINCT gene)::INTEGER AS size, (count(*) FILTER (WHERE adj_p < 0.02))::INTEGER AS significant, (count(*) FILTER (WHERE adj_p >= 0.02))::INTEGER AS other, min(adj_p)::DOUBLE AS p_value, CASE WHEN max(adj_p) < 0.08 THEN max(adj_p)::DOUBLE END AS p_adj, max(log2fc) AS effect FROM assoc GROUP BY experiment, label)"


@query("S06_enrichment_scan", sql("assoc", f", {GSEA} SELECT * FROM gsea"))
def s06(spark, d):
    return atlas.enrichment(spark, enrichment_files(spark, d))


@query("B05_term_nodes", sql("assoc", f", {GSEA} SELECT source, term_id, min(term_name) AS term_name FROM gsea GROUP BY ALL"))
def b05(spark, d):
    return atlas.enrichment(spark, enrichment_files(spark, d)).groupBy("source", "term_id").agg(F.min("term_name").alias("term_name"))


@query("S07_file_discovery", sql("assoc", f", {GSEA} SELECT DISTINCT experiment || '_A-1-analytics.tsv' AS file, experiment, NULL::VARCHAR AS contrast, 'analytics' AS kind, NULL::VARCHAR AS source FROM gsea UNION SELECT experiment || '.g1_g2.' || source || '.gsea.tsv', experiment, 'g1_g2', 'gsea', source FROM gsea"))
def s07(spark, d):
    return atlas.discover(spark, analytics_files(spark, d)).unionByName(atlas.discover(spark, enrichment_files(spark, d)))


@query("S08_names_of_files", sql("assoc", f", {GSEA} SELECT source, contrast, count(DISTINCT experiment) AS experiments FROM gsea GROUP BY ALL"))
def s08(spark, d):
    files = atlas.discover(spark, enrichment_files(spark, d))
    return files.groupBy("source", "contrast").agg(F.countDistinct("experiment").alias("experiments"))


@query("S20_gene_id_map", "SELECT p_name AS key, min('ENSG' || p_partkey) AS value FROM part WHERE p_partkey % 5 <> 0 GROUP BY p_name")
def s20(spark, d):
    path = scratch_path(spark, "archive-genes")
    read(spark, d, "part").select(F.col("p_name").alias("symbol"), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("ENSG"), "p_partkey")).alias("ensembl_gene_id")).write.option("sep", TAB).option("header", True).csv(path)
    return atlas.gene_ids(spark, path)


@query("S21_ortholog_scan", "SELECT DISTINCT 'GENE' || l_partkey AS gene, 'Gene' || l_suppkey AS other FROM lineitem")
def s21(spark, d):
    pairs = read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    comment = pairs.groupBy(F.col("l_suppkey")).agg(F.count("*").alias("n")).select(F.lit("orthologs.tsv").alias("name"), F.concat(F.lit("# supplier "), "l_suppkey", F.lit("\thas "), "n").alias("value"))
    lines = pairs.select(F.lit("orthologs.tsv").alias("name"), _line(F.concat(F.lit("GENE"), "l_partkey"), F.concat(F.lit("Gene"), "l_suppkey")).alias("value"))
    return atlas.orthologs(spark, saved(spark, lines.unionByName(comment), "orthologs"))
