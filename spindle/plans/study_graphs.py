"""Queries that turn the frames of expression studies into graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindle.functions.lineage import scratch_path
from spindle.operators import study_graph as g
from spindle.plans.registry import query
from spindle.sources.views import MONDO, RDF_TYPE, SCHEMA, associations, read, sql

TYPE, REL, NODE = RDF_TYPE, g.RELATION, g.BASE
ORGANISMS = ["Homo sapiens", "MUS musculus", " Danio rerio ", "Martian"]
#: A study for each nation, an assay for each supplier, attributes of its customers.
STUDIES = """st AS (SELECT n_nationkey AS k, 'E-GEOD-' || n_nationkey AS study, n_name AS title, r_name AS description,
  ['Homo sapiens', 'MUS musculus', ' Danio rerio ', 'Martian'][n_nationkey % 4 + 1] AS organism, ['9606', '10090', '7955', NULL][n_nationkey % 4 + 1] AS taxon FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def studies(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    organism = F.element_at(F.array(*map(F.lit, ORGANISMS)), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return n.select(F.col("n_nationkey").alias("k"), F.concat(F.lit("E-GEOD-"), "n_nationkey").alias("study"), F.col("n_name").alias("title"), F.col("r_name").alias("description"), organism.alias("organism"))


def _study():
    return g.node_iri("study", "study")


def _assay():
    return g.node_iri("assay", "study", "s_suppkey")


def _gene():
    return g.node_iri("gene", F.col("gene").cast("string"))


def study_nodes(spark, d):
    return g.nodes(studies(spark, d), _study(), "Study", {"name": "study", "title": "title", "description": "description"})


def taxon_part(spark, d):
    rows = studies(spark, d).withColumn("taxon", g.taxon_of("organism")).where("taxon is not null").withColumn("own", F.trim("organism"))
    taxon = g.node_iri("taxon", "taxon")
    return g.nodes(rows, taxon, "OrganismTaxon", {"identifier": "taxon"}).unionByName(g.edges(rows, _study(), "IN_TAXON", taxon))


def attribute_part(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_mktsegment").distinct().join(studies(spark, d), "k")
    value = g.node_iri("attribute", F.lower("c_mktsegment"))
    condition = F.concat(F.lit(MONDO), F.lpad(F.col("k").cast("string"), 7, "0"))
    return g.nodes(c, value, "Attribute", {"name": "c_mktsegment"}).unionByName(g.edges(c, _study(), "HAS_ATTRIBUTE", value)).unionByName(g.edges(c, _study(), "STUDIES", condition))


def assay_part(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", "s_name").join(studies(spark, d), "k")
    return g.nodes(s, _assay(), "Assay", {"name": "s_name"}).unionByName(g.edges(s, _study(), "HAS_OUTPUT", _assay()))


def strongest(spark, d):
    """The associations of least p-value with a change of at least 0.05."""
    rows = associations(spark, d).where("adj_p < 0.01 and abs(log2fc) >= 0.05")
    return rows.select("contrast", F.col("experiment").alias("study"), F.regexp_extract("contrast", "-g([0-9]+)_g", 1).alias("s_suppkey"), "gene", "symbol", "log2fc", F.col("adj_p").cast("double").alias("adj_p"), "label")


def expression_part(spark, d):
    rows = strongest(spark, d)
    up = F.col("log2fc") > 0
    facts = [g.statements(rows.where(where), _assay(), relation, _gene(), ["log2fc", "adj_p"], {"method": "limma"}) for relation, where in (("UPREGULATES", up), ("DOWNREGULATES", ~up))]
    return g.joined(g.nodes(rows, _gene(), "Gene", {"symbol": "symbol"}), *facts)


def enrichment_part(spark, d):
    rows = strongest(spark, d).groupBy("study", "s_suppkey", "label").agg(F.min("adj_p").alias("p_adj"), F.countDistinct("gene").alias("size"))
    term = g.node_iri("term", F.lower("label"))
    return g.nodes(rows, term, "Term", {"name": "label"}).unionByName(g.statements(rows, _assay(), "ENRICHED_IN", term, ["p_adj", "size"], {"source": "go"}))


def _by_predicate(triples):
    return triples.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))


@query("E15_organism_to_taxon", f"WITH {STUDIES} SELECT study, organism, taxon FROM st")
def e15(spark, d):
    return studies(spark, d).select("study", "organism", g.taxon_of("organism").alias("taxon"))


@query("E06_study_nodes", f"WITH {STUDIES} SELECT '{NODE}study/' || study AS s, '{TYPE}' AS p, '{REL}Study' AS o, true AS iri FROM st UNION ALL SELECT '{NODE}study/' || study, '{SCHEMA}name', study, false FROM st UNION ALL SELECT '{NODE}study/' || study, '{SCHEMA}title', title, false FROM st UNION ALL SELECT '{NODE}study/' || study, '{SCHEMA}description', description, false FROM st")
def e06(spark, d):
    return study_nodes(spark, d)


@query("E09_attribute_edges", f"WITH {STUDIES}, c AS (SELECT DISTINCT study, k, c_mktsegment AS v FROM customer JOIN st ON c_nationkey = k) SELECT '{NODE}attribute/' || lower(v) AS s, '{TYPE}' AS p, '{REL}Attribute' AS o, true AS iri FROM c UNION SELECT '{NODE}attribute/' || lower(v), '{SCHEMA}name', v, false FROM c UNION SELECT '{NODE}study/' || study, '{REL}HAS_ATTRIBUTE', '{NODE}attribute/' || lower(v), true FROM c UNION SELECT '{NODE}study/' || study, '{REL}STUDIES', '{MONDO}' || lpad(k::VARCHAR, 7, '0'), true FROM c")
def e09(spark, d):
    return attribute_part(spark, d)


STRONG = "strong AS (SELECT contrast, experiment AS study, regexp_extract(contrast, '-g([0-9]+)_g', 1) AS supp, gene, symbol, log2fc, adj_p::DOUBLE AS adj_p, label FROM assoc WHERE adj_p < 0.01 AND abs(log2fc) >= 0.05)"


@query("E12_enrichment_graph", sql("assoc", f""", {STRONG}, e AS (SELECT study, supp, label, min(adj_p) AS p_adj, count(DISTINCT gene) AS size FROM strong GROUP BY ALL)
  SELECT '{TYPE}' AS p, (SELECT count(DISTINCT label) FROM e) + (SELECT count(*) FROM e) AS n, (SELECT count(DISTINCT label) FROM e) + (SELECT count(*) FROM e) AS subjects, (count(*) > 0)::BIGINT * 2 AS objects FROM e
  UNION ALL SELECT '{SCHEMA}name', count(DISTINCT label), count(DISTINCT label), count(DISTINCT label) FROM e UNION ALL SELECT '{REL}subject', count(*), count(*), count(DISTINCT study || '-' || supp) FROM e
  UNION ALL SELECT '{REL}predicate', count(*), count(*), (count(*) > 0)::BIGINT FROM e UNION ALL SELECT '{REL}object', count(*), count(*), count(DISTINCT label) FROM e UNION ALL SELECT '{SCHEMA}p_adj', count(*), count(*), count(DISTINCT p_adj) FROM e
  UNION ALL SELECT '{SCHEMA}size', count(*), count(*), count(DISTINCT size) FROM e UNION ALL SELECT '{SCHEMA}source', count(*), count(*), (count(*) > 0)::BIGINT FROM e"""))
def e12(spark, d):
    return _by_predicate(enrichment_part(spark, d))


@query("E13_expression_graph", sql("assoc", f""", {STRONG}, e AS (SELECT DISTINCT study, supp, gene, log2fc, adj_p FROM strong)
  SELECT '{TYPE}' AS p, (SELECT count(DISTINCT gene) FROM e) + (SELECT count(*) FROM e) AS n, (SELECT count(DISTINCT gene) FROM e) + (SELECT count(*) FROM e) AS subjects, (count(*) > 0)::BIGINT * 2 AS objects FROM e
  UNION ALL SELECT '{SCHEMA}symbol', count(DISTINCT gene), count(DISTINCT gene), count(DISTINCT symbol) FROM strong UNION ALL SELECT '{REL}subject', count(*), count(*), count(DISTINCT study || '-' || supp) FROM e
  UNION ALL SELECT '{REL}predicate', count(*), count(*), count(DISTINCT log2fc > 0) FROM e UNION ALL SELECT '{REL}object', count(*), count(*), count(DISTINCT gene) FROM e UNION ALL SELECT '{SCHEMA}log2fc', count(*), count(*), count(DISTINCT log2fc) FROM e
  UNION ALL SELECT '{SCHEMA}adj_p', count(*), count(*), count(DISTINCT adj_p) FROM e UNION ALL SELECT '{SCHEMA}method', count(*), count(*), (count(*) > 0)::BIGINT FROM e"""))
def e13(spark, d):
    return _by_predicate(expression_part(spark, d))


@query("B07_gene_nodes", sql("assoc", f", {STRONG} SELECT DISTINCT '{NODE}gene/' || gene AS s, '{TYPE}' AS p, '{REL}Gene' AS o, true AS iri FROM strong UNION SELECT '{NODE}gene/' || gene, '{SCHEMA}symbol', symbol, false FROM strong"))
def b07(spark, d):
    return g.nodes(strongest(spark, d), _gene(), "Gene", {"symbol": "symbol"})


@query("B08_study_graph", sql("assoc", f""", {STUDIES}, {STRONG}, c AS (SELECT DISTINCT study, k, c_mktsegment AS v FROM customer JOIN st ON c_nationkey = k), a AS (SELECT study, s_suppkey, s_name FROM supplier JOIN st ON s_nationkey = k),
  x AS (SELECT DISTINCT study, supp, gene, log2fc, adj_p FROM strong), n AS (SELECT study, supp, label FROM strong GROUP BY ALL)
  SELECT 'Study' AS kind, count(*) AS n FROM st UNION ALL SELECT 'OrganismTaxon', count(DISTINCT taxon) FROM st UNION ALL SELECT 'Attribute', count(DISTINCT v) FROM c UNION ALL SELECT 'Assay', count(*) FROM a UNION ALL SELECT 'Gene', count(DISTINCT gene) FROM x
  UNION ALL SELECT 'Term', count(DISTINCT label) FROM n UNION ALL SELECT 'Association', (SELECT count(*) FROM x) + (SELECT count(*) FROM n)"""))
def b08(spark, d):
    whole = g.graph(study_nodes(spark, d), taxon_part(spark, d), attribute_part(spark, d), assay_part(spark, d), expression_part(spark, d), enrichment_part(spark, d))
    kinds = whole.where(F.col("p") == TYPE)
    return kinds.groupBy(F.substring_index("o", "/", -1).alias("kind")).agg(F.countDistinct("s").alias("n"))


def resolved(triples):
    """Triples with an association's node written as its ends and metrics, so that they can be held against others row by row."""
    name = lambda p: F.max(F.when(F.col("p") == p, F.col("o")))
    ends = [name(REL + x) for x in ("subject", "predicate", "object")] + [name(SCHEMA + m) for m in ("log2fc", "adj_p", "p_adj", "size")]
    names = triples.groupBy("s").agg(F.concat_ws("|", *ends).alias("name"), F.max(F.col("o") == REL + "Association").alias("association")).where("association")
    return triples.join(names.select("s", "name"), "s", "left").select(F.coalesce("name", "s").alias("s"), "p", "o", "iri")


def _facts(source: str, metrics: dict[str, str], key: str) -> str:
    """SQL of the triples of associations ``source(a, r, b, metrics)``."""
    names = [TYPE, REL + "subject", REL + "predicate", REL + "object", *(SCHEMA + m for m in metrics)]
    values = [f"'{REL}Association'", "a", "r", "b", *metrics.values()]
    kinds = ["true"] * 4 + ["false"] * len(metrics)
    listed = lambda x: "unnest([" + ", ".join(x) + "])"
    return f"SELECT {key} AS s, {listed(f"'{n}'" for n in names)} AS p, {listed(values)} AS o, {listed(kinds)} AS iri FROM {source}"


EXPRESSED = f"""x AS (SELECT DISTINCT '{NODE}assay/' || study || '-' || supp AS a, '{NODE}gene/' || gene AS b, '{REL}' || CASE WHEN log2fc > 0 THEN 'UPREGULATES' ELSE 'DOWNREGULATES' END AS r, log2fc::VARCHAR AS lfc, adj_p::VARCHAR AS p FROM strong)"""
ENRICHED = f"""y AS (SELECT '{NODE}assay/' || study || '-' || supp AS a, '{NODE}term/' || lower(label) AS b, '{REL}ENRICHED_IN' AS r, min(adj_p)::VARCHAR AS p, count(DISTINCT gene)::VARCHAR AS size FROM strong GROUP BY study, supp, label)"""
EXPRESSION_FACTS = _facts("x", {"log2fc": "lfc", "adj_p": "p", "method": "'limma'"}, "concat_ws('|', a, r, b, lfc, p)") + f" UNION SELECT '{NODE}gene/' || gene, unnest(['{TYPE}', '{SCHEMA}symbol']), unnest(['{REL}Gene', symbol]), unnest([true, false]) FROM strong"
ENRICHMENT_FACTS = _facts("y", {"p_adj": "p", "size": "size", "source": "'go'"}, "concat_ws('|', a, r, b, p, size)") + f" UNION SELECT '{NODE}term/' || lower(label), unnest(['{TYPE}', '{SCHEMA}name']), unnest(['{REL}Term', label]), unnest([true, false]) FROM strong"


@query("E13_expression_triples", sql("assoc", f", {STRONG}, {EXPRESSED} {EXPRESSION_FACTS}"))
def e13_triples(spark, d):
    return resolved(expression_part(spark, d))


@query("E12_enrichment_triples", sql("assoc", f", {STRONG}, {ENRICHED} {ENRICHMENT_FACTS}"))
def e12_triples(spark, d):
    return resolved(enrichment_part(spark, d))


@query("B08_study_triples", sql("assoc", f""", {STUDIES}, {STRONG}, {EXPRESSED}, {ENRICHED}, c AS (SELECT DISTINCT study, k, c_mktsegment AS v FROM customer JOIN st ON c_nationkey = k), a AS (SELECT study, s_suppkey, s_name, '{NODE}assay/' || study || '-' || s_suppkey AS s FROM supplier JOIN st ON s_nationkey = k)
  {EXPRESSION_FACTS} UNION {ENRICHMENT_FACTS}
  UNION SELECT '{NODE}study/' || study, unnest(['{TYPE}', '{SCHEMA}name', '{SCHEMA}title', '{SCHEMA}description']), unnest(['{REL}Study', study, title, description]), unnest([true, false, false, false]) FROM st
  UNION SELECT '{NODE}taxon/' || taxon, unnest(['{TYPE}', '{SCHEMA}identifier']), unnest(['{REL}OrganismTaxon', taxon]), unnest([true, false]) FROM st WHERE taxon IS NOT NULL UNION SELECT '{NODE}study/' || study, '{REL}IN_TAXON', '{NODE}taxon/' || taxon, true FROM st WHERE taxon IS NOT NULL
  UNION SELECT '{NODE}attribute/' || lower(v), unnest(['{TYPE}', '{SCHEMA}name']), unnest(['{REL}Attribute', v]), unnest([true, false]) FROM c UNION SELECT '{NODE}study/' || study, unnest(['{REL}HAS_ATTRIBUTE', '{REL}STUDIES']), unnest(['{NODE}attribute/' || lower(v), '{MONDO}' || lpad(k::VARCHAR, 7, '0')]), true FROM c
  UNION SELECT s, unnest(['{TYPE}', '{SCHEMA}name']), unnest(['{REL}Assay', s_name]), unnest([true, false]) FROM a UNION SELECT '{NODE}study/' || study, '{REL}HAS_OUTPUT', s, true FROM a"""))
def b08_triples(spark, d):
    """All triples of the graph."""
    # the parts say different things of a study, and each has nodes of its own
    return resolved(g.joined(study_nodes(spark, d), taxon_part(spark, d), attribute_part(spark, d), assay_part(spark, d), expression_part(spark, d), enrichment_part(spark, d)))


@query("E05_axioms", "SELECT * FROM (VALUES ('Class', 9::BIGINT), ('Property', 12), ('domain', 12), ('range', 12)) t(kind, n)")
def e05(spark, d):
    rows = g.axioms(spark)
    kind = F.when(F.col("p") == TYPE, F.regexp_extract("o", "[^/#]+$", 0)).otherwise(F.regexp_extract("p", "[^/#]+$", 0))
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("E03_property_map", f"SELECT doc_id, '{SCHEMA}' || p AS predicate, v AS value FROM (SELECT doc_id, unnest(['description', 'inLanguage', 'sameAs']) AS p, unnest([text, lang, source]) AS v FROM documents) WHERE v IS NOT NULL")
def e03(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.explode(F.create_map(F.lit("text"), "text", F.lit("lang"), "lang", F.lit("doi"), "source", F.lit("pmid"), F.col("doc_id").cast("string"), F.lit("other"), F.lit("x"))).alias("key", "value"))
    mapping = {"text": "description", "lang": "inLanguage", "doi": "sameAs", **dict.fromkeys(("pmid", "curatedBy"))}
    return g.mapped_properties(docs, "key", mapping).where("value is not null").select("doc_id", "predicate", "value")


@query("E14_incremental_batch", sql("assoc", " SELECT experiment, count(*) AS n FROM assoc WHERE substr(experiment, 8)::INTEGER % 3 <> 0 GROUP BY experiment"))
def e14(spark, d):
    """Two batches over the same experiments: the second takes those of which the first left no output."""
    rows = associations(spark, d)
    first = rows.where(F.substring("experiment", 8, 9).cast("int") % 3 == 0).groupBy("experiment").agg(F.count("*").alias("n"))
    first.write.parquet(path := scratch_path(spark, "batch"))
    return g.unfinished(rows, spark.read.parquet(path)).groupBy("experiment").agg(F.count("*").alias("n"))


@query("B04_experiment_assembly", f"WITH {STUDIES} SELECT study, title, min(trim(organism)) AS organism, count(DISTINCT s_suppkey) AS assays, count(DISTINCT c_custkey) AS samples FROM st LEFT JOIN supplier ON s_nationkey = k LEFT JOIN customer ON c_nationkey = k GROUP BY study, title")
def b04(spark, d):
    """One row for each experiment from its files' frames, each aggregated before it is joined."""
    s = studies(spark, d)
    assays = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("assays"))
    samples = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("samples"))
    out = s.join(assays, "k", "left").join(samples, "k", "left")
    return out.select("study", "title", F.trim("organism").alias("organism"), F.coalesce("assays", F.lit(0)).alias("assays"), F.coalesce("samples", F.lit(0)).alias("samples"))
