"""Logical views of the library over the relational tables.

The library works on associations, a catalogue graph, samples, expression
values and cells. Where an installation has those as tables of its own, the
operators take them directly; these views derive them from a star schema.
Each view selects only what it needs, so that scans stay narrow.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATLAS = "https://data.example.org/atlas/"
DATASET = "https://data.example.org/dataset/"
GRANT = "https://data.example.org/grant/"
PERSON = "https://data.example.org/person/"
AGENT = "https://data.example.org/agent/"
# Public namespaces.
SCHEMA = "http://schema.org/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
MONDO = "http://purl.obolibrary.org/obo/MONDO_"
TAXON = "https://www.uniprot.org/taxonomy/"
ROR = "https://ror.org/"
DOI = "https://doi.org/"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contrast, experiment, gene, symbol, log2fc, adj_p, label, taxon, array_design``: one row per association."""
    line = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_type", "p_brand")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    joined = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)
    fold = F.round(F.log2(F.col("l_extendedprice") / (F.col("l_quantity") * F.col("p_retailprice"))), 6) + F.lit(0.0)
    return joined.select(
        F.concat(F.lit(ATLAS + "E-GEOD-"), "s_nationkey", F.lit("-g"), "l_suppkey", F.lit("_g"), "l_linenumber").alias("contrast"),
        F.concat(F.lit("E-GEOD-"), "s_nationkey").alias("experiment"),
        F.col("l_partkey").alias("gene"),
        F.concat(F.lit("GENE"), "l_partkey").alias("symbol"),
        fold.alias("log2fc"),
        F.col("l_tax").alias("adj_p"),
        F.col("p_type").alias("label"),
        F.col("n_regionkey").alias("taxon"),
        F.col("p_brand").alias("array_design"),
    )


def experiment_of(contrast: str = "contrast"):
    """The experiment's accession inside a contrast IRI; the input where there is none."""
    return F.regexp_replace(contrast, "^.*/(E-[A-Z0-9-]+)-.*$", "$1")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per dataset of the catalogue, with the keys of what it refers to."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    resource = F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]+", "_"))
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .withColumn("dataset", F.concat(F.lit(DATASET), resource, F.lit("/"), "o_orderkey"))
    )


def _capital(c: str):
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(F.col(c), F.lit(2), F.length(c))))


def triples(spark: SparkSession, sf_dir: str, exploded: bool = False, only: Sequence[str] = (), datasets: bool = False, repeated: bool = False) -> DataFrame:
    """The catalogue graph: distinct ``s, p, o, iri`` (iri: the object is one).

    A branch for each kind of fact: a filter on the predicate leaves only the
    branches that hold it, each with the columns that it needs. ``exploded``
    makes all facts of a dataset in one pass, for queries over all predicates;
    with ``only``, a pass makes the facts of these predicates and no others,
    for queries that match several patterns. ``datasets`` leaves the facts whose
    subject is a dataset; ``repeated`` leaves copies of a triple, for callers
    that make them distinct together with others.
    """
    d = orders(spark, sf_dir)
    iri = lambda base, *c: F.concat(F.lit(base), *c)
    condition = iri(MONDO, F.lpad(F.col("c_nationkey").cast("string"), 7, "0"))
    taxon = iri(TAXON, F.col("n_regionkey"))
    grant = iri(GRANT, F.col("c_custkey") % 500)
    person = iri(PERSON, F.col("c_custkey"))
    org = iri(ROR + "org", F.col("c_nationkey"))
    funder = iri(ROR, F.lower("c_mktsegment"))
    agent = iri(AGENT, F.col("o_custkey") % 40)
    technique = iri(AGENT + "technique", F.col("o_orderkey") % 7)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    name = lambda s, text: (s, "name", text, False)
    s = F.col("dataset")
    facts = [
        (s, RDF_TYPE, F.lit(SCHEMA + "Dataset"), True),
        name(s, F.concat(F.lit("Dataset "), "o_orderkey", F.lit(" "), "o_orderstatus")),
        (s, "healthCondition", condition, True),
        name(condition, _capital("n_name")),
        (s, "species", taxon, True),
        name(taxon, _capital("r_name")),
        (s, "funding", grant, True),
        name(grant, F.concat(F.lit("Grant "), F.col("c_custkey") % 500)),
        (grant, "funder", funder, True),
        (s, "author", person, True),
        name(person, F.col("c_name")),
        (person, "affiliation", org, True),
        name(org, F.concat(F.lit("University of "), _capital("n_name"))),
        (s, "sameAs", F.when(F.col("o_orderkey") % 3 == 0, iri(DOI + "10.5555/", F.col("o_orderkey"))), False),
        (s, "dateModified", F.when(F.col("o_orderkey") % 4 != 0, day), False),
        (s, "datePublished", F.when(F.col("o_orderkey") % 5 != 0, F.date_format(F.date_sub("o_orderdate", 90), "yyyy-MM-dd")), False),
        (s, "infectiousAgent", agent, True),
        name(agent, F.concat(F.lit("Agent "), F.col("o_custkey") % 40)),
        (s, "url", F.concat(F.lit("https://data.example.org/view/"), "o_orderkey"), False),
        (s, "isAccessibleForFree", F.when(F.col("o_orderstatus") == "O", F.lit("true")), False),
        (s, "measurementTechnique", technique, True),
        name(technique, F.concat(F.lit("Technique "), F.col("o_orderkey") % 7)),
    ]
    facts = [(a, p if "://" in p else SCHEMA + p, o, kind) for a, p, o, kind in facts]
    if only:
        wanted = {p if "://" in p else SCHEMA + p for p in only}
        facts = [f for f in facts if f[1] in wanted]
    if datasets:
        facts = [f for f in facts if f[0] is s]
    one = (lambda frame: frame) if repeated else DataFrame.distinct
    if exploded or only:
        rows = [F.struct(a.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("iri")) for a, p, o, kind in facts]
        return one(d.select(F.inline(F.array(*rows))).where("o is not null"))
    parts = [d.select(a.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("iri")).where("o is not null") for a, p, o, kind in facts]
    return one(reduce(DataFrame.unionByName, parts))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample, series_id, title, platform, source_name``: series_id is a comma list of one or two series."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    series = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("GSE"), "source", F.lit(","), F.lit("GSE"), "lang")).otherwise(F.concat(F.lit("GSE"), "source"))
    return d.select(F.concat(F.lit("GSM"), "doc_id").alias("sample"), series.alias("series_id"), F.coalesce("text", F.lit("")).alias("title"), F.col("lang").alias("platform"), F.col("source").alias("source_name"))


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gene, sample, count, grp``: counts of 200 genes in 400 samples, long; even samples are the test group."""
    line = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_quantity")
    out = line.groupBy((F.col("l_partkey") % 200).alias("gene"), (F.col("l_orderkey") % 400).alias("sample")).agg(F.sum("l_quantity").cast("long").alias("count"))
    return out.withColumn("grp", F.when(F.col("sample") % 2 == 0, "test").otherwise("control"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell, cell_type, disease, dataset, value``: one expression value a cell."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    return e.select(
        F.col("event_id").alias("cell"), F.col("event_type").alias("cell_type"), F.when(F.col("user_id") % 2 == 0, "normal").otherwise("case").alias("disease"),
        (F.col("user_id") % 10).alias("dataset"), F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value")).alias("value"),
    )


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``child, parent``: a term hierarchy; a term's parent is its number divided by ten."""
    p = read(spark, sf_dir, "part").select("p_partkey")
    return p.select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 10).cast("long").alias("parent")).where("parent > 0").distinct()


#: The same views for the oracle.
SQL = {
    "assoc": f"""assoc AS (SELECT '{ATLAS}E-GEOD-' || s_nationkey || '-g' || l_suppkey || '_g' || l_linenumber AS contrast,
      'E-GEOD-' || s_nationkey AS experiment, l_partkey AS gene, 'GENE' || l_partkey AS symbol,
      round(log2(l_extendedprice / (l_quantity * p_retailprice)), 6) + 0.0 AS log2fc, l_tax AS adj_p, p_type AS label,
      n_regionkey AS taxon, p_brand AS array_design
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)""",
    "cat": f"""cat AS (SELECT *, '{DATASET}' || lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g')) || '/' || o_orderkey AS dataset,
      lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g')) AS resource, 'Dataset ' || o_orderkey || ' ' || o_orderstatus AS name,
      '{MONDO}' || lpad(c_nationkey::VARCHAR, 7, '0') AS condition, upper(n_name[1]) || lower(n_name[2:]) AS condition_name,
      '{TAXON}' || n_regionkey AS taxon, upper(r_name[1]) || lower(r_name[2:]) AS taxon_name, '{GRANT}' || (c_custkey % 500) AS grant_iri,
      'Grant ' || (c_custkey % 500) AS grant_name, '{ROR}' || lower(c_mktsegment) AS funder, '{AGENT}' || (o_custkey % 40) AS agent,
      'Agent ' || (o_custkey % 40) AS agent_name, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS modified,
      CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate - INTERVAL 90 DAY, '%Y-%m-%d') END AS published
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "samples": """samples AS (SELECT 'GSM' || doc_id AS sample, CASE WHEN doc_id % 3 = 0 THEN 'GSE' || source || ',GSE' || lang ELSE 'GSE' || source END AS series_id,
      coalesce(text, '') AS title, lang AS platform, source AS source_name FROM documents)""",
    "expr": """expr AS (SELECT l_partkey % 200 AS gene, l_orderkey % 400 AS sample, sum(l_quantity)::BIGINT AS count,
      CASE WHEN l_orderkey % 400 % 2 = 0 THEN 'test' ELSE 'control' END AS grp FROM lineitem GROUP BY ALL)""",
    "cells": """cells AS (SELECT event_id AS cell, event_type AS cell_type, CASE WHEN user_id % 2 = 0 THEN 'normal' ELSE 'case' END AS disease,
      user_id % 10 AS dataset, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE value END AS value FROM events)""",
    "hier": "hier AS (SELECT DISTINCT p_partkey AS child, (p_partkey // 10)::BIGINT AS parent FROM part WHERE p_partkey // 10 > 0)",
}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """Oracle SQL: the named views (space-separated), then ``body``, which may start with further CTEs after a comma."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(SQL[v] for v in views.split()) + body
