"""Queries that write graph files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindle.functions.lineage import scratch_path
from spindle.plans.catalogue import UNION_PARTS
from spindle.plans.registry import query
from spindle.sources.graphs import read_graph, read_turtle, write_graph
from spindle.sources.views import RDF_TYPE, SCHEMA, read, sql, triples

#: Types, names and conditions of the catalogue, and the texts of all documents as literals.
GRAPH = sql("cat", f""", graph AS (SELECT dataset AS s, '{RDF_TYPE}' AS p, '{SCHEMA}Dataset' AS o, true AS iri FROM cat UNION SELECT dataset, '{SCHEMA}name', name, false FROM cat
  UNION SELECT dataset, '{SCHEMA}healthCondition', condition, true FROM cat UNION SELECT 'https://data.example.org/doc/' || doc_id, '{SCHEMA}text', text, false FROM documents WHERE text IS NOT NULL)""")
ROWS = " SELECT s, p, CASE WHEN length(o) > 200 THEN md5(o) ELSE o END AS o, iri FROM graph"


def _graph(spark, d):
    # the writers make triples distinct
    facts = triples(spark, d, only=(RDF_TYPE, "healthCondition", "name"), datasets=True, repeated=True)
    texts = read(spark, d, "documents").where("text is not null")
    return facts.unionByName(texts.select(F.concat(F.lit("https://data.example.org/doc/"), "doc_id").alias("s"), F.lit(SCHEMA + "text").alias("p"), F.col("text").alias("o"), F.lit(False).alias("iri")))


def _there_and_back(spark, d, ending: str):
    write_graph(_graph(spark, d), path := scratch_path(spark, "graph") + ending)
    return digested(read_graph(spark, path, repeated=True).where("bad is null"))


def digested(found):
    """The distinct triples, long literals by their digest."""
    long = F.length("o") > 200
    shown = F.when(long, F.md5(F.col("o").cast("binary"))).otherwise(F.col("o"))
    # texts are equal where two digests are, so they need not be sent; a short text that reads like a digest stays another one
    sent = found.select("s", "p", shown.alias("o"), "iri", F.when(long, F.xxhash64("o")).alias("other"))
    return sent.repartition(UNION_PARTS, "s").distinct().drop("other")


@query("S18_turtle_round_trip", GRAPH + ROWS)
def s18_turtle(spark, d):
    """All triples as Turtle files, read again; long literals by their digest."""
    return _there_and_back(spark, d, ".ttl")


@query("K02_json_ld_round_trip", GRAPH + ROWS)
def k02_json_ld(spark, d):
    return _there_and_back(spark, d, ".jsonld")


@query("K02_rdf_xml_round_trip", GRAPH + ROWS)
def k02_rdf_xml(spark, d):
    return _there_and_back(spark, d, ".rdf")


@query("S18_broken_turtle", "SELECT count(*) FILTER (WHERE s_suppkey % 5 <> 2) * 2 AS triples, count(*) FILTER (WHERE s_suppkey % 5 = 2) AS bad FROM supplier")
def s18_broken(spark, d):
    """Statements with prefixes, lists of objects and comments; every fifth lacks its object."""
    s = read(spark, d, "supplier")
    obj = F.when(F.col("s_suppkey") % 5 == 2, ";").otherwise(F.concat(F.lit('"""'), "s_name", F.lit('"""@en , "x"^^<http://www.w3.org/2001/XMLSchema#string>')))
    block = F.concat(F.lit("@prefix ex: <https://data.example.org/> . # one supplier\nex:s"), "s_suppkey", F.lit(" ex:name "), obj, F.lit(" .\nPREFIX e: <https://e.example.org/>"))
    s.select(block.alias("value")).write.text(path := scratch_path(spark, "broken") + ".ttl")
    rows = read_turtle(spark, path)
    return rows.agg(F.count("s").alias("triples"), F.sum("bad").alias("bad"))
