"""From the frames of expression studies to a graph of triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.sources.views import RDF_TYPE, SCHEMA

BASE = "https://data.example.org/node/"
RELATION = "https://data.example.org/relation/"
# Public names of taxa and their numbers in the NCBI taxonomy.
TAXA = {
    "mus musculus": "10090", "homo sapiens": "9606", "rattus norvegicus": "10116", "danio rerio": "7955",
    "drosophila melanogaster": "7227", "caenorhabditis elegans": "6239", "saccharomyces cerevisiae": "4932", "arabidopsis thaliana": "3702",
}
# Classes and properties of schema.org, with their domains and ranges.
CLASSES = ("Dataset", "Person", "Organization", "MonetaryGrant", "DefinedTerm", "DataCatalog", "DataDownload", "ScholarlyArticle", "ResearchProject")
PROPERTIES = {
    "name": ("Thing", "Text"), "description": ("Thing", "Text"), "url": ("Thing", "URL"), "identifier": ("Thing", "Text"), "dateModified": ("Thing", "DateTime"),
    "datePublished": ("Thing", "Date"), "author": ("Dataset", "Person"), "funding": ("Thing", "MonetaryGrant"), "funder": ("MonetaryGrant", "Organization"),
    "healthCondition": ("Dataset", "DefinedTerm"), "species": ("Dataset", "DefinedTerm"), "infectiousAgent": ("Dataset", "DefinedTerm"),
}


def taxon_of(organism: Column | str) -> Column:
    """The number of a taxon by its scientific name, in any case; null where it is not known."""
    name = F.lower(F.trim(organism))
    return F.coalesce(*(F.when(name == k, v) for k, v in TAXA.items()))


def node_iri(kind: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"{BASE}{kind}/"), F.concat_ws("-", *parts))


def _triple(s: Column, p: Column | str, o: Column, iri: bool) -> Column:
    p = F.lit(p) if isinstance(p, str) else p
    return F.struct(s.alias("s"), p.alias("p"), o.cast("string").alias("o"), F.lit(iri).alias("iri"))


def nodes(rows: DataFrame, iri: Column, kind: str, properties: dict[str, str]) -> DataFrame:
    """``s, p, o, iri``: a type and the non-empty properties (name -> column) of each row's node."""
    facts = [_triple(iri, RDF_TYPE, F.lit(RELATION + kind), True), *(_triple(iri, SCHEMA + name, F.col(column), False) for name, column in properties.items())]
    return rows.select(F.inline(F.array(*facts))).where("s is not null and o is not null and trim(o) <> ''").distinct()


def edges(rows: DataFrame, subject: Column, relation: str, obj: Column) -> DataFrame:
    """``s, p, o, iri``: a relation from each row's subject to its object."""
    return rows.select(F.inline(F.array(_triple(subject, RELATION + relation, obj, True)))).where("s is not null and o is not null").distinct()


def statements(rows: DataFrame, subject: Column, relation: str, obj: Column, metrics: list[str], sources: dict[str, str]) -> DataFrame:
    """``s, p, o, iri``: a node for each association, with its ends, its metrics and where it comes from.

    The node's id is a hash of both ends, the relation and the metrics, so that
    equal associations are one node.
    """
    own = rows.select(subject.alias("_s"), obj.alias("_o"), *metrics).where("_s is not null and _o is not null").distinct()
    iri = node_iri("association", F.substring(F.md5(F.to_json(F.struct("_s", F.lit(relation), "_o", *metrics)).cast("binary")), 1, 16))
    facts = [
        _triple(iri, RDF_TYPE, F.lit(RELATION + "Association"), True), _triple(iri, RELATION + "subject", F.col("_s"), True), _triple(iri, RELATION + "predicate", F.lit(RELATION + relation), True),
        _triple(iri, RELATION + "object", F.col("_o"), True), *(_triple(iri, SCHEMA + m, F.col(m), False) for m in metrics), *(_triple(iri, SCHEMA + k, F.lit(v), False) for k, v in sources.items()),
    ]
    return own.select(F.inline(F.array(*facts))).where("o is not null")


def axioms(spark) -> DataFrame:
    """``s, p, o, iri``: classes, and properties with their domains and ranges."""
    rdfs, rdf = "http://www.w3.org/2000/01/rdf-schema#", RDF_TYPE.removesuffix("type")
    rows = [(SCHEMA + c, RDF_TYPE, rdfs + "Class", True) for c in CLASSES]
    for name, (domain, range_) in PROPERTIES.items():
        rows += [(SCHEMA + name, RDF_TYPE, rdf + "Property", True), (SCHEMA + name, rdfs + "domain", SCHEMA + domain, True), (SCHEMA + name, rdfs + "range", SCHEMA + range_, True)]
    return spark.createDataFrame(rows, "s string, p string, o string, iri boolean")


def mapped_properties(rows: DataFrame, key: str, mapping: dict[str, str | None]) -> DataFrame:
    """Rows of a key that ``mapping`` knows, with ``predicate``; keys that map to None, and unknown ones, go."""
    predicate = F.coalesce(*(F.when(F.col(key) == k, SCHEMA + v) for k, v in mapping.items() if v is not None))
    return rows.withColumn("predicate", predicate).where("predicate is not null")


def unfinished(experiments: DataFrame, done: DataFrame) -> DataFrame:
    """Experiments of which no output is listed in ``done(experiment)``."""
    return experiments.join(done.select("experiment").distinct(), "experiment", "left_anti")


def graph(*parts: DataFrame) -> DataFrame:
    """The distinct triples of all parts."""
    return reduce(DataFrame.unionByName, parts).distinct()


def joined(*parts: DataFrame) -> DataFrame:
    """All triples of parts of which each is distinct and none shares a triple with another, so that none need be held or sent to tell equal ones."""
    return reduce(DataFrame.unionByName, parts)
