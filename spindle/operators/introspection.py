"""What an ontology says about its properties: restrictions through blank nodes, and the property hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.operators.graph import closure, match
from spindle.sources.views import RDF_TYPE

# Terms of the public vocabularies.
OWL, RDFS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#"
SUB_CLASS, EQUIVALENT, SUB_PROPERTY, LABEL = RDFS + "subClassOf", OWL + "equivalentClass", RDFS + "subPropertyOf", RDFS + "label"
ON_PROPERTY, SOME, ALL = OWL + "onProperty", OWL + "someValuesFrom", OWL + "allValuesFrom"


def restrictions(triples: DataFrame, prefix: str = "") -> DataFrame:
    """``class, property, filler, quantifier``: what classes (whose IRI begins with ``prefix``) say of a property's values.

    A restriction is a node that a class is below, or equal to, with a property
    and the class of some or all of its values. A node with several properties
    or classes gives each combination, as a pattern does.
    """
    found = match(triples, [("?class", (SUB_CLASS, EQUIVALENT), "?node"), ("?node", ON_PROPERTY, "?property"), ("?node", "?how", "?filler")])
    found = found.where(F.col("how").isin(SOME, ALL) & F.col("class").startswith(prefix))
    return found.select("class", "property", "filler", F.when(F.col("how") == SOME, "some").otherwise("all").alias("quantifier")).distinct()


def property_closure(triples: DataFrame) -> DataFrame:
    """``property, above``: every property of the hierarchy with all that it is below, itself included; cycles end."""
    edges = match(triples, [("?child", SUB_PROPERTY, "?parent")]).distinct()
    ends = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node")))
    return closure(edges, ends.distinct()).select(F.col("start").alias("property"), F.col("node").alias("above"))


def object_properties(triples: DataFrame, prefix: str = "") -> DataFrame:
    """``property, label, declared, n_restrictions, n_classes, n_below``: all properties that are declared, restricted or in the hierarchy.

    ``label`` is the first by text; ``n_below`` counts the properties below,
    over all levels, ``n_classes`` the classes that restrict the property or
    one below it.
    """
    declared = match(triples, [("?property", RDF_TYPE, OWL + "ObjectProperty")]).distinct().withColumn("declared", F.lit(True))
    used = restrictions(triples, prefix)
    above = property_closure(triples)
    below = above.groupBy(F.col("above").alias("property")).agg((F.count("*") - 1).alias("n_below"))
    own = used.groupBy("property").agg(F.count("*").alias("n_restrictions"))
    # a class counts for the property and for all above it
    spread = used.select("class", "property").distinct().join(above, "property", "left").select("class", F.coalesce("above", "property").alias("property"))
    classes = spread.groupBy("property").agg(F.count_distinct("class").alias("n_classes"))
    names = match(triples, [("?property", LABEL, "?label")]).groupBy("property").agg(F.min("label").alias("label"))
    every = declared.select("property").unionByName(own.select("property")).unionByName(below.select("property")).distinct()
    out = every
    for part in (names, declared, own, classes, below):
        out = out.join(part, "property", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("property", "label", F.coalesce("declared", F.lit(False)).alias("declared"), zero("n_restrictions"), zero("n_classes"), zero("n_below"))
