"""Queries over an ontology that is derived from the parts: terms, properties, restrictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindle.functions.lineage import stored
from spindle.operators.introspection import ALL, EQUIVALENT, LABEL, ON_PROPERTY, OWL, SOME, SUB_CLASS, SUB_PROPERTY, object_properties, property_closure, restrictions
from spindle.plans.registry import query
from spindle.sources.views import RDF_TYPE, read

TERM, PROPERTY = "https://data.example.org/term/", "https://data.example.org/property/"

#: Parts that the facts are made in.
PARTS = 64


def ontology(spark, d):
    """``s, p, o`` of terms below terms and below restrictions, and of 30 properties in three levels, some declared and named."""
    k = F.col("p_partkey")
    parts = read(spark, d, "part").select("p_partkey", "p_name")
    iri = lambda base, c: F.concat(F.lit(base), c)
    node, term, prop = iri("_:r", k), iri(TERM, k), iri(PROPERTY + "p", k % 25)
    fact = lambda s, p, o: F.struct(s.alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), o.alias("o"))
    group = iri(PROPERTY + "group", k % 5)
    facts = F.array(
        fact(term, SUB_CLASS, iri(TERM, F.floor(k / 10))),
        fact(term, F.when(k % 3 == 0, EQUIVALENT).otherwise(SUB_CLASS), node),
        fact(node, RDF_TYPE, F.lit(OWL + "Restriction")),
        fact(F.when(k % 4 != 1, node), ON_PROPERTY, prop),
        fact(node, F.when(k % 2 == 0, SOME).otherwise(ALL), iri(TERM, k % 100 + 1)),
        fact(prop, SUB_PROPERTY, group),
        fact(F.when(k % 5 < 3, group), SUB_PROPERTY, F.lit(PROPERTY + "root")),
        fact(F.when(k % 25 % 2 == 0, prop), RDF_TYPE, F.lit(OWL + "ObjectProperty")),
        fact(F.when(k % 25 % 2 == 0, prop), LABEL, iri("property ", k % 25)),
    )
    # a part gives nine facts and its row is small, so one task would read a large table and hold all its facts
    parts = parts.repartition(PARTS, "p_partkey")
    return stored(parts.select(F.inline(facts)).where("s is not null").distinct(), "ontology")


#: The same in SQL: restrictions r, the property hierarchy e and its closure above.
ONTOLOGY = f"""WITH RECURSIVE r AS (SELECT '{TERM}' || p_partkey AS class, '{PROPERTY}p' || (p_partkey % 25) AS property, '{TERM}' || (p_partkey % 100 + 1) AS filler, CASE WHEN p_partkey % 2 = 0 THEN 'some' ELSE 'all' END AS quantifier FROM part WHERE p_partkey % 4 <> 1),
  e AS (SELECT DISTINCT '{PROPERTY}p' || (p_partkey % 25) AS child, '{PROPERTY}group' || (p_partkey % 5) AS parent FROM part UNION SELECT DISTINCT '{PROPERTY}group' || (p_partkey % 5), '{PROPERTY}root' FROM part WHERE p_partkey % 5 < 3),
  up AS (SELECT child AS property, child AS above FROM e UNION SELECT parent, parent FROM e UNION SELECT up.property, e.parent FROM up JOIN e ON up.above = e.child)"""


@query("A12_restrictions", ONTOLOGY + " SELECT * FROM r")
def a12_restrictions(spark, d):
    return restrictions(ontology(spark, d), TERM)


@query("A12_property_closure", ONTOLOGY + " SELECT property, above FROM up")
def a12_closure(spark, d):
    return property_closure(ontology(spark, d))


@query("A12_object_properties", ONTOLOGY + f""", d AS (SELECT DISTINCT '{PROPERTY}p' || (p_partkey % 25) AS property, 'property ' || (p_partkey % 25) AS label FROM part WHERE p_partkey % 25 % 2 = 0),
  every AS (SELECT property FROM d UNION SELECT property FROM r UNION SELECT property FROM up)
  SELECT property, label, d.property IS NOT NULL AS declared, (SELECT count(*) FROM r WHERE r.property = every.property) AS n_restrictions, (SELECT count(DISTINCT class) FROM r JOIN up ON r.property = up.property WHERE up.above = every.property) AS n_classes,
  (SELECT count(*) FROM up WHERE up.above = every.property) - 1 AS n_below FROM every LEFT JOIN d USING (property)""")
def a12_properties(spark, d):
    return object_properties(ontology(spark, d), TERM)
