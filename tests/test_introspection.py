"""Restrictions and property hierarchies on a small ontology with cycles and incomplete nodes."""

from __future__ import annotations

from spindle.operators.introspection import ALL, EQUIVALENT, LABEL, ON_PROPERTY, OWL, SOME, SUB_CLASS, SUB_PROPERTY, object_properties, property_closure, restrictions
from spindle.sources.views import RDF_TYPE

TRIPLES = [
    ("c:1", SUB_CLASS, "_:a"), ("_:a", ON_PROPERTY, "p:in"), ("_:a", SOME, "c:9"),
    ("c:2", EQUIVALENT, "_:b"), ("_:b", ON_PROPERTY, "p:in"), ("_:b", ALL, "c:8"), ("_:b", SOME, "c:7"),
    ("c:3", SUB_CLASS, "_:c"), ("_:c", ON_PROPERTY, "p:no-filler"), ("c:4", SUB_CLASS, "c:1"), ("_:d", SOME, "c:1"), ("x:1", SUB_CLASS, "_:a"), ("c:1", SUB_CLASS, "_:a"),
    ("p:in", SUB_PROPERTY, "p:near"), ("p:near", SUB_PROPERTY, "p:top"), ("p:x", SUB_PROPERTY, "p:y"), ("p:y", SUB_PROPERTY, "p:x"),
    ("p:only", RDF_TYPE, OWL + "ObjectProperty"), ("p:in", RDF_TYPE, OWL + "ObjectProperty"), ("p:in", LABEL, "within"), ("p:in", LABEL, "in"), ("c:1", LABEL, "one"),
]


def test_restrictions_and_hierarchy(spark):
    t = spark.createDataFrame(TRIPLES, "s string, p string, o string")
    got = {(r["class"], r.property, r.filler, r.quantifier) for r in restrictions(t).collect()}
    assert got == {("c:1", "p:in", "c:9", "some"), ("c:2", "p:in", "c:8", "all"), ("c:2", "p:in", "c:7", "some"), ("x:1", "p:in", "c:9", "some")}
    assert {r["class"] for r in restrictions(t, "c:").collect()} == {"c:1", "c:2"}
    above = {(r.property, r.above) for r in property_closure(t).collect()}
    assert above == {("p:in", "p:in"), ("p:in", "p:near"), ("p:in", "p:top"), ("p:near", "p:near"), ("p:near", "p:top"), ("p:top", "p:top"), ("p:x", "p:x"), ("p:x", "p:y"), ("p:y", "p:y"), ("p:y", "p:x")}
    rows = {r.property: tuple(r)[1:] for r in object_properties(t, "c:").collect()}
    assert rows == {
        "p:in": ("in", True, 3, 2, 0), "p:near": (None, False, 0, 2, 1), "p:top": (None, False, 0, 2, 2), "p:x": (None, False, 0, 0, 1), "p:y": (None, False, 0, 0, 1), "p:only": (None, True, 0, 0, 0),
    }


def test_an_empty_ontology(spark):
    t = spark.createDataFrame([], "s string, p string, o string")
    assert restrictions(t).collect() == [] and object_properties(t).collect() == []


def test_facts_are_made_in_many_parts(spark, sf_dir, monkeypatch):
    """A part's row is small and gives nine facts, so the scan's few tasks would hold all facts."""
    from spindle.plans import introspection

    monkeypatch.setattr(introspection, "stored", lambda df, name: df)
    plan = introspection.ontology(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [p_partkey" in plan and plan.index("Generate") < plan.index("RepartitionByExpression")
