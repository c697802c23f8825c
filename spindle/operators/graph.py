"""Graph patterns as joins over a triple table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions.lineage import cut

Pattern = tuple[str, str | tuple[str, ...], str]


def match(triples: DataFrame, patterns: Iterable[Pattern]) -> DataFrame:
    """Rows of variable bindings that satisfy all ``patterns`` (subject, predicate, object).

    Terms that begin with ``?`` are variables; a tuple of predicates is an
    alternation. Each pattern is a filtered scan, patterns that share variables
    are equi-joined, and the optimizer orders the joins. Bag semantics: apply
    ``distinct`` where the query asks for it. Patterns that share no variable
    with those before are refused, as they would be a product.
    """
    out: DataFrame | None = None
    for pattern in patterns:
        one = _scan(triples, pattern)
        if out is None:
            out = one
            continue
        shared = [c for c in one.columns if c in out.columns]
        if not shared:
            raise ValueError(f"{pattern} shares no variable with the patterns before it")
        out = out.join(one, shared)
    if out is None:
        raise ValueError("no patterns")
    return out


def optional(rows: DataFrame, triples: DataFrame, patterns: Iterable[Pattern], where: Column | str | None = None) -> DataFrame:
    """Left join with the bindings of ``patterns``; a condition on them belongs to the match, not to the rows."""
    found = match(triples, patterns)
    if where is not None:
        found = found.where(where)
    shared = [c for c in found.columns if c in rows.columns]
    if not shared:
        raise ValueError("the optional part shares no variable with the rows")
    return rows.join(found, shared, "left")


def _scan(triples: DataFrame, pattern: Pattern) -> DataFrame:
    s, p, o = pattern
    rows = triples.where(F.col("p").isin(*p) if isinstance(p, tuple) else F.col("p") == p) if not (isinstance(p, str) and p.startswith("?")) else triples
    names: dict[str, str] = {}
    for place, term in (("s", s), ("p", p), ("o", o)):
        if isinstance(term, str) and term.startswith("?"):
            if term[1:] in names:
                rows = rows.where(F.col(place) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = place
        elif place != "p":
            rows = rows.where(F.col(place) == term)
    return rows.select(*(F.col(place).alias(name) for name, place in names.items()))


def closure(edges: DataFrame, starts: DataFrame, most: int = 64) -> DataFrame:
    """``start, node``: every node reachable from ``starts(node)`` over ``edges(child, parent)``, itself included.

    One semi-naive step per level: only pairs that the last step found are
    joined again, and pairs already known are taken out, so that cycles end.
    Beyond ``most`` levels an error is raised rather than a part returned.
    """
    known = starts.select(F.col("node").alias("start"), "node").distinct()
    new = known
    for _ in range(most):
        step = new.join(edges, new.node == edges.child).select("start", F.col("parent").alias("node")).distinct()
        new = cut(step.join(known, ["start", "node"], "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    raise RuntimeError(f"the hierarchy is deeper than {most} levels")


def neighbourhood(triples: DataFrame, node: Column | str, names: str) -> DataFrame:
    """``direction, predicate, other, label``: all edges from and to a node, with the other end's name if any."""
    out = triples.where(F.col("s") == node).select(F.lit("out").alias("direction"), F.col("p").alias("predicate"), F.col("o").alias("other"))
    into = triples.where(F.col("o") == node).select(F.lit("in").alias("direction"), F.col("p").alias("predicate"), F.col("s").alias("other"))
    label = triples.where(F.col("p") == names).groupBy(F.col("s").alias("other")).agg(F.min("o").alias("label"))
    return out.unionByName(into).join(label, "other", "left").select("direction", "predicate", "other", "label").distinct()
