"""Graph files: Turtle's forms, and round trips of all formats."""

from __future__ import annotations

import json
from xml.etree import ElementTree

import pytest

from spindle.sources.graphs import RDF, Turtle, graph_format, json_ld, parse_json_ld, read_graph, read_rdf_xml, read_turtle, write_graph
from spindle.sources.views import RDF_TYPE, SCHEMA

DOCUMENT = r"""
# a comment with <an> "odd" . part
@prefix ex: <http://ex.org/> .
PREFIX : <http://d.org/>
@base <http://base.org/> .
ex:a a ex:T , :U ; ex:name "plain", 'single', "tag"@en-GB, "1"^^ex:int ; ; ex:n 12 , -1.5e3 , .5, true .
<rel> ex:long '''two
lines with ''quotes'' and "more" ''' .
ex:b ex:has [ ex:in "x" ; ex:deep [ ex:in "y" ] ] , [] .
[ ex:self ex:a ] .
ex:c ex:list ( ex:a "z" ) .
ex:p%20q ex:with\,comma ex:a.b .
_:n1 ex:to _:n1 .
ex:d ex:esc "tab\t quote\" é \U0001F642 back\\" .
ex:bad ex:name ;
ex:lost "half .
ex:e ex:ok "still read" .
unknown:x ex:y ex:z .
ex:f ex:ok "last".
"""


def plain(document, name="f"):
    turtle = Turtle(document, name)
    return list(turtle.triples()), turtle


def test_forms_of_turtle():
    found, turtle = plain(DOCUMENT)
    ex = "http://ex.org/"
    known = {t for t in found if not t[0].startswith("_:") and not t[2].startswith("_:")}
    names = {"plain", "single", "tag", "1"}
    want = {(ex + "a", RDF_TYPE, ex + "T", True), (ex + "a", RDF_TYPE, "http://d.org/U", True)} | {(ex + "a", ex + "name", n, False) for n in names}
    want |= {(ex + "a", ex + "n", n, False) for n in ("12", "-1.5e3", ".5", "true")}
    want |= {("http://base.org/rel", ex + "long", "two\nlines with ''quotes'' and \"more\" ", False), (ex + "p%20q", ex + "with,comma", ex + "a.b", True)}
    want |= {(ex + "d", ex + "esc", 'tab\t quote" é 🙂 back\\', False), (ex + "e", ex + "ok", "still read", False), (ex + "f", ex + "ok", "last", False)}
    assert known == want
    # the statement without object takes the next one with it; the unknown prefix is another one
    assert turtle.bad == 2
    blank = [t for t in found if t not in known]
    assert {(p, o) for s, p, o, _ in blank if o in ("x", "y", "z")} == {(ex + "in", "x"), (ex + "in", "y"), (RDF + "first", "z")}
    (deep,) = [o for _, p, o, _ in blank if p == ex + "deep"]
    assert [o for s, p, o, _ in blank if s == deep] == ["y"]
    (head,) = [o for s, p, o, _ in blank if p == ex + "list"]
    rest = {s: o for s, p, o, _ in blank if p == RDF + "rest"}
    assert rest[rest[head]] == RDF + "nil"
    loops = [t for t in blank if t[0] == t[2]]
    assert len(loops) == 1 and loops[0] != next(t for t in plain(DOCUMENT, "g")[0] if t[0] == t[2])


@pytest.mark.parametrize("text", ["", "# only a comment", "@prefix a: <http://a/> ."])
def test_documents_without_triples(text):
    found, turtle = plain(text)
    assert (found, turtle.bad) == ([], 0)


@pytest.mark.parametrize("text", ["<http://a/b> <http://a/c> .", '"x" <http://a/c> "y" .', "<http://a/b>", "(", "[ <http://a/b> ", '<http://a/b> <http://a/c> "\\x" .', "<http://a/b> <http://a/c> (", "a:b"])
def test_broken_documents_end(text):
    found, turtle = plain(text)
    assert found == [] and turtle.bad == 1


ROWS = [
    ("http://ex.org/a", RDF_TYPE, SCHEMA + "Dataset", True),
    ("http://ex.org/a", RDF_TYPE, "http://other.org/T", True),
    ("http://ex.org/a", RDF_TYPE, "a literal as type", False),
    ("http://ex.org/a", SCHEMA + "name", 'quotes " and \\ back \t tab \n line \r\n <tag> & amp; \'', False),
    ("http://ex.org/a", SCHEMA + "name", "", False),
    ("http://ex.org/a", SCHEMA + "name", "http://looks.like/iri", False),
    ("http://ex.org/a", SCHEMA + "name", "http://ex.org/b", True),
    ("http://ex.org/b?x=1&y=2", SCHEMA + "text", "中文 é 🙂 [1] {x}", False),
    ("http://ex.org/b?x=1&y=2", SCHEMA + "text", "  spaces  ", False),
    ("http://ex.org/c", "http://ex.org/ns#p1", "[not a list]", False),
]


@pytest.mark.parametrize("ending", ["nt", "ttl", "jsonld", "rdf"])
def test_round_trips(spark, tmp_path, ending):
    frame = spark.createDataFrame([*ROWS, ROWS[0]], "s string, p string, o string, iri boolean")
    path = (tmp_path / f"graph.{ending}").as_uri()
    write_graph(frame.repartition(2), path)
    back = read_graph(spark, path).collect()
    assert sorted((r.s, r.p, r.o, r.iri) for r in back if r.bad is None) == sorted(ROWS)
    assert not any(r.bad for r in back)
    write_graph(frame.limit(0), path)
    assert read_graph(spark, path).collect() == []


def test_formats_by_extension():
    assert [graph_format(x) for x in ("a/b.ttl", "x.nt/", "x.JSONLD", "x.owl")] == ["turtle", "nt", "json-ld", "rdf-xml"]
    with pytest.raises(ValueError):
        graph_format("x.csv")


def test_json_ld_documents_are_json_with_a_context(spark):
    frame = spark.createDataFrame(ROWS, "s string, p string, o string, iri boolean")
    docs = {r.s: json.loads(r.line) for r in json_ld(frame).collect()}
    a = docs["http://ex.org/a"]
    assert a["@context"]["schema"] == SCHEMA and a["@type"] == ["http://other.org/T", SCHEMA + "Dataset"]
    assert {"@id": "http://ex.org/b"} in a["schema:name"] and {"@value": ""} in a["schema:name"]
    lines = spark.createDataFrame([("{broken",), ("",), ('{"x": 1}',), ('{"@id": "i", "p:q": "one", "r": [{"@id": "j"}], "@context": {"p": "http://p/"}}',)], "line string")
    got = {(r.s, r.p, r.o, r.iri, r.bad) for r in parse_json_ld(lines).collect()}
    assert got == {("i", "http://p/q", "one", False, None), ("i", "r", "j", True, None), (None, None, None, None, 2)}


def test_rdf_xml_typed_nodes_and_broken_files(spark, tmp_path):
    (tmp_path / "a.rdf").write_text(f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/"><e:T rdf:about="http://x"><e:p>v</e:p><e:q rdf:nodeID="n"/></e:T></rdf:RDF>')
    (tmp_path / "b.rdf").write_text("<broken")
    got = {(r.s, r.p, r.o, r.iri, r.bad) for r in read_rdf_xml(spark, f"file://{tmp_path}/*.rdf").collect()}
    assert got == {("http://x", RDF_TYPE, "http://e/T", True, None), ("http://x", "http://e/p", "v", False, None), ("http://x", "http://e/q", "_:n", True, None), (None, None, None, None, 1)}


def test_rdf_xml_control_characters_are_replaced(spark, tmp_path):
    frame = spark.createDataFrame([("http://x", "http://e/p", "a\x00b\x0bc", False)], "s string, p string, o string, iri boolean")
    path = (tmp_path / "c.rdf").as_uri()
    write_graph(frame, path)
    assert [r.o for r in read_graph(spark, path).collect()] == ["a�b�c"]
    files = [f for f in (tmp_path / "c.rdf").iterdir() if f.suffix == ".txt" and f.stat().st_size]
    assert all(ElementTree.parse(f).getroot().tag == f"{{{RDF}}}RDF" for f in files)


def test_turtle_files_with_broken_statements(spark, tmp_path):
    (tmp_path / "one.ttl").write_text("@prefix e: <http://e/> . e:a e:b e:c . e:a e:b . e:d e:b e:c .")
    (tmp_path / "two.ttl").write_text("# a prefix of the other file\n<http://e/a> <http://e/b> <http://e/c> .")
    rows = read_turtle(spark, tmp_path.as_uri()).collect()
    assert sorted((r.s or "", r.o or "", r.bad) for r in rows) == [("", "", 1), ("http://e/a", "http://e/c", None), ("http://e/d", "http://e/c", None)]


def test_documents_of_bounded_size(spark, tmp_path):
    """A file ends after so many characters, so that the task that reads it holds no more."""
    from spindle.sources import graphs

    facts = spark.range(300).selectExpr("'https://e.example.org/' || id % 3 AS s", "'https://e.example.org/p' AS p", "'text ' || id AS o", "false AS iri").coalesce(1)
    documents = [r.value for r in graphs.rdf_xml(facts, most=5_000).collect()]
    assert len(documents) > 3 and all(len(x) < 6_000 and x.endswith("</rdf:RDF>") for x in documents)
    assert len(graphs.turtle_documents(facts.withColumn("s", graphs.F.concat("s", "o")), most=5_000).collect()) > 3
    for ending in ("rdf", "ttl"):
        graphs.write_graph(facts, path := (tmp_path / f"g.{ending}").as_uri())
        assert {tuple(r) for r in graphs.read_graph(spark, path).select("s", "p", "o", "iri").collect()} == {tuple(r) for r in facts.collect()}


LINES = [
    '{"@id": "a", "p": "[not a list]", "q": "{not an object}", "r": ["[1]", "{"]}',
    '{"@id": "b", "n": [1, 1.50, -2e3, true, false, null], "m": {"@value": 7.0}, "e": [], "x": {"y": 1}}',
    '{"@context": {"c": "http://c/", "name": "http://n/name", "v": 5}, "@id": "c:1", "c:l:m": "colon", "name": "term", "v:w": "odd", "d:e": {"@id": "f"}}',
    '{"@id": "d", "k": "one", "k": ["two", {"@id": "", "@value": "both"}], "@type": "T"}',
    '{"@id": "e", "k": "half \\ud83d, whole \\ud83d\\ude42", "nest": [[1, "x", {"a": null}]], "@type": ["T", "U", null]}',
    '{"@context": "http://far/", "@id": 12, "c:p": "far"}',
    "[1]", '"text"', "17", '{"@id": null}', '{"@id": "cut', "[" * 100_000, "   ", "{}",
]
FOUND = {
    ("a", "p", "[not a list]", False), ("a", "q", "{not an object}", False), ("a", "r", "[1]", False), ("a", "r", "{", False),
    *(("b", "n", x, False) for x in ("1", "1.50", "-2e3", "true", "false")), ("b", "m", "7.0", False),
    ("c:1", "http://c/l:m", "colon", False), ("c:1", "http://n/name", "term", False), ("c:1", "5w", "odd", False), ("c:1", "d:e", "f", True),
    ("d", "k", "one", False), ("d", "k", "two", False), ("d", "k", "", True), ("d", RDF_TYPE, "T", True),
    ("e", "k", "half �, whole 🙂", False), ("e", "nest", '[1,"x",{"a":null}]', False), ("e", RDF_TYPE, "T", True), ("e", RDF_TYPE, "U", True),
    ("12", "c:p", "far", False),
}


def test_json_ld_of_other_writers(spark):
    """Plain texts that look like lists or objects are texts; bad lines of all tasks are counted together."""
    lines = spark.createDataFrame([(x,) for x in LINES + LINES], "line string").repartitionByRange(4, "line")
    got = [tuple(r) for r in parse_json_ld(lines).collect()]
    assert {r[:4] for r in got if r[4] is None} == FOUND and len(got) == len(FOUND) + 1
    assert [r[4] for r in got if r[4] is not None] == [14]


def test_json_ld_sends_triples_once(spark):
    frame = spark.createDataFrame([*ROWS, *ROWS, ("http://ex.org/a", "schema:name", "", False)], "s string, p string, o string, iri boolean")
    count = lambda f: f._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    documents = json_ld(frame)
    assert count(documents) == 1 and count(parse_json_ld(documents)) == 2
    a = json.loads({r.s: r.line for r in documents.collect()}["http://ex.org/a"])
    # two predicates that one key stands for have their values once
    assert list(a) == ["@context", "@id", "@type", "rdf:type", "schema:name"]
    assert a["schema:name"] == [{"@value": x} for x in sorted(r[2] for r in ROWS if r[1] == SCHEMA + "name" and not r[3])] + [{"@id": "http://ex.org/b"}]


def test_long_literals_are_sent_as_digests(spark):
    from hashlib import md5

    from spindle.plans.graph_files import digested

    long, digest = "é" * 201, md5(("é" * 201).encode()).hexdigest()
    rows = [("a", "p", long, False), ("a", "p", long, False), ("a", "p", digest, False), ("a", "p", "é" * 200, False), ("a", "p", "é" * 200, True), ("b", "p", long, False)]
    frame = digested(spark.createDataFrame(rows, "s string, p string, o string, iri boolean"))
    # before it is run, as the plan of a run holds two
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, frame.collect())) == sorted([("a", "p", digest, False)] * 2 + [("a", "p", "é" * 200, False), ("a", "p", "é" * 200, True), ("b", "p", digest, False)])
    # digests are made below the one exchange, and a task that reads files holds no triples
    assert plan.count("Exchange ") == 1 and plan.index("Exchange hashpartitioning(s#") < plan.index("md5(")
    assert "HashAggregate" not in plan[plan.index("Exchange ") :]
