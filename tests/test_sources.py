"""Archive files, catalogue records and sinks on small files."""

from __future__ import annotations

import json

from spindle.operators.etl import parse_n_triples
from spindle.sources import atlas_files as atlas
from spindle.sources import records, sinks
from spindle.sources.views import RDF_TYPE, SCHEMA

CONFIG = """<configuration experimentType="x"><analytics><array_design> A-1 </array_design>
<assay_groups><assay_group id="g1" label="normal"><assay>S1</assay><assay>S2</assay></assay_group><assay_group id="g2" label="sick"><assay>S3</assay></assay_group></assay_groups>
<contrasts><contrast id="g1_g2"><name>'sick' vs 'normal'</name><reference_assay_group>g1</reference_assay_group><test_assay_group>g2</test_assay_group></contrast></contrasts></analytics></configuration>"""


def test_archive_files(spark, tmp_path):
    d = tmp_path.as_uri()
    (tmp_path / "E-GEOD-5.idf.txt").write_text("Investigation Title\tA study\nPubMed ID\t1\t\t2\n\nPubMed ID\t3\nEmpty\t\n")
    (tmp_path / "E-GEOD-5.condensed-sdrf.tsv").write_text("E-GEOD-5\t\tS1\tfactor\tdisease\tnormal\t\nE-GEOD-5\t\tS3\tfactor\tdisease\tit's bad\thttp://x/1 http://x/2\nE-GEOD-5\t\tS3\tcharacteristic\tage\t7\t\n")
    (tmp_path / "E-GEOD-5-configuration.xml").write_text(CONFIG)
    header = "Gene ID\tGene Name\tDesign Element\tg1_g2.p-value\tg1_g2.t-statistic\tg1_g2.log2foldchange"
    (tmp_path / "E-GEOD-5_A-1-analytics.tsv").write_text(f"{header}\nENSG1\tA\tx\t0.01\t2\t1.5\nENSG2\tB\tx\tNA\tNA\tNA\nENSG3\t\tx\t0.5\t0.1\t-0.2\n")
    (tmp_path / "E-GEOD-5_A-1-analytics.tsv.undecorated").write_text(f"{header}\nENSG9\tA\tx\t0\t0\t0\n")
    (tmp_path / "E-GEOD-5.g1_g2.go.gsea.tsv").write_text("Term\tAccession\tGenes (tot)\tp adj (non-dir.)\teffect.size\nGO:1\tcell death\t12\t0.02\t1.5\nGO:2\tgrowth\t9\tNA\t\n")
    idf = {r.key: r["values"] for r in atlas.idf(spark, f"{d}/*.idf.txt").collect()}
    assert idf == {"Investigation Title": ["A study"], "PubMed ID": ["1", "2", "3"]}
    sdrf = atlas.condensed_sdrf(spark, f"{d}/*.condensed-sdrf.tsv")
    assert sorted((r.sample, r.iri) for r in atlas.characteristics(sdrf).collect()) == [("S1", "https://data.example.org/value/normal"), ("S3", "http://x/1"), ("S3", "http://x/2")]
    config = atlas.configuration(spark, f"{d}/*-configuration.xml")
    groups, contrasts = atlas.assay_groups(config), atlas.contrasts(config)
    assert sorted((r.group_id, r.sample) for r in groups.collect()) == [("g1", "S1"), ("g1", "S2"), ("g2", "S3")]
    assert [(r.experiment, r.array_design, r.contrast, r.reference_group, r.test_group) for r in contrasts.collect()] == [("E-GEOD-5", "A-1", "g1_g2", "g1", "g2")]
    assert sorted((r.side, r.value) for r in atlas.contrast_factors(contrasts, groups, sdrf).collect()) == [("reference", "normal"), ("test", "it's bad")]
    rows = atlas.analytics(spark, f"{d}/*analytics.tsv*")
    assert sorted((r.gene_id, r.contrast, r.p_value, r.log2fc) for r in rows.collect()) == [("ENSG1", "g1_g2", 0.01, 1.5), ("ENSG3", "g1_g2", 0.5, -0.2)]
    assert [r.gene_id for r in atlas.top_per_contrast(rows, ["experiment", "contrast"], "p_value", "gene_id", 1).collect()] == ["ENSG1"]
    terms = {r.term_id: r for r in atlas.enrichment(spark, f"{d}/*.gsea.tsv").collect()}
    assert terms["GO:1"].contrast == "g1_g2"
    assert terms["GO:1"].source == "go"
    assert terms["GO:2"].p_adj is None


def test_factors_of_a_contrast_in_many_designs_are_joined_once(spark):
    """A contrast that each of 40 designs names meets the samples of all of them once, not 40 times."""
    contrasts = spark.range(40).selectExpr("'E-A-1' AS experiment", "'A-' || id AS array_design", "'g1_g2' AS contrast", "'x' AS name", "'g1' AS reference_group", "'g2' AS test_group")
    groups = spark.range(400).selectExpr("'E-A-1' AS experiment", "'A-' || id % 40 AS array_design", "'g' || (1 + id % 2) AS group_id", "'S' || id AS sample")
    sdrf = spark.range(400).selectExpr("'E-A-1' AS accession", "'S' || id AS sample", "'factor' AS kind", "'disease' AS name", "'v' || id % 4 AS value")
    out = atlas.contrast_factors(contrasts, groups, sdrf)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.side, r.value) for r in out.collect()) == [("reference", "v0"), ("reference", "v2"), ("test", "v1"), ("test", "v3")]
    # the ends of a contrast are distinct before the samples are joined
    assert plan.count("Aggregate") == 2


def test_records_to_triples(spark, tmp_path):
    lines = [
        {"_id": "a b", "name": "One", "healthCondition": {"name": "flu", "url": "http://x/MONDO_1"}, "species": [{"name": "Homo sapiens", "identifier": "https://t/9606"}, "mouse"],
         "author": [{"name": "Ann Lee", "affiliation": {"name": "Uni"}}, "Bo"], "funding": {"name": "G 1", "funder": "NIH"}, "doi": ["10.1/x"], "url": "http://u"},
        {"_id": "a b", "name": "One"}, {"name": "no id"}, {"_id": "c", "name": 7, "healthCondition": []},
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\nnot json\n")
    rows = records.read_records(spark, tmp_path.as_uri())
    facts = records.coverage(rows).first()
    assert (facts.total, facts.bad, facts.with_condition, facts.with_species, facts.with_agent) == (5, 1, 1, 1, 0)
    got = {(r.s, r.p.removeprefix(SCHEMA), r.o) for r in records.to_triples(rows, "demo").collect()}
    base = "https://data.example.org/"
    one = base + "dataset/demo/a+b"
    assert {(base + "dataset/demo/c", "name", "7"), (base + "dataset/demo/c", RDF_TYPE, SCHEMA + "Dataset")} <= got
    if (one, "healthCondition", "http://x/MONDO_1") in got:
        assert {
            (one, "species", "https://t/9606"), (one, "species", base + "taxon/mouse"), (base + "taxon/mouse", "name", "mouse"), (one, "author", base + "person/ann_lee"),
            (base + "person/ann_lee", "affiliation", base + "organization/uni"), (base + "monetarygrant/g_1", "funder", base + "organization/nih"), (one, "sameAs", "https://doi.org/10.1/x"),
        } <= got
    assert not any("no id" in o for _, _, o in got)
    assert {r.key for r in records.keys(rows).collect()} >= {"_id", "name", "species", "doi"}


def test_sinks(spark, tmp_path):
    triples = spark.createDataFrame([("http://s", "http://p", 'a "b"\n', False), ("http://s", "http://q", "http://o", True)], "s string, p string, o string, iri boolean")
    sinks.write_n_triples(triples, (tmp_path / "nt").as_uri())
    back = parse_n_triples(spark.read.text((tmp_path / "nt").as_uri()), "value")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, triples.collect()))
    sinks.write_turtle(triples, (tmp_path / "ttl").as_uri())
    assert [r.value for r in spark.read.text((tmp_path / "ttl").as_uri()).collect()] == ['<http://s> <http://p> "a \\"b\\"\\n" ; <http://q> <http://o> .']
    rows = spark.createDataFrame([(1, ["x", "y"], 'say "hi"')], "gene int, tags array<string>, note string")
    sinks.write_table(rows.coalesce(1), (tmp_path / "csv").as_uri())
    assert [r.value for r in spark.read.text((tmp_path / "csv").as_uri()).collect()] == ["gene,tags,note", '1,"x, y","say ""hi"""']
    genes = spark.createDataFrame([("A", 1.23456, 0.00012), ("B", 0.0, None)], "gene string, log2fc double, padj double")
    assert [tuple(r) for r in sinks.gene_table(genes).collect()] == [("A", "1.2346", "1.20e-04"), ("B", "0.0000", "NA")]
    assert json.loads(sinks.with_provenance(genes, method="x").first().value)["provenance"] == {"method": "x"}


def test_gene_table_keeps_a_small_negative_sign(spark):
    from spindle.sources.sinks import gene_table

    rows = gene_table(spark.createDataFrame([(1, -0.001, 0.5), (2, 0.001, None)], "gene int, log2fc double, padj double"), places=2)
    assert sorted(rows.collect()) == [(1, "-0.00", "5.00e-01"), (2, "0.00", "NA")]


def test_headers_of_analytics_files_are_sent_to_the_lines(spark, tmp_path):
    """Lines are not dealt by their file, of which there may be few; each file's columns have places of their own."""
    one = "Gene ID\tGene Name\tDesign Element\tg1_g2.p-value\tg1_g2.log2foldchange\tg1_g3.p-value\tg1_g3.log2foldchange\n"
    two = "Gene ID\tGene Name\tg1_g2.log2foldchange\tg1_g2.t-statistic\tg1_g2.p-value\n"
    for name, text in (("E-A-1_A-1-analytics.tsv", one + "a\tA\tx\t0.5\t1\tNA\t\nb\tB\ty\tNA\t\tbad\t2\n"), ("E-A-2_A-1-analytics.tsv", two + "c\tC\t3\t4\t0.25\nd\tD\t5\n")):
        (tmp_path / f"name={name}").mkdir()
        (tmp_path / f"name={name}" / "part-0.txt").write_text(text)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = atlas.analytics(spark, f"{tmp_path.as_uri()}/name=*")
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.experiment, r.gene_id, r.design_element, r.contrast, r.p_value, r.t_statistic, r.log2fc) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [("E-A-1", "a", "x", "g1_g2", 0.5, None, 1.0), ("E-A-1", "b", "y", "g1_g3", None, None, 2.0), ("E-A-2", "c", None, "g1_g2", 0.25, 4.0, 3.0), ("E-A-2", "d", None, "g1_g2", None, None, 5.0)]


def test_united_graphs_meet_before_they_are_compared(spark, sf_dir):
    """A task that reads a table holds none of its triples, and the parts stay many."""
    from spindle.plans.catalogue import UNION_PARTS, u07, united

    rows = [("a", "p", "x"), ("a", "p", "y"), ("b", "p", "x"), ("b", None, None)]
    one, two = (spark.createDataFrame(part, "s string, p string, o string") for part in (rows[:3] + rows[:1], rows[1:]))
    assert sorted(map(repr, united(one, two).collect())) == sorted(map(repr, one.union(two).distinct().collect()))
    assert united(one, two).rdd.getNumPartitions() == UNION_PARTS
    plan = u07(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning(s#", 1)
    assert "HashAggregate(keys=[s#" in above and "keys=[s#" not in below


def test_facts_of_datasets_and_repeated_facts(spark, sf_dir):
    from spindle.sources.views import DATASET, triples

    named = triples(spark, sf_dir, only=("name",))
    own = triples(spark, sf_dir, only=("name",), datasets=True)
    assert own.exceptAll(named.where(named.s.startswith(DATASET))).count() == 0 and own.count() == named.where(named.s.startswith(DATASET)).count()
    again = triples(spark, sf_dir, only=("name",), repeated=True)
    assert again.count() > named.count() and again.distinct().exceptAll(named).count() == 0
