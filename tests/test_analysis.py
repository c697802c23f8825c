"""From a term to a result: expansion, phrases, and each mode of analysis."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from spindle.operators.analysis import analyse, expanded, ontology_phrases, phrases_found
from spindle.operators.cohort import phrase_match

GROUPS = {"lung": ["lung", "pulmonary"], "ra": ["rheumatoid arthritis", "ra"], "fibrosis": ["fibrosis", "fibrotic"]}


def test_expansion_by_groups():
    assert expanded("Lung", GROUPS) == ["Lung", "lung", "pulmonary"]
    assert expanded("pulmonary", GROUPS) == ["lung", "pulmonary"]
    assert expanded("lung fibrosis", GROUPS) == ["fibrosis", "fibrotic", "lung", "lung fibrosis", "pulmonary"]
    assert expanded("brain", GROUPS) == ["brain"] and expanded("early RA!", GROUPS) == ["early RA!", "ra", "rheumatoid arthritis"]
    assert expanded("", GROUPS) == [""]


def test_ontology_phrases_are_direct(spark):
    labels = spark.createDataFrame([(1, "Disease"), (2, "flu"), (2, "influenza"), (3, "bird flu"), (4, "H5N1"), (9, "FLU")], "id int, label string")
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "child int, parent int")
    assert {r.phrase for r in ontology_phrases("Flu", labels, edges).collect()} == {"flu", "influenza", "bird flu", "FLU"}
    assert ontology_phrases("none", labels, edges).count() == 0


def test_phrases_are_those_of_patterns(spark):
    rng = random.Random(1)
    words = ["a", "b", "cd", "e-f", "G"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 8))), rng.choice([None, "a b", ""])) for i in range(80)]
    frame = spark.createDataFrame(rows, "sample int, title string, other string")
    wanted = ["a b", "cd e f", "g", "--", "b a b a b", "a"]
    phrases = spark.createDataFrame([(p,) for p in wanted], "phrase string")
    got = {(r.sample, r.phrase) for r in phrases_found(frame, "sample", ["title", "other"], phrases).collect()}
    for p in wanted:
        scan = {r.sample for r in frame.where(phrase_match(["title", "other"], [p])).collect()}
        assert {s for s, q in got if q == p} == scan
    assert phrases_found(frame, "sample", ["title"], phrases.limit(0)).collect() == []


def fixture(spark, studies, per_study, shared=True, seed=5):
    """Samples of studies with tests and controls (or each study with one side only), and counts that differ for genes 0 and 1."""
    rng = random.Random(seed)
    samples, counts = [], []
    for k in range(studies):
        for i in range(2 * per_study):
            test = i % 2 == 0 if shared else k % 2 == 0
            name = f"s{k}-{i}"
            samples.append((name, f"GSE{k}", "sick with Lung-Cancer" if test else "healthy control"))
            for g in range(6):
                level = 100 * (4 if test and g == 0 else 1) * (0.2 if test and g == 1 else 1)
                counts.append((g, name, max(0, int(rng.gauss(level, level / 10)))))
    return spark.createDataFrame(samples, "sample string, series_id string, title string"), spark.createDataFrame(counts, "gene int, sample string, count long")


CONTROL = F.lit


@pytest.mark.parametrize("studies, per_study, shared, mode", [(4, 5, True, "study-matched"), (2, 6, True, "study-prioritised"), (4, 5, False, "pooled")])
def test_modes_run_their_tests(spark, studies, per_study, shared, mode):
    samples, counts = fixture(spark, studies, per_study, shared)
    phrases = spark.createDataFrame([("1 ontology", "carcinoma of the lung"), ("2 keyword", "lung cancer"), ("2 keyword", "cancer")], "strategy string, phrase string")
    out = {r.gene: r for r in analyse(samples, counts, phrases, F.lower("title").contains("control")).collect()}
    assert set(out) == set(range(6))
    # the first strategy finds nothing, so the second is taken
    assert {(r.strategy, r.mode) for r in out.values()} == {("2 keyword", mode)}
    assert out[0].log2fc > 0.5 and out[1].log2fc < -1 and out[0].padj < 0.01 and out[1].padj < 0.01
    n = studies * per_study
    assert {(r.n_test, r.n_control) for r in out.values()} == {(n, n)}
    assert {r.n_studies for r in out.values()} == {studies if mode == "study-matched" else None}
    assert all(r.pvalue <= r.padj <= 1 for r in out.values())


def test_matched_studies_are_combined(spark):
    samples, counts = fixture(spark, 3, 3)
    phrases = spark.createDataFrame([("keyword", "cancer")], "strategy string, phrase string")
    out = {r.gene: r for r in analyse(samples, counts, phrases, F.lower("title").contains("control")).collect()}
    # three against three, all tests above all controls: p is 2 of 20 in each study
    x = -2 * 3 * math.log(0.1)
    want = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(3))
    assert out[0].pvalue == pytest.approx(want) and out[0].n_studies == 3


def test_nothing_found(spark):
    samples, counts = fixture(spark, 2, 3)
    phrases = spark.createDataFrame([("keyword", "diabetes"), ("other", "!!")], "strategy string, phrase string")
    assert analyse(samples, counts, phrases, F.lower("title").contains("control")).collect() == []
    assert analyse(samples.limit(0), counts, phrases, F.lit(True)).collect() == []
    found = spark.createDataFrame([("keyword", "cancer")], "strategy string, phrase string")
    assert analyse(samples, counts.limit(0), found, F.lower("title").contains("control")).collect() == []


def test_associations_of_either_sign_are_reified(spark, sf_dir):
    from spindle.plans.atlas import e11_triples
    from spindle.sources.views import associations

    known = associations(spark, sf_dir).select("contrast", "gene", "log2fc", "adj_p").distinct()
    rows = e11_triples(spark, sf_dir)
    assert rows.where("log2fc <= 0").count() == known.where("log2fc <= 0").count() > 0
    assert rows.count() == known.count()
