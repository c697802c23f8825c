"""Operators on small tables against plain Python, with nulls, ties and empty tables."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from spindle.functions.special import incomplete_beta
from spindle.operators.cohort import classified, search, series
from spindle.operators.etl import clean_iri, curie_to_iri, literal_type, n_triples, parse_n_triples, slug
from spindle.operators.graph import closure, match, optional
from spindle.operators.ranking import facets
from spindle.operators.segments import prefix_segments
from spindle.operators.statistics import benjamini_hochberg, fisher, mann_whitney, medians, over_representation, stouffer, welch


def test_bgp_joins_and_alternation(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c"), ("b", "r", "d"), ("x", "p", "y"), ("a", "p", "b")], "s string, p string, o string")
    got = match(t, [("?x", "p", "?y"), ("?y", ("q", "r"), "?z")]).distinct().collect()
    assert sorted((r.x, r.y, r.z) for r in got) == [("a", "b", "c"), ("a", "b", "d")]
    assert match(t, [("?x", "p", "?x")]).count() == 0
    with pytest.raises(ValueError):
        match(t, [("?x", "p", "?y"), ("?u", "q", "?v")])


def test_optional_filter_stays_in_the_match(spark):
    t = spark.createDataFrame([("a", "is", "T"), ("b", "is", "T"), ("a", "n", "1"), ("b", "n", "2")], "s string, p string, o string")
    rows = optional(match(t, [("?x", "is", "T")]), t, [("?x", "n", "?v")], "v = '1'")
    assert sorted((r.x, r.v) for r in rows.collect()) == [("a", "1"), ("b", None)]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 9)], "child long, parent long")
    got = closure(edges, spark.createDataFrame([(1,), (9,), (50,)], "node long"))
    assert sorted((r.start, r.node) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (9, 9), (50, 50)]


def test_benjamini_hochberg(spark):
    rng = random.Random(3)
    rows = [("a", i, rng.choice([None, 0.001, 0.01, rng.random()])) for i in range(40)] + [("b", 1, 0.5)]
    frame = spark.createDataFrame(rows, "g string, id int, p double")
    got = {(r.g, r.id): r.padj for r in benjamini_hochberg(frame, "p", ["g"]).collect()}
    assert len(got) == len(rows)
    for g in "ab":
        tested = sorted((p, i) for gg, i, p in rows if gg == g and p is not None)
        best = 1.0
        for k in range(len(tested), 0, -1):
            p, i = tested[k - 1]
            best = min(best, p * len(tested) / k)
            assert got[g, i] == pytest.approx(best)
    assert all(got[g, i] is None for g, i, p in rows if p is None)
    assert benjamini_hochberg(frame.limit(0), "p", ["g"]).count() == 0


def test_mann_whitney_counts_pairs(spark):
    rng = random.Random(1)
    values = [(gene, s, "test" if s < 7 else "control", float(rng.randint(0, 4))) for gene in range(5) for s in range(15)] + [(9, s, "test" if s % 2 else "control", 1.0) for s in range(4)]
    got = {r.gene: r for r in mann_whitney(spark.createDataFrame(values, "gene int, sample int, grp string, value double")).collect()}
    for gene in range(5):
        a = [v for g, _, grp, v in values if g == gene and grp == "test"]
        b = [v for g, _, grp, v in values if g == gene and grp == "control"]
        u = sum((x > y) + 0.5 * (x == y) for x, y in itertools.product(a, b))
        assert got[gene].u == u
        n, tie = len(a) + len(b), sum(t**3 - t for t in (sum(v == w for v in a + b) for w in set(a + b)))
        sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - tie / (n * (n - 1))))
        z = max(abs(u - len(a) * len(b) / 2) - 0.5, 0) / sd * (1 if u > len(a) * len(b) / 2 else -1)
        assert got[gene].z == pytest.approx(z)
    assert got[9].z == 0


def test_student_and_welch(spark):
    # one degree of freedom is the Cauchy distribution
    assert incomplete_beta(0.5, 0.5, 1 / (1 + 2.0**2)) == pytest.approx(1 - 2 * math.atan(2.0) / math.pi)
    frame = spark.createDataFrame([(1, 1.0, 2.0, 0.5, 0.4, 5, 6), (2, 1.0, 1.0, 0.0, 0.0, 3, 3)], "gene int, mean_test double, mean_control double, var_test double, var_control double, n_test int, n_control int")
    got = {r.gene: r for r in welch(frame).collect()}
    assert got[1].t == pytest.approx(-1 / math.sqrt(0.1 + 0.4 / 6))
    assert 0 < got[1].pvalue < 0.1
    assert got[2].t is None
    assert got[2].pvalue == 1.0


def test_combinations(spark):
    rows = [("g", "s1", 0.01, 2.0, 10), ("g", "s2", 0.02, 1.8, 10), ("g", "s3", 0.03, 2.2, 10), ("one", "s1", 0.01, 1.0, 5), ("weak", "s1", 0.5, 1.0, 5), ("weak", "s2", 0.6, 1.0, 5), ("weak", "s3", 0.7, 1.0, 5), ("g", "s4", None, 1.0, 5)]
    frame = spark.createDataFrame(rows, "gene string, study string, p double, log2fc double, n int")
    z = {r.gene: r for r in stouffer(frame).collect()}
    assert set(z) == {"g", "weak"}
    assert z["g"].pvalue < 0.01
    assert z["g"].log2fc == pytest.approx(2.0)
    f = {r.gene: r for r in fisher(frame).collect()}
    x = -2 * sum(map(math.log, (0.01, 0.02, 0.03)))
    assert f["g"].pvalue == pytest.approx(math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(3)))
    assert f["weak"].pvalue > 0.1


def test_over_representation(spark):
    sets = spark.createDataFrame([("t", g) for g in range(10)] + [("u", g) for g in range(100, 150)], "term string, gene int")
    genes = spark.createDataFrame([(g,) for g in [*range(5), 100, *range(1000, 1004)]], "gene int")
    got = {r.term: r for r in over_representation(genes, sets, 1000).collect()}
    exact = sum(math.comb(10, i) * math.comb(990, 10 - i) for i in range(5, 11)) / math.comb(1000, 10)
    assert got["t"].pvalue == pytest.approx(exact)
    assert got["t"].overlap == 5
    assert over_representation(genes.limit(3), sets, 1000).count() == 0


def test_search_modes(spark):
    rows = spark.createDataFrame([("1", "Psoriasis skin biopsy"), ("2", "healthy-skin control"), ("3", None), ("4", "skinny")], "sample string, title string")
    ids = lambda p: sorted(r.sample for r in search(rows, p, ["title"], ["title"]).collect())
    assert ids("skin") == ["1", "2"]
    assert ids("skin biopsy|healthy skin") == ["1", "2"]
    assert ids("^skin+y$") == ["4"]
    assert ids("[") == []


def test_series_and_precedence(spark):
    rows = spark.createDataFrame([("a", "GSE1, GSE2,X3", "tumor control"), ("b", None, "control"), ("c", "GSE1", "other")], "sample string, series_id string, title string")
    got = series(rows)
    assert sorted((r.sample, r.series) for r in got.collect()) == [("a", "GSE1"), ("a", "GSE2"), ("c", "GSE1")]
    assert {r.sample: r.cohort for r in classified(rows, F.col("title"), "tumor", "control").collect()} == {"a": "test", "b": "control", "c": None}


def test_identifiers(spark):
    rows = spark.createDataFrame([(" Über  Größe! ", " http://x.org/a b"), ("", "ftp://x"), (None, "http://"), ("__", "https://h/<")], "label string, url string")
    got = rows.select(slug("label").alias("s"), clean_iri("url").alias("u")).collect()
    assert [r.s for r in got] == ["über_größe", "resource", "resource", "resource"]
    assert [r.u for r in got] == ["http://x.org/a", None, None, "https://h/"]
    kinds = spark.createDataFrame([("2024-02-30",), ("2024-02-28",), ("2024-02-28T10:00:00Z",), ("7",), ("x",), (None,)], "v string")
    assert [r.k for r in kinds.select(literal_type("v").alias("k")).collect()] == ["string", "date", "dateTime", "integer", "string", "string"]
    curies = spark.createDataFrame([("MONDO:1",), ("MONDO_2",), ("http://z",), ("Q:1",)], "c string")
    assert [r.i for r in curies.select(curie_to_iri("c", {"MONDO": "m/"}).alias("i")).collect()] == ["m/1", "m/2", "http://z", None]


def test_n_triples_round_trip(spark):
    texts = ['say "hi"\\n', "tab\tline\nback\\slash", "", "\\", '"', "é" * 30000]
    rows = spark.createDataFrame([(f"http://s/{i}", "http://p", t, False) for i, t in enumerate(texts)] + [("http://s", "http://p", "http://o", True)], "s string, p string, o string, iri boolean")
    back = parse_n_triples(n_triples(rows))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    junk = spark.createDataFrame([("# note",), ("",), ("<a> <b> c .",)], "line string")
    assert parse_n_triples(junk).count() == 0


def test_prefix_segments_partition_the_keys(spark):
    keys = [f"ab{i % 7}{i}" for i in range(200)] + ["ab", "ab", "ac", None]
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    got = prefix_segments(frame, 30).collect()
    assert sum(r.n for r in got) == 203
    assert all(r.n <= 30 for r in got if r.complete)
    assert prefix_segments(frame.limit(0), 30).count() == 0


def test_differential_expression_query_against_plain_python(spark, sf_dir):
    """X01: filters, log-CPM, rank test with mid-ranks and continuity, and the adjustment."""
    from collections import defaultdict
    from statistics import mean

    from spindle.plans import registry
    from spindle.plans import cohorts  # noqa: F401
    from spindle.sources.views import expression

    rows = [(r.gene, r.sample, r["count"], r.grp) for r in expression(spark, sf_dir).collect()]
    library, total = defaultdict(int), defaultdict(int)
    for g, s, n, _ in rows:
        library[s] += n
        total[g] += n
    rows = [x for x in rows if library[x[1]] >= 1000 and total[x[0]] >= 10]
    library = defaultdict(int)
    for _, s, n, _ in rows:
        library[s] += n
    values = defaultdict(lambda: {"test": [], "control": []})
    for g, s, n, grp in rows:
        values[g][grp].append(math.log2(n / library[s] * 1e6 + 1))
    expected = {}
    for g, own in values.items():
        a, b = own["test"], own["control"]
        if sum(v > 0 for v in a) < 3 or sum(v > 0 for v in b) < 3:
            continue
        both = sorted(a + b)
        rank = {v: both.index(v) + (both.count(v) + 1) / 2 for v in set(both)}
        n1, n2, n = len(a), len(b), len(a) + len(b)
        u = sum(rank[v] for v in a) - n1 * (n1 + 1) / 2
        tie = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
        spread = math.sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1))))
        z = max(abs(u - n1 * n2 / 2) - 0.5, 0) / spread if spread else 0
        expected[g] = (mean(a) - mean(b), math.erfc(z / math.sqrt(2)))
    order = sorted(expected, key=lambda g: expected[g][1])
    low, adjusted = 1.0, {}
    for i in range(len(order), 0, -1):
        low = min(low, expected[order[i - 1]][1] * len(order) / i)
        adjusted[order[i - 1]] = low
    got = {r.gene: r for r in registry.queries()["X01_differential_expression"](spark, sf_dir).collect()}
    assert set(got) == set(expected)
    for g, (fold, p) in expected.items():
        assert math.isclose(got[g].log2fc, fold, abs_tol=1e-9)
        assert math.isclose(got[g].pvalue, p, rel_tol=1e-9)
        assert math.isclose(got[g].padj, adjusted[g], rel_tol=1e-9)


def test_seeded_sample_query(spark, sf_dir):
    """W09: the 50 samples of least hash, the same at every partitioning."""
    from spindle.plans import cohorts, registry  # noqa: F401
    from spindle.sources.views import samples

    got = [r.sample for r in registry.queries()["W09_seeded_sample"](spark, sf_dir).collect()]
    every = sorted((r.h, r.sample) for r in samples(spark, sf_dir).select(F.xxhash64("sample", F.lit(42)).alias("h"), "sample").repartition(7).collect())
    assert got == [s for _, s in every[:50]]


def test_distribution_functions():
    from statistics import NormalDist

    import numpy as np

    from spindle.functions import special

    x = np.concatenate([np.linspace(0, 6, 200), [10.0, 20.0, 26.0]])
    assert np.allclose(special.erfc(x), [math.erfc(v) for v in x], rtol=1e-12)
    p = np.concatenate([10.0 ** -np.arange(1, 300, 7.0), np.linspace(0.001, 0.999, 99)])
    assert np.allclose(special.quantile(p), [NormalDist().inv_cdf(v) for v in p], rtol=1e-12, atol=1e-12)
    g = np.concatenate([np.linspace(0.1, 30, 200), [1e3, 1e6]])
    assert np.allclose(special.log_gamma(g), [math.lgamma(v) for v in g], rtol=1e-12, atol=1e-12)
    # t = 2 with 10 degrees of freedom; df 1 is Cauchy's distribution
    assert np.allclose(special.incomplete_beta(np.array([5.0]), np.array([0.5]), np.array([10 / 14])), 0.07338803477074052)
    assert np.allclose(special.incomplete_beta(np.array([0.5]), np.array([0.5]), np.array([1 / 5])), 1 - 2 * math.atan(2) / math.pi)
    rng = np.random.default_rng(0)
    for t, n, m in rng.integers(1, 60, (60, 3)):
        n, m = min(n, t), min(m, t)
        for k in range(0, min(n, m) + 1):
            exact = sum(math.comb(m, i) * math.comb(t - m, n - i) for i in range(k, min(n, m) + 1)) / math.comb(t, n)
            assert math.isclose(special.hypergeometric(*(np.array([v]) for v in (k, n, m, t)))[0], exact, rel_tol=1e-9)


def test_a_tail_from_far_below_the_peak():
    import numpy as np

    from spindle.functions import special

    # its first term is too small for a double
    for k, n, m, t in ((33, 5221, 8100, 20_000), (1, 6000, 9000, 20_000), (2000, 5221, 8100, 20_000), (2300, 5221, 8100, 20_000), (3300, 5221, 8100, 20_000)):
        total = exact = term = math.comb(m, low := max(0, n - (t - m))) * math.comb(t - m, n - low)
        exact = term if low >= k else 0
        for i in range(low, min(n, m)):
            term = term * (m - i) * (n - i) // ((i + 1) * (t - m - n + i + 1))
            total, exact = total + term, exact + (term if i + 1 >= k else 0)
        assert math.isclose(special.hypergeometric(*(np.array([v]) for v in (k, n, m, t)))[0], exact / total, rel_tol=1e-8, abs_tol=1e-300)


def test_a_mean_does_not_depend_on_the_order(spark):
    from spindle.operators.statistics import decimal_mean

    values = [0.1, 0.2, -0.3, 0.7, -0.7]
    got = {k: spark.createDataFrame([(v,) for v in rows], "v double").coalesce(1).agg(decimal_mean("v")).first()[0] for k, rows in (("up", values), ("down", values[::-1]))}
    assert got == {"up": 0.0, "down": 0.0}


def test_medians_of_groups(spark):
    from statistics import median

    rng = random.Random(9)
    rows = [("a", float(rng.randint(0, 9))) for _ in range(101)] + [("b", rng.random()) for _ in range(100)] + [("c", 2.0)] * 6 + [("d", 1.5), ("e", None), ("f", -3.0), ("f", 1e9)]
    for parts in (1, 7, 1024):
        got = {r.g: r.median for r in medians(spark.createDataFrame(rows, "g string, value double"), ["g"], parts).collect()}
        assert got == {g: pytest.approx(median([v for h, v in rows if h == g and v is not None])) for g in "abcdf"}
    assert medians(spark.createDataFrame(rows, "g string, value double").limit(0), ["g"]).collect() == []


def test_facets_are_not_narrowed_by_their_own_filter(spark):
    rows = [("x", "1"), ("x", "2"), ("y", "1"), ("y", "1"), (None, "1"), ("z", None), ("z", "3")]
    frame = spark.createDataFrame(rows, "a string, b string")
    every = {(r.field, r.value): (r.n, r["rank"]) for r in facets(frame, ["a", "b"]).collect()}
    assert every == {("a", "x"): (2, 1), ("a", "y"): (2, 2), ("a", "z"): (2, 3), ("b", "1"): (4, 1), ("b", "2"): (1, 2), ("b", "3"): (1, 3)}
    some = {(r.field, r.value): r.n for r in facets(frame, ["a", "b"], 2, {"b": ["1"]}).collect()}
    assert some == {("a", "x"): 1, ("a", "y"): 2, ("b", "1"): 4, ("b", "2"): 1}
    assert facets(frame.limit(0), ["a"]).collect() == []


def test_facts_of_associations_are_not_sent_to_be_made_distinct(spark):
    """Only the associations are: they are shorter and fewer than their facts."""
    from spindle.operators import etl, study_graph

    rows = spark.createDataFrame([("c1", 1, 0.5), ("c1", 1, 0.5), ("c1", 2, None), ("c2", 1, 0.5)], "contrast string, gene long, p double")
    facts = etl.reified(rows, "contrast", "gene", ["p"])
    assert facts._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert facts.count() == facts.distinct().count() == 8
    up, down = (study_graph.statements(rows, study_graph.node_iri("assay", "contrast"), r, study_graph.node_iri("gene", "gene"), ["p"], {"m": "x"}) for r in ("UP", "DOWN"))
    whole = study_graph.joined(up, down)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
    assert sorted(whole.collect()) == sorted(study_graph.graph(up, down).collect())
