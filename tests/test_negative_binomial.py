"""The negative-binomial test against a likelihood written out in plain Python."""

from __future__ import annotations

import math
import random
from statistics import median

import pytest

from spindle.operators.negative_binomial import negative_binomial_test, size_factors


def data(seed, genes=12, samples=10):
    rng = random.Random(seed)
    rows = []
    for g in range(genes):
        level, spread, fold = rng.choice([5, 40, 300]), rng.choice([0.05, 0.3, 1.0]), rng.choice([1, 1, 2, 6])
        for s in range(samples):
            mean = level * (fold if s % 2 == 0 else 1) * (0.6 + s / samples)
            rate = rng.gammavariate(1 / spread, spread * mean)
            n, x = 0, rng.expovariate(1)
            while x < rate:
                n, x = n + 1, x + rng.expovariate(1)
            rows.append((g, s, n, "test" if s % 2 == 0 else "control"))
    return rows


def likelihood(k, m, a):
    r = 1 / a
    return sum(math.lgamma(x + r) - math.lgamma(r) - math.lgamma(x + 1) + (x * math.log(a * y / (1 + a * y)) if x else 0.0) - r * math.log(1 + a * y) for x, y in zip(k, m))


def best(k, s, test):
    """Levels by bisection for each dispersion, the dispersion by a fine search."""

    def level(part, a):
        low, high = 1e-9, 1e7
        for _ in range(200):
            q = math.sqrt(low * high)
            slope = sum((k[i] - s[i] * q) / (1 + a * s[i] * q) for i in part)
            low, high = (q, high) if slope > 0 else (low, q)
        return math.sqrt(low * high)

    one, two = [i for i in range(len(k)) if test[i]], [i for i in range(len(k)) if not test[i]]

    def at(log_a):
        a = math.exp(log_a)
        q, p = level(one, a), level(two, a)
        return likelihood(k, [s[i] * (q if test[i] else p) for i in range(len(k))], a), q, p

    low, high = math.log(1e-8), math.log(100)
    grid = max((low + (high - low) * i / 60 for i in range(61)), key=lambda x: at(x)[0])
    low, high = max(low, grid - 0.5), min(high, grid + 0.5)
    for _ in range(80):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, y) if at(x)[0] > at(y)[0] else (x, high)
    value, q, p = at((low + high) / 2)
    a = math.exp((low + high) / 2)
    info = lambda part, level: sum(s[i] * level / (1 + a * s[i] * level) for i in part)
    error = math.sqrt(1 / info(one, q) + 1 / info(two, p)) / math.log(2)
    fold = math.log2(q / p)
    return value, a, fold, error, math.erfc(abs(fold / error) / math.sqrt(2))


def factors_of(rows):
    counts = {(g, s): n for g, s, n, _ in rows}
    genes, samples = sorted({g for g, _ in counts}), sorted({s for _, s in counts})
    full = [g for g in genes if all(counts[g, s] > 0 for s in samples)]
    return {s: math.exp(median(math.log(counts[g, s]) - sum(math.log(counts[g, t]) for t in samples) / len(samples) for g in full)) for s in samples}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_likelihood(spark, seed):
    rows = data(seed)
    # a gene without reads, one with reads in one group only, nulls and another group
    more = [(90, 0, 0, "test"), (91, 0, 9, "test"), (91, 2, 4, "test"), (None, 1, 5, "control"), (1, 3, None, "control"), (1, 77, 50, "other")]
    frame = spark.createDataFrame(rows + more, "gene int, sample int, count long, grp string")
    want = factors_of(rows)
    assert {r.sample: r.factor for r in size_factors(spark.createDataFrame(rows, frame.schema)).collect()} == {s: pytest.approx(f, rel=1e-12) for s, f in want.items()}
    got = {r.gene: r for r in negative_binomial_test(frame).collect()}
    assert set(got) == {*range(12), 90, 91}
    s, test = [want[i] for i in range(10)], [i % 2 == 0 for i in range(10)]
    ps = {}
    for g in range(12):
        k = [n for gene, _, n, _ in rows if gene == g]
        value, a, fold, error, p = best(k, s, test)
        r = got[g]
        levels = [r.base_mean]  # positive where there are reads
        assert levels[0] > 0
        assert r.log2fc == pytest.approx(fold, abs=2e-4) and r.error == pytest.approx(error, rel=2e-3) and r.pvalue == pytest.approx(p, rel=2e-2, abs=1e-9)
        if a > 1e-6:
            assert math.log(r.dispersion) == pytest.approx(math.log(a), abs=2e-3)
        ps[g] = r.pvalue
    for g in (90, 91):
        assert (got[g].log2fc, got[g].pvalue, got[g].padj, got[g].error) == (0.0, 1.0, 1.0, None)
    order = sorted(ps, key=ps.get, reverse=True)
    low = 1.0
    for i, g in enumerate(order):
        low = min(low, ps[g] * len(ps) / (len(ps) - i))
        assert got[g].padj == pytest.approx(low)


def test_one_group_and_empty_table(spark):
    frame = spark.createDataFrame([(g, s, 5 + g + s, "test") for g in range(3) for s in range(4)], "gene int, sample int, count long, grp string")
    assert {(r.log2fc, r.pvalue, r.padj) for r in negative_binomial_test(frame).collect()} == {(0.0, 1.0, 1.0)}
    assert negative_binomial_test(frame.limit(0)).collect() == []


def test_no_gene_with_reads_everywhere(spark):
    rows = [(g, s, 4 * (s + 1), "test" if s else "control") for g in range(6) for s in range(3) if g % 3 != s]
    factors = {r.sample: r.factor for r in size_factors(spark.createDataFrame(rows, "gene int, sample int, count long, grp string")).collect()}
    assert math.prod(factors.values()) == pytest.approx(1.0) and factors[0] < factors[1] < factors[2]
