"""Normalisations, exact rank tests and enrichment against plain Python."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from spindle.functions.special import rank_sum_tail
from spindle.operators.normalise import dense, expressed, log_quantile, tmm, tmm_factors
from spindle.operators.statistics import mann_whitney_p, over_representation


def counts_of(rng, genes=60, samples=7):
    rows = []
    for s in range(samples):
        depth = rng.choice([0.5, 1, 3])
        for g in range(genes):
            n = int(rng.expovariate(1 / 40) * depth) if rng.random() < 0.8 else 0
            if g < 6 and s > 3:
                n = n * 20 + 5
            if n or rng.random() < 0.3:
                rows.append((g, s, n))
    return [*rows, (3, 50, 0), (4, 50, 0), (None, 1, 5), (1, None, 5), (1, 1, None), *[(9, 2, 4)] * 2]


def table(rows):
    out = {}
    for g, s, n in rows:
        if None not in (g, s, n):
            out[g, s] = out.get((g, s), 0) + n
    return out


def plain_tmm(rows):
    t = table(rows)
    genes, samples = sorted({g for (g, _), n in t.items() if n > 0}), sorted({s for _, s in t})
    libraries = {s: sum(n for (_, x), n in t.items() if x == s) for s in samples}
    some = [s for s in samples if libraries[s]]

    def quartile(s):
        v = sorted(t.get((g, s), 0) / libraries[s] for g in genes)
        at = (len(v) - 1) * 0.75
        low = math.floor(at)
        return v[low] + (at - low) * (v[min(low + 1, len(v) - 1)] - v[low])

    q = {s: quartile(s) for s in some}
    mean = sum(q.values()) / len(q)
    ref = min(some, key=lambda s: (abs(q[s] - mean), s))

    def ranks(v):
        return [sum(y < x for y in v) + 1 + (sum(y == x for y in v) - 1) / 2 for x in v]

    logs = {}
    for s in some:
        both = [g for g in genes if t.get((g, s), 0) > 0 and t.get((g, ref), 0) > 0]
        y, r = [t[g, s] / libraries[s] for g in both], [t[g, ref] / libraries[ref] for g in both]
        m, a = [math.log2(i / j) for i, j in zip(y, r)], [math.log2(i * j) / 2 for i, j in zip(y, r)]
        v = [(1 - i) / (i * libraries[s]) + (1 - j) / (j * libraries[ref]) for i, j in zip(y, r)]
        n, rm, ra = len(both), ranks(m), ranks(a)
        low, level = math.floor(n * 0.3) + 1, math.floor(n * 0.05) + 1
        keep = [i for i in range(n) if low <= rm[i] <= n + 1 - low and level <= ra[i] <= n + 1 - level]
        w = sum(1 / v[i] for i in keep)
        logs[s] = sum(m[i] / v[i] for i in keep) / w if w and max(map(abs, m)) >= 1e-6 else 0.0
    centre = sum(logs.values()) / len(logs)
    return {s: (libraries[s], 2 ** (logs[s] - centre) if s in logs else None) for s in samples}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tmm_factors_against_plain_python(spark, seed):
    rows = counts_of(random.Random(seed))
    frame = spark.createDataFrame(rows, "gene int, sample int, count long")
    want = plain_tmm(rows)
    got = {r.sample: (r.library, r.factor) for r in tmm_factors(frame).collect()}
    assert got.keys() == want.keys()
    for s, (library, factor) in want.items():
        assert got[s][0] == library
        assert got[s][1] == (None if factor is None else pytest.approx(factor, rel=1e-9))
    known = [f for _, f in got.values() if f]
    assert math.prod(known) == pytest.approx(1.0)
    values = {(r.gene, r.sample): r.value for r in tmm(frame).collect()}
    assert values[9, 2] == pytest.approx(table(rows)[9, 2] / (want[2][0] * want[2][1]) * 1e6)
    assert not any(s == 50 for _, s in values)
    assert tmm_factors(frame.limit(0)).collect() == [] and tmm(frame.limit(0)).collect() == []


def test_equal_samples_have_equal_factors(spark):
    rows = [(g, s, (g + 1) * (1 + s)) for g in range(30) for s in range(3)]
    got = tmm_factors(spark.createDataFrame(rows, "gene int, sample int, count long")).collect()
    assert [r.factor for r in got] == pytest.approx([1.0] * 3)


def test_grid_filter_and_log_quantile(spark):
    rows = [("a", 1, 100), ("a", 2, 60), ("b", 1, 49), ("b", 1, 1), ("c", 2, 7), ("d", 3, 0)]
    frame = spark.createDataFrame(rows, "gene string, sample int, count long")
    grid = {(r.gene, r.sample): r["count"] for r in dense(frame).collect()}
    assert len(grid) == 12 and grid["b", 1] == 50 and grid["c", 1] == 0
    assert {(r.gene, r.n_expressed) for r in expressed(frame, 50, 0.34).collect()} == {("a", 2)}
    assert {r.gene for r in expressed(frame, 50, 0.33).collect()} == {"a", "b"}
    out = log_quantile(frame).collect()
    by_sample = [sorted(r.normal for r in out if r.sample == s) for s in (1, 2, 3)]
    assert len(out) == 12 and by_sample[0] == by_sample[1] == by_sample[2]
    assert log_quantile(frame.limit(0)).collect() == []


def test_rank_sum_tail_counts_all_splits():
    for m, n in itertools.product(range(1, 9), range(1, 9)):
        if m + n > 12:
            continue
        every = [sum(c) - m * (m + 1) // 2 for c in itertools.combinations(range(1, m + n + 1), m)]
        tail = rank_sum_tail(m, n)
        for u in range(m * n // 2 + 1):
            assert tail[u] == pytest.approx(sum(x <= u for x in every) / len(every), rel=1e-12)
    # a large group: the tail stays between 0 and 1 and grows
    tail = rank_sum_tail(8, 3000)
    assert 0 < tail[0] < 1e-20 and all(tail[1:] >= tail[:-1]) and tail[-1] == pytest.approx(0.5, abs=0.01)


def test_small_groups_without_ties_are_exact(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for gene in range(14):
        m, n = rng.randint(1, 8), rng.randint(1, 5)
        tied = gene % 4 == 3
        values = rng.sample(range(100), m + n)
        if tied:
            values[1] = values[0]
        rows += [(gene, "test" if i < m else "control", float(v)) for i, v in enumerate(values)]
        if not tied:
            u = sum(x > y for x in values[:m] for y in values[m:])
            every = [sum(x > y for x in c for y in set(values) - set(c)) for c in itertools.combinations(values, m)]
            low = sum(min(u, m * n - u) >= e for e in every) / len(every)
            want[gene] = min(1.0, 2 * low)
    rows += [(99, "test", float(i)) for i in range(9)] + [(99, "control", i + 0.5) for i in range(9)] + [(98, "test", 1.0)]
    got = {r.gene: r for r in mann_whitney_p(spark.createDataFrame(rows, "gene int, grp string, value double")).collect()}
    assert set(got) == {*range(14), 99}
    for gene, p in want.items():
        assert got[gene].pvalue == pytest.approx(p, rel=1e-12)
    # nine in each group: the normal approximation
    assert got[99].pvalue == pytest.approx(math.erfc(abs(got[99].z) / math.sqrt(2)), rel=1e-9)


def test_enrichment_by_direction(spark):
    genes = [(g, "up") for g in range(8)] + [(g, "down") for g in range(20, 26)] + [(g, "few") for g in range(3)] + [(None, "up")]
    sets = [("t", g) for g in range(0, 10)] + [("v", g) for g in range(5, 30)] + [("t", None), ("t", 1)]
    frames = spark.createDataFrame(genes, "gene int, direction string"), spark.createDataFrame(sets, "term string, gene int")

    def p_of(k, n, m, total):
        return sum(math.comb(m, i) * math.comb(total - m, n - i) for i in range(k, min(n, m) + 1)) / math.comb(total, n)

    got = {(r.direction, r.term): r for r in over_representation(*frames, background=100, by=("direction",), correction="bonferroni").collect()}
    assert set(got) == {("up", "t"), ("up", "v"), ("down", "v")}
    assert got["up", "t"].pvalue == pytest.approx(p_of(8, 8, 10, 100)) and got["down", "v"].pvalue == pytest.approx(p_of(6, 6, 25, 100))
    assert got["up", "v"].padj == pytest.approx(min(1.0, 2 * p_of(3, 8, 25, 100))) and got["down", "v"].padj == got["down", "v"].pvalue
    adjusted = {(r.direction, r.term): r.padj for r in over_representation(*frames, background=100, by=("direction",)).collect()}
    assert adjusted["up", "t"] == pytest.approx(2 * got["up", "t"].pvalue)
    with pytest.raises(ValueError):
        over_representation(*frames, background=100, correction="none")
