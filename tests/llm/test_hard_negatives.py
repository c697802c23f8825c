from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spindle.llm import hard_negatives as module
from spindle.llm.hard_negatives import hard_negatives

KINDS = "vec_id long, label int, vector array<long>, slice string, cell int"


def brute_force(rows, every=5, positives=3, negatives=2, low=50, high=95):
    one = {}
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or None in v:
            continue
        if i not in one or (label, v) < one[i]:
            one[i] = (label, v)
    out = set()
    for a, (label, v) in one.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, k == label) for i, (k, w) in one.items() if i != a and len(w) == len(v))
        for s, p, _ in [r for r in scored if r[2]][:positives]:
            fits = [(n, t) for t, n, same in scored if not same and low * -s <= 100 * -t <= high * -s][:negatives]
            out |= {(a, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(fits)}
    return out


def found(df, **more):
    options = {"positives": 3, "negatives": 2} | more
    rows = hard_negatives(df, F.col("vec_id") % 5 == 0, **options).collect()
    out = {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in rows}
    assert len(out) == len(rows)
    return out


def vectors(rng, n, width=6, spread=40):
    centres = [[rng.randint(-200, 200) for _ in range(width)] for _ in range(6)]
    return [(i, rng.randint(0, 3), [c + rng.randint(-spread, spread) for c in centres[rng.randrange(6)]], "clash", 7) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = vectors(rng, 300)
    # copies of anchors and others, repeated rows, one id with two vectors, ties, odd rows
    rows += [(1000 + i, rows[i % 3][1], rows[i % 3][2], None, None) for i in range(40)] + rows[:20] + [(7, 0, [1] * 6, None, None), (10, 0, [2] * 6, None, None)]
    rows += [(2000 + i, i % 2, [3, 0, 0, 0, 0, i % 3], None, None) for i in range(30)] + [(3000 + i, i % 2, [0] * 6, None, None) for i in range(12)]
    rows += [(5, None, [1] * 6, None, None), (None, 1, [1] * 6, None, None), (4005, 1, None, None, None), (4010, 1, [1, None, 3, 4, 5, 6], None, None), (4015, 1, [], None, None), (4020, 1, [1, 2], None, None), (4021, 2, [1, 1], None, None), (4022, 1, [1, 3], None, None)]
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    assert found(df) == brute_force(rows)


def test_groups_slices_and_pivots_do_not_change_the_rows(spark, monkeypatch):
    rows = vectors(random.Random(3), 400)
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    whole = found(df)
    assert whole == brute_force(rows)
    monkeypatch.setattr(module, "GROUP", 4)
    monkeypatch.setattr(module, "SLICE", 64 * 8 * 6)
    assert found(df, pivots=23) == whole


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [rng.randint(-(1 << 28), 1 << 28) for _ in range(4)], None, None) for i in range(60)]
    assert found(spark.createDataFrame(rows, KINDS)) == brute_force(rows)


def test_few_rows_and_empty_table(spark):
    rows = [(0, 1, [4, 4], None, None), (1, 1, [4, 3], None, None), (2, 2, [3, 2], None, None)]
    df = spark.createDataFrame(rows, KINDS)
    assert found(df) == brute_force(rows) == {(0, 1, 1, 2, 28, 20)}
    assert hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0).collect() == []
