"""The number of visited cells, where one group or rare partners would mislead it."""

from __future__ import annotations

import numpy as np
import pytest

from spindle.llm.multi_index import near_duplicate_vectors


def vectors(dense: int, pairs: int, singles: int) -> np.ndarray:
    """A dense group, pairs at a cosine of about 0.982, and vectors without partners."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    group = unit(unit(rng.normal(size=16)) + rng.normal(size=(dense, 16)) * 0.002)
    a = unit(rng.normal(size=(pairs, 16)))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    return np.concatenate([group, a, 0.982 * a + np.sqrt(1 - 0.982**2) * side, unit(rng.normal(size=(singles, 16)))])


@pytest.mark.parametrize("dense, pairs, singles", [(1500, 900, 0), (0, 30, 6000)])
def test_pairs_are_found_beside_a_dense_group_and_when_rare(spark, dense, pairs, singles):
    x = vectors(dense, pairs, singles)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r for r in near_duplicate_vectors(frame).collect()}
    first = range(dense, dense + pairs)
    assert sum(got[i].n_links > 0 for i in first) >= 0.96 * pairs
    assert sum(got[i + pairs].component_id == i for i in first) >= 0.96 * pairs
    assert sum(got[i].n_links for i in range(dense)) >= 0.99 * dense * (dense - 1)
