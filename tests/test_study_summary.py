"""G13 ranks each source before the shuffle, without whole texts."""

from __future__ import annotations

from spindle.plans import cohorts, registry  # noqa: F401


def test_sources_are_limited_before_the_shuffle(spark, sf_dir):
    frame = registry.queries()["G13_study_summary"](spark, sf_dir)
    assert "WindowGroupLimit" in frame._jdf.queryExecution().optimizedPlan().toString()
