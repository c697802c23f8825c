"""Queries that build the sample index and read it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions.lineage import scratch_path
from spindle.plans.cohorts import BY_SERIES
from spindle.plans.registry import query
from spindle.sources.sample_index import ensure, newest, phrase_samples, series_samples
from spindle.sources.views import samples, sql

FRAMED = "' ' || trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')) || ' '"


def _index(spark, d) -> str:
    ensure(samples(spark, d), folder := scratch_path(spark, "sample-index"), f"{d}/documents.parquet", buckets=16)
    return folder


@query("S10_indexed_phrase_search", sql("samples", " SELECT sample FROM samples WHERE " + " OR ".join(f"contains({FRAMED.format(c)}, '{p}')" for c in ("title", "coalesce(source_name, '')") for p in (" of the ", " de la ", " web "))))
def s10_phrases(spark, d):
    """P17's search and one more phrase, from the index."""
    return phrase_samples(spark, _index(spark, d), ["of the", "de la", "WEB"])


@query("S10_series_samples", sql("samples", BY_SERIES + " SELECT series, sample FROM bys WHERE series IN (SELECT min(series) FROM bys UNION SELECT max(series) FROM bys)"))
def s10_series(spark, d):
    """The samples of the first and the last study."""
    folder = _index(spark, d)
    ends = samples(spark, d).select(F.explode(F.split("series_id", ",")).alias("s")).where("s like 'GSE%'").agg(F.min("s"), F.max("s")).first()
    return series_samples(spark, folder, [x for x in ends if x is not None])


@query("S11_staleness", "SELECT step, rebuilt, count(*) AS n_samples FROM documents, (VALUES ('first', true), ('unchanged', false), ('new version', true), ('other source', true)) t(step, rebuilt) GROUP BY ALL")
def s11(spark, d):
    """When an index is built again, and how many samples it then has."""
    own, folder = samples(spark, d), scratch_path(spark, "sample-index")
    steps = [("first", f"{d}/documents.parquet", "1"), ("unchanged", f"{d}/documents.parquet", "1"), ("new version", f"{d}/documents.parquet", "2"), ("other source", f"{d}/labels.parquet", "2")]
    rows: list[DataFrame] = []
    for step, source, version in steps:
        built = ensure(own, folder, source, buckets=4, version=version)
        rows.append(spark.range(1).select(F.lit(step).alias("step"), F.lit(built).alias("rebuilt"), F.lit(newest(spark, folder).n_samples).alias("n_samples")))
    return reduce(DataFrame.unionByName, rows)
