"""Queries over harvests: paged segments, their completeness, streams of updates, and batches over experiments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from spindle.functions.lineage import scratch_path, stored
from spindle.operators.batches import manifest as batch_manifest
from spindle.operators.batches import outputs, run_batch
from spindle.operators.segments import segmented
from spindle.plans.registry import query
from spindle.sources.paged import deduplicated, harvest_report, read_pages, write_pages
from spindle.sources.views import associations, read, sql
from spindle.streaming.harvest import records as record_stream
from spindle.streaming.upserts import compact, current, harvest_upserts

#: Rows of a segment and of a page.
MOST, PAGE = 200, 60

#: Orders as records: some without a date, of these some without a name. Their segments: the first of year, month and day with few rows, or else
#: the shortest prefix of the name with few rows, or else all that is left.
SEGMENTS = f"""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS day, CASE WHEN o_orderkey % 3 <> 0 THEN c_name END AS name FROM orders JOIN customer ON o_custkey = c_custkey),
  d AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY year(day)) <= {MOST} THEN strftime(day, '%Y') WHEN count(*) OVER (PARTITION BY strftime(day, '%Y-%m')) <= {MOST} THEN strftime(day, '%Y-%m') ELSE strftime(day, '%Y-%m-%d') END AS segment FROM r WHERE day IS NOT NULL),
  k AS (SELECT id, name FROM r WHERE day IS NULL AND name IS NOT NULL), b AS (SELECT min(name) AS lo, max(name) AS hi FROM k), s AS (SELECT max(i) AS shared FROM b, range(0, 25) r(i) WHERE left(lo, i) = left(hi, i)),
  p AS (SELECT left(name, i) AS prefix, count(*) AS n FROM k, s, range(1, 25) r(i) WHERE i > shared AND length(name) >= i GROUP BY 1),
  seg AS (SELECT id, 'date' AS kind, segment FROM d UNION ALL SELECT id, 'name', (SELECT prefix FROM p WHERE starts_with(name, prefix) AND n <= {MOST} ORDER BY length(prefix) LIMIT 1) FROM k UNION ALL SELECT id, 'wildcard', '*' FROM r WHERE day IS NULL AND name IS NULL),
  sizes AS (SELECT segment, count(*) AS n FROM seg GROUP BY segment)"""


def _segments(spark, d):
    o, c = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), read(spark, d, "customer").select("c_custkey", "c_name")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date")).alias("day"), F.when(F.col("o_orderkey") % 3 != 0, F.col("c_name")).alias("name")
    )
    return segmented(rows, MOST)


def _harvest(spark, d, broken: bool):
    """Pages of all segments; the wildcard segment also gives what has a date and a third id. ``broken``: every fourth segment ends after its first page."""
    rows = stored(_segments(spark, d), "segments")
    value = F.to_json(F.struct(F.concat(F.lit("r"), "id").alias("_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("x"), "id")).otherwise("").alias("identifier")))
    again = rows.where("kind = 'date' and id % 30 = 0").withColumn("segment", F.lit("*"))
    every = rows.unionByName(again).select("segment", "id", value.alias("value"))
    expected = every.groupBy("segment").agg(F.count("*").alias("n"))
    write_pages(every, path := scratch_path(spark, "pages"), PAGE)
    fetched = read_pages(spark, path)
    if broken:
        cut = F.ascii(F.right("segment", F.lit(1))) % 4 == 0
        fetched = fetched.where(~cut | (F.col("page") == 1))
    return expected, fetched


@query("S13_segments", SEGMENTS + " SELECT kind, segment, count(*) AS n FROM seg GROUP BY ALL")
def s13_segments(spark, d):
    """Records by segment: dates first, then names, then the rest."""
    return _segments(spark, d).groupBy("kind", "segment").agg(F.count("*").alias("n"))


#: Segments as they are fetched, with the overlap.
FETCHED = SEGMENTS + ", every AS (SELECT id, segment FROM seg UNION ALL SELECT id, '*' FROM seg WHERE kind = 'date' AND id % 30 = 0), e AS (SELECT segment, count(*) AS n FROM every GROUP BY segment)"


@query("S12_paged_scan", FETCHED + f" SELECT segment, n AS expected, n AS fetched, ceil(n / {PAGE})::INTEGER AS pages, true AS complete FROM e")
def s12(spark, d):
    expected, fetched = _harvest(spark, d, broken=False)
    return harvest_report(expected, fetched)


@query("S14_overlapping_segments", FETCHED + " SELECT CASE WHEN id % 2 = 0 THEN 'x' ELSE 'r' END || id AS id, count(DISTINCT segment) AS segments FROM every GROUP BY id")
def s14(spark, d):
    """Every record once, with the number of segments that gave it."""
    return deduplicated(_harvest(spark, d, broken=False)[1]).select("id", "segments")


@query("B43_fetched_and_remaining", FETCHED + f", f AS (SELECT n, CASE WHEN ascii(right(segment, 1)) % 4 = 0 THEN least(n, {PAGE}) ELSE n END AS got FROM e) SELECT got = n AS complete, count(*) AS segments, sum(n)::BIGINT AS total, sum(got)::BIGINT AS fetched, sum(n - got)::BIGINT AS remaining FROM f GROUP BY 1")
def b43(spark, d):
    """What a harvest that was broken off in some segments has fetched, and what remains, by state."""
    expected, fetched = _harvest(spark, d, broken=True)
    report = harvest_report(expected, fetched)
    return report.groupBy("complete").agg(F.count("*").alias("segments"), F.sum("expected").alias("total"), F.sum("fetched").alias("fetched"), F.sum(F.col("expected") - F.col("fetched")).alias("remaining"))


@query("S15_resumable_harvest", "SELECT 'c' || o_custkey AS id, strftime(max(o_orderdate), '%Y-%m-%d') AS at, arg_max(o_orderkey, (o_orderdate, o_orderkey % 2, o_orderkey::VARCHAR)) AS orderkey FROM orders GROUP BY o_custkey")
def s15(spark, d):
    """The newest order of each customer: two rounds of a stream of record files into one table, compacted in between."""
    o = read(spark, d, "orders")
    line = F.to_json(F.struct(F.concat(F.lit("c"), "o_custkey").alias("_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00").alias("date"), F.lpad((F.col("o_orderkey") % 2).cast("string"), 1, "0").alias("a"), F.col("o_orderkey").cast("string").alias("b")))
    base = scratch_path(spark, "harvest")
    for part in (0, 1):
        o.where(F.col("o_orderkey") % 2 == part).select(line.alias("value")).write.mode("append").text(f"{base}/in")
        harvest_upserts(record_stream(spark, f"{base}/in"), f"{base}/table", f"{base}/checkpoint").awaitTermination()
        if part == 0:
            compact(spark, f"{base}/table")
    out = current(spark, f"{base}/table")
    return out.select("id", F.date_format("at", "yyyy-MM-dd").alias("at"), F.get_json_object("body", "$.b").cast("long").alias("orderkey"))


def _summary(group: pd.DataFrame) -> pd.DataFrame:
    """An experiment's genes and strongest fold change; a missing or impossible p-value is an error."""
    bad = group["adj_p"].isna() | (group["adj_p"] < 0)
    if bad.any():
        raise ValueError(f"{int(bad.sum())} impossible p-values")
    return pd.DataFrame({"genes": [group["gene"].nunique()], "strongest": [round(float(group["log2fc"].abs().max()), 6)]})


KINDS = "genes long, strongest double"
EXPERIMENT = sql("assoc", ", x AS (SELECT experiment, substr(experiment, 8)::INTEGER AS k, count(DISTINCT gene) AS genes, round(max(abs(log2fc)), 6) AS strongest, count(*) FILTER (WHERE gene % 50 = 0) AS bad FROM assoc GROUP BY ALL)")


@query("E14_isolated_batches", EXPERIMENT + """ SELECT experiment, 1::BIGINT AS batch, CASE WHEN k % 4 <> 1 OR bad = 0 THEN 1 ELSE 0 END::BIGINT AS n_rows, CASE WHEN k % 4 = 1 AND bad > 0 THEN 'ValueError: ' || bad || ' impossible p-values' END AS error, CASE WHEN k % 4 <> 1 OR bad = 0 THEN genes END AS genes, CASE WHEN k % 4 <> 1 OR bad = 0 THEN strongest END AS strongest FROM x WHERE k % 3 <> 0
  UNION ALL SELECT experiment, 2, 1, NULL, genes, strongest FROM x WHERE k % 3 = 0 OR k % 4 = 1 AND bad > 0""")
def e14_isolated(spark, d):
    """Two batches: in the first some experiments fail on bad rows, the second takes these, mended, and those that came since."""
    rows = associations(spark, d).select("experiment", "gene", "log2fc", "adj_p").withColumn("k", F.substring("experiment", 8, 9).cast("int"))
    bad = F.when((F.col("k") % 4 == 1) & (F.col("gene") % 50 == 0), -1.0).otherwise(F.col("adj_p"))
    folder = scratch_path(spark, "experiments")
    run_batch(rows.where("k % 3 <> 0").withColumn("adj_p", bad), "experiment", _summary, KINDS, folder, 1)
    run_batch(rows, "experiment", _summary, KINDS, folder, 2)
    entries = batch_manifest(spark, folder).withColumnRenamed("key", "experiment")
    return entries.join(outputs(spark, folder).select("experiment", F.col("batch").cast("long"), "genes", "strongest"), ["experiment", "batch"], "left")
