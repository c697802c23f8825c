"""Partition planning for sources that return only so many rows a request."""

from __future__ import annotations

from functools import reduce
from os.path import commonprefix

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.lineage import cut


def prefix_segments(keys: DataFrame, most: int, longest: int = 24) -> DataFrame:
    """``prefix, n, complete``: prefixes of ``keys(key)`` that partition the rows, of at most ``most`` rows each.

    A prefix with more rows is extended by a character, level by level; rows
    that end with the prefix form a segment of their own (``complete`` false if
    they are too many, or at ``longest`` characters). Each level is an
    aggregation over the rows still open; null keys are left out.
    """
    open_rows, out = keys.where("key is not null").select("key"), []
    ends = open_rows.agg(F.min("key"), F.max("key")).first()
    # the prefix that all keys share cannot tell them apart
    shared = len(commonprefix([ends[0] or "", ends[1] or ""]))
    for k in range(min(shared + 1, longest), longest + 1):
        counted = open_rows.groupBy(F.left("key", F.lit(k)).alias("prefix"), (F.length("key") < k).alias("ended")).agg(F.count("*").alias("n"))
        counted = cut(counted)
        last = k == longest
        done = counted if last else counted.where((F.col("n") <= most) | F.col("ended"))
        out.append(done.select("prefix", "n", (F.col("n") <= most).alias("complete")))
        large = counted.where((F.col("n") > most) & ~F.col("ended")).select("prefix")
        if last or large.isEmpty():
            break
        open_rows = open_rows.withColumn("prefix", F.left("key", F.lit(k))).join(large, "prefix", "left_semi").select("key")
    return reduce(DataFrame.unionByName, out)


def date_segments(rows: DataFrame, most: int) -> DataFrame:
    """``day, segment, n, complete`` for each day of ``rows(day)``: its year, month or itself, the first of at most ``most`` rows (``n``).

    Days are counted first, so what follows is bounded by the calendar. Null days are left out.
    """
    days = rows.where("day is not null").groupBy("day").agg(F.count("*").alias("_1"))
    text = {k: F.date_format("day", k) for k in ("yyyy", "yyyy-MM", "yyyy-MM-dd")}
    for k, c in list(text.items())[:2]:
        days = days.withColumn(k, F.sum("_1").over(Window.partitionBy(c)))
    first, second = F.col("yyyy") <= most, F.col("`yyyy-MM`") <= most
    segment = F.when(first, text["yyyy"]).when(second, text["yyyy-MM"]).otherwise(text["yyyy-MM-dd"])
    n = F.when(first, F.col("yyyy")).when(second, F.col("`yyyy-MM`")).otherwise(F.col("_1"))
    return days.select("day", segment.alias("segment"), n.alias("n"), (n <= most).alias("complete"))


def segmented(records: DataFrame, most: int, longest: int = 24) -> DataFrame:
    """``records(day, name, ...)`` with ``kind, segment``: date segments first, then prefixes of names, then the rest.

    All records together are one segment (wildcard) where they are at most
    ``most``. A record without a day goes by its name, one without both is in
    the wildcard segment.
    """
    if records.limit(most + 1).count() <= most:
        return records.withColumn("kind", F.lit("wildcard")).withColumn("segment", F.lit("*"))
    days = date_segments(records, most).select("day", "segment")
    dated = records.join(F.broadcast(days), "day").withColumn("kind", F.lit("date"))  # a row for each day
    rest = records.where("day is null")
    named = rest.where("name is not null and name <> ''")
    prefixes = prefix_segments(named.select(F.col("name").alias("key")), most, longest).select("prefix").distinct() if not named.isEmpty() else None
    other = rest.where("name is null or name = ''").withColumn("kind", F.lit("wildcard")).withColumn("segment", F.lit("*"))
    out = dated.select(*records.columns, "kind", "segment").unionByName(other.select(*records.columns, "kind", "segment"))
    if prefixes is None:
        return out
    names = named.select("name").distinct()
    each = names.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("name"), F.lit(longest))), lambda k: F.left("name", k))))
    longest_one = each.join(prefixes, "prefix").groupBy("name").agg(F.max_by("prefix", F.length("prefix")).alias("segment"))
    named = named.join(longest_one, "name").withColumn("kind", F.lit("name"))
    return out.unionByName(named.select(*records.columns, "kind", "segment"))
