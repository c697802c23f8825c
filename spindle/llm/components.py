"""Connected components over an edge table, as joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import remove, scratch_path


def connected_components(edges: DataFrame) -> DataFrame:
    """Return ``node, component`` for every node of ``edges(a, b)``; both are longs.

    ``component`` is the smallest node reachable. Rows with a null end are left
    out, self loops and repeated edges change nothing, an empty table gives an
    empty table. Large-star and small-star steps alternate until every edge
    leads to the root of its component. Each step writes its edges and minima
    to the shared folder: the next one starts from files, and both sides of its
    join are plain exchanges, so that adaptive execution can split the hub of
    a large component.
    """
    spark = edges.sparkSession
    base = scratch_path(spark, "components")
    step = 0

    def kept(df: DataFrame, what: str) -> DataFrame:
        df.write.parquet(path := f"{base}/{step}-{what}")
        return spark.read.schema(df.schema).parquet(path)

    now = kept(
        edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        step += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "large")
        large = kept(
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(),
            "half",
        )
        least = kept(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = kept(moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        now_mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, f"{base}/{step - 1}-edges")
        for what in ("large", "half", "small"):
            remove(spark, f"{base}/{step}-{what}")
        now = after
        if mark == now_mark or now_mark[0] == 0:
            break
        mark = now_mark
    roots = now.groupBy("a").agg(F.min("b").alias("component"))
    return roots.select(F.col("a").alias("node"), "component").unionByName(
        roots.select(F.col("component").alias("node"), "component").distinct()
    )


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that it is linked with, over any steps."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
        root = root[root]
        if np.array_equal(root, before):
            return root
