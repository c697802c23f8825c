"""Batches over keys where one key that fails leaves the others complete."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from spindle.functions.lineage import stored


def isolated(rows: DataFrame, key: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``function`` of each key's rows, with ``key`` and ``error`` beside its columns.

    A key for which it raises gives one row that holds the error alone, one for
    which it gives no rows a row without values, so every key has rows. Null
    keys are left out. A key's rows are held by one task.
    """
    kinds = StructType.fromDDL(schema)
    whole = StructType([rows.schema[key], *kinds.fields]).add("error", StringType())
    names = [f.name for f in whole.fields]

    def of(group: pd.DataFrame) -> pd.DataFrame:
        own = group[key].iloc[0]
        try:
            out = function(group)
            missing = [f.name for f in kinds.fields if f.name not in out.columns]
            if missing:
                raise ValueError(f"no column {', '.join(missing)}")
            out = out.assign(error=None)
        except Exception as e:  # noqa: BLE001  (whatever one key does must not end the others)
            out = pd.DataFrame({**{f.name: [None] for f in kinds.fields}, "error": [f"{type(e).__name__}: {e}"]})
        if not len(out):
            out = pd.DataFrame({**{f.name: [None] for f in kinds.fields}, "error": [None]})
        return out.assign(**{key: own})[names]

    return rows.where(F.col(key).isNotNull()).groupBy(key).applyInPandas(of, whole)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``key, batch, n_rows, error`` of all batches in ``folder``; empty before the first."""
    kind = "key string, batch long, n_rows long, error string"
    try:
        return spark.read.schema(kind).parquet(f"{folder}/manifest/*")
    except AnalysisException:
        return spark.createDataFrame([], kind)


def run_batch(rows: DataFrame, key: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, folder: str, batch: int) -> DataFrame:
    """Run ``function`` for the keys that no earlier batch finished; return the batch's manifest.

    Outputs lie in ``folder/data``, a folder for each batch, and count once the
    batch's manifest is written. Keys that failed are tried again by the next
    batch. A batch that is repeated under its number overwrites its own files.
    """
    spark = rows.sparkSession
    earlier = manifest(spark, folder).where(f"error is null and batch <> {int(batch)}")
    open_rows = rows.join(earlier.select(F.col("key").alias("_done")).distinct(), F.col(key).cast("string") == F.col("_done"), "left_anti")
    made = stored(isolated(open_rows, key, function, schema), "batch")
    first = StructType.fromDDL(schema).fields[0].name
    made.where(F.col("error").isNull() & F.col(first).isNotNull()).drop("error").write.mode("overwrite").parquet(f"{folder}/data/batch={int(batch)}")
    entry = made.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(first).alias("n_rows"), F.max("error").alias("error"))
    entry = entry.select("key", F.lit(batch).cast("long").alias("batch"), "n_rows", "error")
    entry.write.mode("overwrite").parquet(f"{folder}/manifest/{int(batch)}")
    return spark.read.schema(entry.schema).parquet(f"{folder}/manifest/{int(batch)}")


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all finished batches."""
    done = [r.batch for r in manifest(spark, folder).select("batch").distinct().collect()]  # a row for each batch
    return spark.read.option("basePath", f"{folder}/data").parquet(*(f"{folder}/data/batch={b}" for b in done))
