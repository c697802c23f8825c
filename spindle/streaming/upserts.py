"""A table that a stream of records updates, such that a repeated batch changes nothing.

A micro-batch writes its changes to a folder named by its id, and then a row
in the manifest, which says that the folder is whole. A batch that was broken
off comes again with the same id and rows after a restart and overwrites what
it left. Readers take the folders that the manifest lists; the latest change
of a key counts. Compaction writes the present state as a folder of its own
and a row that says up to which batch it goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of a record's versions: the latest, by time, then batch, then content.
NEWEST = ("at", "batch", "body")
MANIFEST = "batch long, folder string, upto long, n_rows long, latest timestamp"


def _commit(spark: SparkSession, table: str, folder: str, batch: int, upto: int) -> None:
    rows = spark.read.parquet(f"{table}/{folder}").agg(F.count("*").alias("n_rows"), F.max("at").alias("latest"))
    row = rows.select(F.lit(batch).cast("long").alias("batch"), F.lit(folder).alias("folder"), F.lit(upto).cast("long").alias("upto"), "n_rows", "latest")
    row.coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/{folder}")


def upsert_batch(table: str, between: Callable[[], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` over ``id, at, body``; ``between`` runs after the data and before the manifest (for tests)."""

    def write(frame: DataFrame, batch: int) -> None:
        spark = frame.sparkSession
        newest = frame.where("id is not null").withColumn("batch", F.lit(batch).cast("long"))
        newest = newest.groupBy("id").agg(F.max(F.struct(*NEWEST)).alias("r")).select("id", "r.*")
        newest.write.mode("overwrite").parquet(f"{table}/batch-{batch}")
        if between is not None:
            between()
        _commit(spark, table, f"batch-{batch}", batch, batch)

    return write


def harvest_upserts(stream: DataFrame, table: str, checkpoint: str, between: Callable[[], None] | None = None):
    """Bring all records that the stream has now into the table; a restart goes on where the last one ended."""
    return stream.writeStream.foreachBatch(upsert_batch(table, between)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest(spark: SparkSession, table: str) -> DataFrame:
    """``batch, folder, upto, n_rows, latest``: the state of the harvest, a row for each batch or compaction."""
    return spark.read.schema(MANIFEST).parquet(f"{table}/manifest/*")


def current(spark: SparkSession, table: str) -> DataFrame:
    """``id, at, batch, body``: the newest version of each record in committed batches."""
    rows = manifest(spark, table).select("batch", "folder", "upto").collect()  # a row for each batch
    base = max((r for r in rows if r.folder.startswith("compact-")), key=lambda r: r.upto, default=None)
    folders = [r.folder for r in rows if r.folder.startswith("batch-") and (base is None or r.batch > base.upto)]
    folders += [base.folder] if base else []
    kind = "id string, at timestamp, batch long, body string"
    if not folders:
        return spark.createDataFrame([], kind)
    every = spark.read.schema(kind).parquet(*(f"{table}/{f}" for f in folders))
    return every.groupBy("id").agg(F.max(F.struct(*NEWEST)).alias("r")).select("id", "r.*")


def compact(spark: SparkSession, table: str) -> None:
    """Write the present state as one folder; batches up to then need not be read any more."""
    last = manifest(spark, table).agg(F.max("upto")).first()[0]
    if last is not None:
        current(spark, table).write.mode("overwrite").parquet(f"{table}/compact-{last}")
        _commit(spark, table, f"compact-{last}", last, last)
