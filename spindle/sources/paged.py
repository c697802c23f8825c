"""Segments of pages on disk as a Spark data source.

A harvest leaves a folder for each segment and in it a folder for each page,
``segment=<name>/page=<number>``. A segment is an input partition, or several
are one where they are many: the pages of a segment are read in order until
one is empty or missing, which ends it.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "segment string, page int, value string"
#: Lines of a batch, and partitions of a scan: a task for each of many small segments costs more than reading them.
LINES, PARTS = 5_000, 1_024


class Segments(InputPartition):
    """Pairs of folder and name."""

    def __init__(self, segments: list[tuple[str, str]]):
        super().__init__(segments)


class PagedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Segments]:
        """A partition for each segment, or for each ``PARTS``-th one in the order of their names."""
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted(i.base_name for i in found if i.type == fs.FileType.Directory and i.base_name.startswith("segment="))
        each = [(f"{root}/{n}", unquote(n.removeprefix("segment="))) for n in names]
        return [Segments(each[k::PARTS]) for k in range(min(PARTS, len(each)))] or [Segments([])]

    def read(self, partition: Segments) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        names, pages, values = [], [], []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pages, pa.int32()), pa.array(values, pa.string())], ["segment", "page", "value"])
            for column in (names, pages, values):
                column.clear()
            return out

        for folder, name in partition.value:
            page = 1
            while lines := page_lines(store, f"{folder}/page={page}"):
                for a in range(0, len(lines), LINES):
                    own = lines[a : a + LINES]
                    names += [name] * len(own)
                    pages += [page] * len(own)
                    values += own
                    if len(values) >= LINES:
                        yield batch()
                page += 1
        if values:
            yield batch()


def page_lines(store: fs.FileSystem, folder: str) -> list[str]:
    """The lines of a page, blank ones left out; none if it is not there."""
    files = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    out: list[str] = []
    for info in sorted(files, key=lambda i: i.base_name):
        if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
            with store.open_input_stream(info.path) as f:
                out += [line for line in f.read().decode("utf-8").split("\n") if line.strip()]
    return out


class PagedSource(DataSource):
    """``spark.read.format("paged").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options["path"])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``segment, page, value`` of all segments below ``path``; no segments, no rows."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").load(path)


def _left(path: str, size: int):
    """An Arrow function that writes sorted ``segment, place, value`` as pages; it gives the number of its pages."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        now, lines, n = None, [], 0

        def leave() -> None:
            folder = f"{root}/segment={quote(now[0], safe='')}/page={now[1] + 1}"
            store.create_dir(folder)
            # under its name once it is whole; a task that runs twice leaves the same pages
            own = f"{folder}/.part.{task.taskAttemptId() if task else 0}"
            with store.open_output_stream(own) as f:
                f.write("".join(f"{line or ''}\n" for line in lines).encode())
            store.move(own, f"{folder}/part.txt")

        for batch in batches:
            for segment, place, value in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                key = (segment, place // size)
                if key != now:
                    if lines:
                        leave()
                        n += 1
                    now, lines = key, []
                lines.append(value)
        if lines:
            leave()
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["pages"])

    return of


def write_pages(records: DataFrame, path: str, size: int) -> None:
    """Write ``records(segment, id, value)`` as pages of at most ``size`` lines, in the order of id.

    Pages are numbered within a segment; segments hold only as many rows as
    their planning allows, so one is numbered by a window. The task that has a
    segment writes its pages: a page is a small file, which costs Spark's
    writer, with its checksums and renaming, more than all the rest.
    """
    # a number keeps these tasks apart: pages are many files of few bytes, which would be dealt to a few tasks by their size
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.row_number().over(Window.partitionBy("segment").orderBy("id")) - 1
    placed = records.where("segment is not null").repartition(parts, "segment").select("segment", place.cast("long").alias("place"), "value")
    placed.mapInArrow(_left(path, size), "pages long").agg(F.sum("pages")).collect()


def harvest_report(expected: DataFrame, fetched: DataFrame) -> DataFrame:
    """``segment, expected, fetched, pages, complete`` of ``expected(segment, n)`` and ``fetched(segment, page)``."""
    got = fetched.groupBy("segment").agg(F.count("*").alias("fetched"), F.max("page").alias("pages"))
    out = expected.select("segment", F.col("n").alias("expected")).join(got, "segment", "left")
    count = F.coalesce("fetched", F.lit(0))
    return out.select("segment", "expected", count.alias("fetched"), F.coalesce("pages", F.lit(0)).alias("pages"), (count >= F.col("expected")).alias("complete"))


def deduplicated(fetched: DataFrame) -> DataFrame:
    """``id, segments, value``: records (JSON) once each by identifier or _id, where segments overlap; records without either are left out."""
    text = lambda f: F.nullif(F.get_json_object("value", f"$.{f}"), F.lit(""))
    rows = fetched.withColumn("id", F.coalesce(text("identifier"), text("_id"))).where("id is not null")
    return rows.groupBy("id").agg(F.countDistinct("segment").alias("segments"), F.min("value").alias("value"))
