"""A word and study index over sample metadata, built once and read by range.

The index is a table of postings (word, column, and lists of samples with
their positions), sorted and dealt by ranges of words into numbered buckets,
whose number grows with the text, and one of studies and their samples, sorted
the same way. A manifest row publishes a build: schema
version, state of the source (newest change, bytes, files), folder and size. Builds
are never changed; a reader takes the newest manifest row, a stale one is
followed by a new build.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.operators.cohort import series, tokens

VERSION = "2.1"
MANIFEST = "built long, version string, changed timestamp, bytes long, files long, folder string, n_samples long"
#: Columns of a sample that words are taken from.
FIELDS = ("title", "source_name")
#: Samples in a list of postings, bytes of text in a block, characters of text and samples in a bucket.
LIST, BLOCK, BUCKET, SAMPLES = 64, 8_000_000, 16_000_000, 1_000_000
KIND = "word string, sample string, field string, samples array<string>, ends array<int>, positions array<int>"
NAMES = ("word", "sample", "field", "samples", "ends", "positions")
#: Lists on their way to a bucket: the samples' bytes one after the other, and whole numbers of seven bits a byte.
SENT = "word string, sample string, field string, names binary, sizes binary, places binary"


def source_state(spark: SparkSession, path: str) -> DataFrame:
    """One row ``changed, bytes, files`` of the source's files; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("modificationTime", "length").agg(F.max("modificationTime").alias("changed"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def newest(spark: SparkSession, folder: str):
    """The manifest row of the newest build, or None."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/*")
    except AnalysisException:
        return None
    return rows.orderBy(F.desc("built")).first()  # a row for each build


def is_stale(spark: SparkSession, folder: str, source: str, version: str = VERSION) -> bool:
    """True without a build, or where the newest one has another version or another state of the source."""
    last, now = newest(spark, folder), source_state(spark, source).first()
    return last is None or last.version != version or (last.changed, last.bytes, last.files) != (now.changed, now.bytes, now.files)


def _lists(samples: pa.Array, texts: pa.Array, field: str) -> pa.RecordBatch:
    """Lists of postings of one field: texts are words between single spaces."""
    keep = pc.greater(pc.binary_length(texts), 0)
    samples, words = samples.filter(keep), pc.split_pattern(texts.filter(keep), " ")
    sizes = pc.list_value_length(words).to_numpy()
    coded = words.flatten().dictionary_encode()
    total = int(sizes.sum())
    row, position = np.repeat(np.arange(len(sizes)), sizes), np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code, row, position = code[order], row[order], position[order]
    # a posting: the places of a word in one text; a list: up to LIST postings of a word
    begin = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])][:total])
    own, rows = code[begin], row[begin]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    head = np.flatnonzero(rank % LIST == 0)
    bounds = np.r_[head, len(own)].astype(np.int32)
    places = np.r_[begin[head], total].astype(np.int32)
    ends = np.r_[begin[1:], total][: len(own)] - np.repeat(places[:-1], np.diff(bounds))
    lists = [pa.ListArray.from_arrays(pa.array(o), v) for o, v in ((bounds, samples.take(pa.array(rows))), (bounds, pa.array(ends, pa.int32())), (places, pa.array(position, pa.int32())))]
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(own[head])), samples.take(pa.array(rows[head])), pa.array([field] * len(head), pa.string()), *lists], names=NAMES)


def _varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (below 2**35, not negative) as bytes of seven bits, the lowest first, and where each ends."""
    n = 1 + sum((x >= 1 << b).astype(np.int64) for b in (7, 14, 21, 28))
    ends = np.cumsum(n)
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(int(n.max(initial=0))):
        own = np.flatnonzero(n > k)
        out[ends[own] - n[own] + k] = (x[own] >> 7 * k & 127) | (n[own] > k + 1) << 7
    return out, ends


def _numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that ``_varints`` wrote, and where each ends."""
    ends = np.flatnonzero(data < 128) + 1
    first = np.r_[0, ends][: len(ends)]
    place = np.arange(len(data)) - np.repeat(first, ends - first)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first) if len(ends) else np.zeros(0, np.int64), ends


def _bytes(data: np.ndarray | pa.Buffer, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), data if isinstance(data, pa.Buffer) else pa.py_buffer(data)])


def _content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the bounds of its rows in them."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def _packed(lists: pa.RecordBatch) -> pa.RecordBatch:
    """Lists as ``SENT``: a third of the bytes that arrays take in a shuffle."""
    if not lists.num_rows:
        return pa.RecordBatch.from_arrays([*lists.columns[:3], *[pa.array([], pa.binary())] * 3], names=["word", "sample", "field", "names", "sizes", "places"])
    samples, ends, positions = (lists[c] for c in ("samples", "ends", "positions"))
    bounds, first = samples.offsets.to_numpy(), positions.offsets.to_numpy()
    names, cuts = _content(samples.values.cast(pa.binary()))
    # the bounds of postings among all positions, and each position as its distance from the one before
    stops = ends.values.to_numpy() + np.repeat(first[:-1], np.diff(bounds))
    starts = np.r_[0, stops][: len(stops)]
    place = positions.values.to_numpy().astype(np.int64)
    steps = np.diff(place, prepend=0)
    steps[starts] = place[starts]
    sizes, a = _varints(np.column_stack([stops - starts, np.diff(cuts)]).ravel())
    places, b = _varints(steps)
    columns = [_bytes(names, cuts[bounds]), _bytes(sizes, np.r_[0, a][2 * bounds]), _bytes(places, np.r_[0, b][first])]
    return pa.RecordBatch.from_arrays([*lists.columns[:3], *columns], names=["word", "sample", "field", "names", "sizes", "places"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of ``SENT`` rows, as ``KIND``, about ``BLOCK`` bytes of places at a time."""
    for given in batches:
        if not given.num_rows:
            continue
        block = _content(given["places"])[1][1:] // BLOCK
        cuts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)].tolist()
        for first, end in zip(cuts, cuts[1:]):
            yield _lists_of(given.slice(first, end - first))


def _lists_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    (names, _), (sizes, own), (places, _) = (_content(batch[c]) for c in ("names", "sizes", "places"))
    pairs, a = _numbers(sizes)
    count, length = pairs[0::2], pairs[1::2]
    bounds = np.searchsorted(a, own, "right") // 2  # of rows among the postings
    stops = np.r_[0, np.cumsum(count)]
    steps, _ = _numbers(places)
    # a sum of all steps, less what it was where the posting began
    total = np.r_[0, np.cumsum(steps)]
    positions = total[1:] - np.repeat(total[stops[:-1]], count)
    ends = stops[1:] - np.repeat(stops[bounds[:-1]], np.diff(bounds))
    samples = _bytes(names, np.r_[0, np.cumsum(length)]).cast(pa.string())
    each = ((bounds, samples), (bounds, pa.array(ends, pa.int32())), (stops[bounds], pa.array(positions, pa.int32())))
    lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), v) for o, v in each]
    return pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=NAMES)


def _blocks(fields: Sequence[str]):
    """An Arrow function from ``sample`` and the words of each field to packed lists of postings, in blocks of about ``BLOCK`` bytes of text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            if not given.num_rows:
                continue
            size = sum(np.asarray(pc.fill_null(pc.binary_length(given[f]), 0), np.int64) for f in fields)
            block = np.cumsum(size) // BLOCK
            cuts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)].tolist()
            for a, b in zip(cuts, cuts[1:]):
                part = given.slice(a, b - a)
                yield from (_packed(_lists(part["sample"], part[f], f)) for f in fields)

    return of


def postings(samples: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Lists of the lower-case words of each column, packed as ``SENT``; unpacked: ``word, sample, field, samples, ends, positions``.

    A row lists at most ``LIST`` samples with the word, the first of them as
    ``sample``; the positions in the i-th one are those up to the i-th end.
    Tasks make the lists from their own samples, so nothing is sent before the
    sort.
    """
    words = samples.where("sample is not null").select("sample", *(F.trim(tokens(f)).alias(f) for f in fields))
    return words.mapInArrow(_blocks(fields), SENT)


def _bucketed(rows: DataFrame, key: str, path: str, buckets: int) -> None:
    """Write rows sorted by ``key`` in ranges, a folder for each, and the ends of the ranges."""
    ranged = rows.repartitionByRange(buckets, key, "sample")
    if "places" in rows.columns:
        ranged = ranged.mapInArrow(_unpacked, KIND)
    ranged = ranged.withColumn("bucket", F.spark_partition_id())
    # the writer's own order comes first, so that it does not sort again
    ranged.sortWithinPartitions("bucket", key, "sample").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/rows")
    spark = rows.sparkSession
    ends = spark.read.schema(f"{key} string, bucket int").parquet(f"{path}/rows").groupBy("bucket").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ends.coalesce(1).write.parquet(f"{path}/ends")


def build(samples: DataFrame, folder: str, source: str, buckets: int = 32, version: str = VERSION) -> None:
    """Build an index of ``samples(sample, series_id, title, source_name)`` and publish it.

    ``buckets`` is the least number; a bucket holds about ``BUCKET`` characters of text, or ``SAMPLES`` samples of studies.
    """
    spark = samples.sparkSession
    state = source_state(spark, source)
    own = f"build-{uuid.uuid4().hex}"
    size = samples.agg(F.count("sample").alias("n_samples"), F.sum(sum(F.coalesce(F.length(f), F.lit(0)) for f in FIELDS).cast("long")).alias("characters")).first()
    enough = lambda n, one: max(buckets, -(-(n or 0) // one))
    _bucketed(postings(samples), "word", f"{folder}/{own}/words", enough(size.characters, BUCKET))
    _bucketed(series(samples.where("sample is not null").select("sample", "series_id")).select("series", "sample").distinct(), "series", f"{folder}/{own}/studies", enough(size.n_samples, SAMPLES))
    last = newest(spark, folder)
    facts = [F.lit((last.built if last else 0) + 1).cast("long").alias("built"), F.lit(version).alias("version"), "changed", "bytes", "files", F.lit(own).alias("folder"), F.lit(size.n_samples).cast("long").alias("n_samples")]
    state.select(*facts).coalesce(1).write.parquet(f"{folder}/manifest/{own}")


def ensure(samples: DataFrame, folder: str, source: str, buckets: int = 32, version: str = VERSION) -> bool:
    """Build if the index is stale; tell whether it was built."""
    stale = is_stale(samples.sparkSession, folder, source, version)
    if stale:
        build(samples, folder, source, buckets, version)
    return stale


def lookup(spark: SparkSession, folder: str, table: str, keys: Sequence[str]) -> DataFrame:
    """Rows of ``words`` or ``studies`` with one of the keys, read from the buckets that can hold them."""
    last = newest(spark, folder)
    if last is None:
        raise ValueError(f"no index in {folder}")
    key, base = ("word" if table == "words" else "series"), f"{folder}/{last.folder}/{table}"
    ends = spark.read.schema("bucket int, low string, high string").parquet(f"{base}/ends").collect()  # a row for each bucket
    buckets = sorted({e.bucket for e in ends for k in keys if e.low <= k <= e.high})
    if not buckets:
        return spark.createDataFrame([], "word string, sample string, field string, positions array<int>" if table == "words" else "series string, sample string")
    kind = KIND if table == "words" else "series string, sample string"
    rows = spark.read.schema(f"{kind}, bucket int").parquet(f"{base}/rows")
    rows = rows.where(F.col("bucket").isin(*buckets) & F.col(key).isin(*keys)).drop("bucket")
    if table != "words":
        return rows
    before = lambda i: F.when(i > 0, F.element_at("ends", F.greatest(i, F.lit(1)))).otherwise(0)
    each = F.transform("samples", lambda s, i: F.struct(s.alias("sample"), F.slice("positions", before(i) + 1, F.element_at("ends", i + 1) - before(i)).alias("positions")))
    return rows.select("word", "field", F.inline(each)).select("word", "sample", "field", "positions")


def phrase_samples(spark: SparkSession, folder: str, phrases: Sequence[str], fields: Sequence[str] = FIELDS) -> DataFrame:
    """``sample`` of the samples that hold one of the phrases as consecutive words of a column."""
    split = [re.findall("[a-z0-9]+", p.lower()) for p in phrases]
    split = [words for words in split if words]
    found = lookup(spark, folder, "words", sorted({w for words in split for w in words})).where(F.col("field").isin(*fields))
    # for each place of a word in a phrase: where the phrase would begin
    places = [(w, k, i, len(words)) for k, words in enumerate(split) for i, w in enumerate(words)]
    if not places:
        return found.select("sample").limit(0)
    cells = [F.when(F.col("word") == w, F.struct(F.lit(k).alias("phrase"), F.lit(i).alias("place"), F.lit(n).alias("size"))) for w, k, i, n in places]
    each = found.select("sample", "field", "positions", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("at"))
    begins = each.select("sample", "field", "at.*", F.explode("positions").alias("position")).withColumn("begin", F.col("position") - F.col("place"))
    whole = begins.groupBy("sample", "field", "phrase", "begin").agg(F.count_distinct("place").alias("n"), F.first("size").alias("size")).where("n = size")
    return whole.select("sample").distinct()


def series_samples(spark: SparkSession, folder: str, wanted: Sequence[str]) -> DataFrame:
    """``series, sample`` of the wanted studies."""
    return lookup(spark, folder, "studies", list(wanted))
