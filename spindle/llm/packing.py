"""Best-two-fit packing of token sequences.

Bins are planned on the counts of each length, of which there are at most as
many as the capacity, so the plan stays small at any input size: a pattern is
a bin's lengths and how many bins look alike. Pieces then find their bin by
their rank among those of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm.common import scratch_path, sliced
from spindle.llm.tokens import text_encoder

#: Pieces of one length are ranked in groups of about so many, in at most so many groups.
RANK_GROUP, MOST_GROUPS = 128, 65536


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """``(lengths in a bin, number of such bins)`` for ``counts[length]`` pieces of each length.

    A bin takes the longest piece left, then again and again the longest that
    fits. Its smallest piece (not the first) is then replaced by two unpacked
    ones if they fill the gap that its removal leaves more tightly. Bins with
    the same lengths are made together, as often as the counts allow.
    """
    left = counts.astype(np.int64).copy()
    size = np.arange(capacity + 1)
    out: list[tuple[list[int], int]] = []
    while (some := np.flatnonzero(left[1:])).size:
        own = left.copy()
        bin_, gap = [int(some[-1]) + 1], capacity - int(some[-1]) - 1
        own[bin_[0]] -= 1
        while gap and (fits := np.flatnonzero(own[1 : gap + 1])).size:
            n = int(fits[-1]) + 1
            bin_.append(n)
            own[n] -= 1
            gap -= n
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            room = gap + smallest
            largest = np.maximum.accumulate(np.where(own[: room + 1] > 0, size[: room + 1], 0))
            a = np.flatnonzero(own[: room + 1] > 0)
            a = a[a > 0]
            b = largest[room - a]
            # the same length twice needs two pieces of it
            twice = (b == a) & (own[b] < 2)
            b = np.where(twice, largest[np.maximum(np.minimum(a - 1, room - a), 0)], b)
            fill = np.where(b > 0, a + b, 0)
            if fill.size and fill.max() > smallest:
                k = int(fill.argmax())
                bin_[-1:] = [int(a[k]), int(b[k])]
        lengths, need = np.unique(bin_, return_counts=True)
        times = int((left[lengths] // need).min())
        left[lengths] -= need * times
        out.append((sorted(bin_, reverse=True), times))
    return out


def slots(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks: pieces of ``length`` with ranks from ``first`` on go to bins from ``bin`` on, at ``offset``."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in patterns:
        at = 0
        for n in lengths:
            first = used.get(n, 0)
            rows.append((n, first, base, at))
            used[n] = first + times
            at += n
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "bin", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` added.

    ``pieces`` has a long column ``length`` from 1 to ``capacity`` (others are
    refused); ``order`` names columns that tell pieces apart. Equal rows are
    interchangeable. Ranks are counted in groups of equal length dealt by a
    hash, so that a frequent length is spread over many tasks. All other
    columns are kept; an empty table gives an empty table.
    """
    spark = pieces.sparkSession
    bad = pieces.where(f"length is null or length < 1 or length > {int(capacity)}").limit(1).count()
    if bad:
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    # at most `capacity` rows
    by_length = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in by_length.items():
        counts[n] = c
    runs = slots(best_two_fit(counts, capacity))
    groups = spark.createDataFrame(
        [(int(n), min(MOST_GROUPS, -(-int(c) // RANK_GROUP))) for n, c in by_length.items()], "length long, groups long"
    )
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("group", F.pmod(F.xxhash64(*order), "groups")).drop("groups")
    sizes = dealt.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "group", before.alias("before"))
    inner = Window.partitionBy("length", "group").orderBy(*order)
    ranked = dealt.withColumn("rank", F.row_number().over(inner) - 1).join(sizes, ["length", "group"])
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("before")).alias("rank"))
    key = (runs["length"] << 44) + runs["first"]
    columns = pieces.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = np.searchsorted(key, (n.astype(np.int64) << 44) + rank, "right") - 1
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            bins = runs["bin"][run] + rank - runs["first"][run]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins), pa.array(runs["offset"][run])], [*columns, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(of, f"{fields}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids, ended by ``end_id``, cut at ``capacity``.

    A null text is empty and gives one piece with ``end_id`` only. A null
    doc_id stays null; repeated rows give their pieces each.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = text_encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in sliced(batches):
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """``token_pieces`` of ``docs``, packed; the pieces are written once to the shared folder."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    pieces = token_pieces(docs, tokenizer, capacity)
    pieces.write.parquet(path)
    return pack(spark.read.schema(pieces.schema).parquet(path), capacity)
