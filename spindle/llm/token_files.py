"""Token-id files of patched frame-of-reference blocks.

File: magic, number of documents, ids and blocks; doc_ids (int64), document
lengths (uint32), the byte start of every block (uint64), then the blocks. A
block of up to 1024 ids: minimum (uint32), number of ids (uint16), width
(uint8), unused (uint8), number of exceptions (uint16), unused (uint16), the
ids less the minimum packed at that width, positions (uint16) and values
(uint32) of those that do not fit. The width fits a percentile of the block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm.common import scratch_path, sliced, text_bytes, written
from spindle.llm.tokens import text_encoder

MAGIC = b"PFORIDS1"
BLOCK = 1024
HEAD = struct.Struct("<8sQQQ")
BLOCK_HEAD = np.dtype([("low", "<u4"), ("n", "<u2"), ("width", "u1"), ("_a", "u1"), ("odd", "<u2"), ("_b", "<u2")])
#: Stands for a null doc_id in a file.
NULL_ID = np.iinfo(np.int64).min
BITS_OF = np.array([int(i).bit_length() for i in range(65536)], np.uint8)


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    high = BITS_OF[x >> 16]
    return np.where(high > 0, high + 16, BITS_OF[x & 65535])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 n values below 2**width -> rows of width * n words."""
    rows = len(values)
    groups = values.reshape(-1, 64).astype(np.uint64)
    out = np.zeros((len(groups), width), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[:, word] |= groups[:, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= groups[:, k] >> np.uint64(64 - shift)
    return out.reshape(rows, -1)


def _unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    rows = len(words)
    if width == 0:
        return np.zeros((rows, n), np.uint32)
    groups, mask = words.reshape(-1, width), np.uint64((1 << width) - 1)
    out = np.empty((len(groups), 64), np.uint32)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        v = groups[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (groups[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = v & mask
    return out.reshape(rows, n)


def encode_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, percentile: float = 0.98) -> bytes:
    """The bytes of a file; ``lengths`` ids belong to each of ``doc_ids``, in order."""
    n_blocks = -(-len(ids) // BLOCK)
    blocks: list[bytes] = []
    for first in range(0, n_blocks, 512):
        own = ids[first * BLOCK : (first + 512) * BLOCK].astype(np.uint32)
        sizes = np.full(-(-len(own) // BLOCK), BLOCK)
        if len(own) % BLOCK:
            sizes[-1] = len(own) % BLOCK
            own = np.append(own, np.full(BLOCK - sizes[-1], own[-1], np.uint32))
        own = own.reshape(-1, BLOCK)
        low = own.min(1)
        rest = own - low[:, None]
        bits = _bit_lengths(rest).astype(np.int64)
        spread = np.bincount((np.arange(len(own))[:, None] * 33 + bits).ravel(), minlength=33 * len(own)).reshape(-1, 33)
        widths = (np.cumsum(spread, 1) >= percentile * BLOCK).argmax(1)
        made: list[bytes] = [b""] * len(own)
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            odd = bits[at] > w
            packed = _pack(np.where(odd, 0, rest[at]), int(w)) if w else np.zeros((len(at), 0), np.uint64)
            for i, b in enumerate(at):
                where = np.flatnonzero(odd[i]).astype("<u2")
                head = np.array([(low[b], sizes[b], w, 0, len(where), 0)], BLOCK_HEAD)
                made[b] = head.tobytes() + packed[i].tobytes() + where.tobytes() + rest[b, where].astype("<u4").tobytes()
        blocks += made
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]]) if blocks else np.zeros(0)
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), n_blocks)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), *blocks])


def decode_file(data: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc_ids, lengths, ids`` of a file; the ids are those of the blocks from ``first`` to before ``last``."""
    magic, n_docs, n_ids, n_blocks = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    at = HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    lengths = np.frombuffer(data, "<u4", n_docs, at := at + 8 * n_docs)
    starts = np.frombuffer(data, "<u8", n_blocks, at := at + 4 * n_docs).astype(np.int64)
    base = at + 8 * n_blocks
    last = n_blocks if last is None else min(last, n_blocks)
    out = np.zeros((max(last - first, 0), BLOCK), np.uint32)
    heads = np.array([np.frombuffer(data, BLOCK_HEAD, 1, base + s)[0] for s in starts[first:last]], BLOCK_HEAD)
    for w in np.unique(heads["width"]) if len(heads) else ():
        where = np.flatnonzero(heads["width"] == w)
        words = np.stack([np.frombuffer(data, "<u8", BLOCK // 64 * int(w), base + starts[first + i] + BLOCK_HEAD.itemsize) for i in where])
        out[where] = _unpack(words, int(w), BLOCK)
    for i, h in enumerate(heads):
        if h["odd"]:
            p = base + starts[first + i] + BLOCK_HEAD.itemsize + BLOCK // 8 * int(h["width"])
            out[i, np.frombuffer(data, "<u2", h["odd"], p)] = np.frombuffer(data, "<u4", h["odd"], p + 2 * int(h["odd"]))
    out += heads["low"][:, None] if len(heads) else 0
    ids = out.ravel()[: int(heads["n"].sum()) if len(heads) else 0]
    return doc_ids, lengths, ids


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, ids_per_file: int = 2_000_000, bytes_per_task: int = 16 << 20) -> DataFrame:
    """Encode ``docs`` into token-id files under ``path``; return ``file, n_docs, n_ids, start``.

    Documents lie in ascending order of doc_id over the files in name order
    (null first, equal doc_ids by text). A null text is empty and has just
    ``end_id``; no documents, no files. ``start`` counts the ids of all files
    before. A file is written under another name and then renamed, so a task
    that runs twice leaves the same files. The list is a table with a row for
    about ``ids_per_file`` ids; nothing comes to the driver.
    """
    tasks = max(8, -(-text_bytes(docs) // bytes_per_task))
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(tokenizer)
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        store, folder = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        doc_ids: list[int] = []
        lengths: list[int] = []
        chunks: list[bytes] = []
        held = written = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, written
            name = f"ids-{task.partitionId():07d}-{written:05d}.pfor"
            store.create_dir(folder)
            with store.open_output_stream(f"{folder}/.{name}.{task.taskAttemptId()}") as f:
                f.write(encode_file(np.array(doc_ids, np.int64), np.array(lengths, np.int64), np.frombuffer(b"".join(chunks), "<u4")))
            if store.get_file_info(f"{folder}/{name}").type != fs.FileType.NotFound:
                store.delete_file(f"{folder}/{name}")  # an earlier run of this task left the same file
            store.move(f"{folder}/.{name}.{task.taskAttemptId()}", f"{folder}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([len(doc_ids)], pa.int64()), pa.array([held], pa.int64())], ["task", "file", "n_docs", "n_ids"])
            for x in (doc_ids, lengths, chunks):
                x.clear()
            held, written = 0, written + 1
            return row

        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                doc_ids.append(NULL_ID if doc_id is None else doc_id)
                lengths.append(len(ids) // 4)
                chunks.append(ids)
                held += len(ids) // 4
                if held >= ids_per_file:
                    yield flush()
        if doc_ids:
            yield flush()

    files = written(dealt.mapInArrow(of, "task int, file string, n_docs long, n_ids long"), "token-file-list")
    sums = files.groupBy("task").agg(F.sum("n_ids").alias("all"))
    # a row for each task
    sums = sums.withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.sum("n_ids").over(Window.partitionBy("task").orderBy("file")) - F.col("n_ids")
    return files.withColumn("inner", inner).join(sums.select("task", "before"), "task").select("file", "n_docs", "n_ids", (F.col("before") + F.col("inner")).alias("start"))


def read_token_files(files: DataFrame, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files that ``write_token_files`` listed."""
    return _read(files, path, "ids binary", lambda raw: pa.array([x.tobytes() for x in raw], pa.binary()))


def token_file_digests(files: DataFrame, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the bytes in the files."""
    return _read(files, path, "ids_crc32 long", lambda raw: pa.array([zlib.crc32(x.tobytes()) for x in raw], pa.int64()))


def _read(files: DataFrame, path: str, column: str, make) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids, lengths, ids = decode_file(data.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                ids = ids.astype("<u4")
                for a in range(0, len(doc_ids), 2000):
                    part = slice(a, a + 2000)
                    raw = [ids[s:e] for s, e in zip(starts[part], ends[part], strict=True)]
                    own = doc_ids[part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()] * len(raw)), pa.array(own, mask=own == NULL_ID), pa.array(starts[part]), pa.array(lengths[part].astype(np.int64)), make(raw)],
                        ["file", "doc_id", "at", "n_tokens", column.split()[0]],
                    )

    spark = files.sparkSession
    if files.isEmpty():
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {column}")
    raw = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file"), "content")
    docs = raw.mapInArrow(of, f"file string, doc_id long, at long, n_tokens long, {column}")
    return docs.join(files.select("file", F.col("start").alias("base")), "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", column.split()[0])


def encoded_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to files in the shared folder and return ``token_file_digests`` of them."""
    path = scratch_path(docs.sparkSession, "token-files")
    return token_file_digests(write_token_files(docs, path, tokenizer), path)
