"""Removal of byte strings that also start in an earlier document, by suffix arrays.

Every window of ``length`` bytes has an anchor: the least hash among its
24-byte strings. Neighbouring windows with the same anchor form a segment, so
equal windows lie in segments of equal anchors. Documents are dealt into
shards once; then

1. shards send the anchors they hold, and learn which ones another document holds,
2. shards send the distinct segments of those anchors; a suffix array over the
   segments of an anchor range (induced sorting) and its permuted common
   prefixes bring equal windows together and give each the least doc_id,
3. shards learn that doc_id for their windows and cut the texts.

An anchor with very many different segments, as at the edges of a passage that
very many documents share, is dealt further by the windows' own hashes. Data
move as packed arrays, a row for each shard and anchor range; shards and ranges
grow with the square root of large inputs, so that rows do not become tiny.
"""

from __future__ import annotations

from itertools import count as numbers_from

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import text_bytes
from spindle.llm.suffix_array import permuted_prefixes, suffix_array

ANCHOR = 24
#: Windows whose anchors are computed at once, and bytes of one suffix array.
PIECE, ARRAY_BYTES = 1 << 15, 1 << 20
#: Bytes of text in a shard, bytes of text for an anchor range, and the least bytes of a row between them.
SHARD_BYTES, RANGE_BYTES, ROW_BYTES = 4 << 20, 2 << 20, 512
#: Bytes of text for a task.
TASK_BYTES = 24 << 20
#: An anchor with more different segments (as shards count them) is dealt by its windows.
HOT = 8192
#: Never occurs in UTF-8.
SEPARATOR = 255
_ODD = (0x9E3779B97F4A7C15, 0x7FB5D329728EA185, 0x81DADEF4BC2DD44D)
_ROW = "shard long, range long, n long, a binary, b binary, c binary"
_ROW_KINDS = pa.schema([("shard", pa.int64()), ("range", pa.int64()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_ODD[1])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_ODD[2])
    return h ^ (h >> np.uint64(33))


def anchors(data: np.ndarray, length: int, width: int) -> np.ndarray:
    """For every window of ``length`` bytes the place of its anchor, the leftmost string of the least hash."""
    # hashes of 2, 4, 8 and 16 bytes by doubling, then two overlapping ones for the width
    h = data.astype(np.uint32)
    h += np.uint32(1)
    size, power = 1, _ODD[0] & 0xFFFFFFFF
    while 2 * size <= width:
        h = h[:-size] * np.uint32(power) + h[size:]
        power = power * power % (1 << 32)
        size *= 2
    if size < width:
        h = h[: len(h) - (width - size)] * np.uint32(power) + h[width - size :]
    h ^= h >> np.uint32(15)
    h *= np.uint32(_ODD[1] & 0xFFFFFFFF)
    key = h.astype(np.uint64)
    key <<= np.uint64(32)
    key |= np.arange(len(key), dtype=np.uint64)
    span, reach = length - width + 1, 1
    while 2 * reach <= span:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < span:
        key = np.minimum(key[: len(key) - (span - reach)], key[span - reach :])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Strings:
    """Byte strings in a buffer, hashed and compared eight bytes at a time."""

    def __init__(self, data: np.ndarray, most: int):
        padded = np.append(data, np.zeros(most + 16, np.uint8))
        self.words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))

    def _word(self, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
        return self.words[start + np.minimum(k, size)] & _MASKS[np.clip(size - k, 0, 8)]

    def hashes(self, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
        h = size.astype(np.uint64) + np.uint64(seed)
        for k in range(0, int(size.max(initial=0)), 8):
            h = (h ^ self._word(start, size, k)) * np.uint64(_ODD[0])
            h ^= h >> np.uint64(29)
        return _mixed(h)

    def distinct(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first of each of the different strings, and the number of each string among them."""
        for seed in numbers_from():
            _, first, number = np.unique(self.hashes(start, size, seed), return_index=True, return_inverse=True)
            like = first[number]
            if (size[like] == size).all() and all((self._word(start, size, k) == self._word(start[like], size, k)).all() for k in range(0, int(size.max(initial=0)), 8)):
                return first, number
        raise AssertionError

    @staticmethod
    def joined(data: np.ndarray, start: np.ndarray, size: np.ndarray, gap: int = 0) -> np.ndarray:
        """The strings one after the other, each followed by ``gap`` separators."""
        step = size + gap
        out = np.full(int(step.sum()), SEPARATOR, np.uint8)
        inside = _counting(size)
        out[np.repeat(np.cumsum(step) - step, size) + inside] = data[np.repeat(start, size) + inside]
        return out


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of ``sizes``."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class Shard:
    """The documents of a shard in a fixed order, and their segments."""

    def __init__(self, table: pa.Table, length: int, bits: int):
        ids = table.column("doc_id").to_numpy()
        texts = table.column("text").cast(pa.large_binary()).combine_chunks()
        texts = (texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts).fill_null(b"")
        order = np.argsort(ids, kind="stable")
        if (np.diff(ids[order]) == 0).any():
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i].as_py())), np.int64)
        self.order, self.ids = order, ids[order]
        texts = texts.take(pa.array(order))
        offsets = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.ends = offsets[1:] - offsets[0]
        self.length, self.width, self.bits = length, min(ANCHOR, length), bits
        self.strings = Strings(self.data, length + length)

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every segment the place, the number of windows and the anchor (top ``bits`` + 32 bits of its hash)."""
        starts, counts, places = [], [], []
        for a in range(0, max(0, len(self.data) - self.length + 1), PIECE):
            at = anchors(self.data[a : a + PIECE + self.length - 1], self.length, self.width)
            # windows that cross into the next document
            b, e = np.searchsorted(self.ends, [a + 1, a + len(at) + self.length])
            crossing = (self.ends[b:e, None] - np.arange(1, self.length)).ravel() - a
            at[crossing[(crossing >= 0) & (crossing < len(at))]] = -1
            start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            count = np.diff(start, append=len(at))
            keep = at[start] >= 0
            starts.append(start[keep] + a)
            counts.append(count[keep])
            places.append(at[start[keep]] + a)
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        place = np.concatenate(places)
        codes = self.strings.hashes(place, np.full(len(place), self.width)) >> np.uint64(32 - self.bits)
        return np.concatenate(starts), np.concatenate(counts), codes

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """The different anchors, sorted, and for each its different segments (15 bits) and whether two documents hold it (high bit)."""
        start, count, codes = self.segments()
        doc = self.ids[np.searchsorted(self.ends, start, "right")]
        text = self.strings.hashes(start, count + self.length - 1)
        order = np.lexsort((text, codes))
        codes, doc, text = codes[order], doc[order], text[order]
        first = np.flatnonzero(np.append(codes[:1] == codes[:1], codes[1:] != codes[:-1]))
        if not len(first):
            return codes, np.zeros(0, np.uint16)
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        new = np.append(True, text[1:] != text[:-1])
        number = np.minimum(np.add.reduceat(new.astype(np.int64), first), 0x7FFF)
        return codes[first], (number | several.astype(np.int64) << 15).astype(np.uint16)

    def shared_segments(self, answers: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
        """Of every segment with a shared anchor the place, windows and code; hot ones as single windows.

        ``answers`` has, by anchor range, whether the shard's anchors are shared
        and hot, in their order.
        """
        start, count, codes = self.segments()
        mine, number = np.unique(codes, return_inverse=True)
        ranges = _ranges(mine, self.bits)
        found = np.zeros((2, len(mine)), bool)
        for r, flags in answers:
            a, b = np.searchsorted(ranges, [r, r + 1])
            found[:, a:b] = np.unpackbits(np.frombuffer(flags, np.uint8), count=2 * (b - a)).reshape(2, b - a)
        shared, hot = found[:, number]
        usual = shared & ~hot
        windows = np.repeat(start[hot], count[hot]) + _counting(count[hot])
        own = self.strings.hashes(windows, np.full(len(windows), self.length), 1) >> np.uint64(32 - self.bits)
        start = np.append(start[usual], windows)
        order = np.argsort(start, kind="stable")
        return start[order], np.append(count[usual], np.ones(len(windows), np.int64))[order], np.append(codes[usual], own)[order]


    def numbered(self, answers: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
        """Place and number of every segment with a shared anchor; then by number place, size, code and range.

        Segments are numbered by range, then by their first place, so that their least doc_ids rise.
        """
        start, count, codes = self.shared_segments(answers)
        first, number = self.strings.distinct(start, count + self.length - 1)
        order = np.lexsort((first, _ranges(codes[first], self.bits)))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first = first[order]
        return start, rank[number], start[first], count[first] + self.length - 1, codes[first], _ranges(codes[first], self.bits)


def _ranges(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes >> np.uint64(32)).astype(np.int64)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of every run of equal values."""
    if not len(values):
        return []
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return list(zip(begin.tolist(), np.append(begin[1:], len(values)).tolist(), strict=True))


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.table([pa.array(c, k) for c, k in zip(columns, _ROW_KINDS.types, strict=True)], schema=_ROW_KINDS)


def _columns(table: pa.Table, *names: str) -> list[tuple]:
    return list(zip(*(table.column(n).to_pylist() for n in names), strict=True))


def _read(parts: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def _window_minima(data: np.ndarray, start: np.ndarray, size: np.ndarray, codes: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """The least doc_id of every window of every segment, one after the other; a suffix array for each run of anchors."""
    windows = size - length + 1
    at = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)
    order = np.argsort(codes, kind="stable")
    # a group ends with an anchor
    filled = np.cumsum(size[order] + 1)
    last = np.flatnonzero(np.append(codes[order[1:]] != codes[order[:-1]], True))
    begin = 0
    while begin < len(order):
        full = last[np.searchsorted(filled[last], (filled[begin - 1] if begin else 0) + ARRAY_BYTES) :]
        end = int(full[0] if len(full) else last[-1]) + 1
        own = order[begin:end]
        begin = end
        text = Strings.joined(data, start[own], size[own], 1)[:-1]
        sa = suffix_array(text)
        same = permuted_prefixes(text, sa)[sa] >= length
        first = np.flatnonzero(~same)
        owner = np.repeat(least[own], size[own] + 1)[sa]
        value = np.empty(len(text), np.int64)
        value[sa] = np.repeat(np.minimum.reduceat(owner, first), np.diff(first, append=len(sa)))
        step = size[own] + 1
        inside = _counting(windows[own])
        out[np.repeat(at[own], windows[own]) + inside] = value[np.repeat(np.cumsum(step) - step, windows[own]) + inside]
    return out


def remove_repeats(docs: DataFrame, length: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``n_bytes, n_removed, spans, kept`` for every row of ``docs``.

    A byte of the text (UTF-8; null is empty) is removed if a string of
    ``length`` bytes that covers it also starts in a document with a smaller
    doc_id; strings are judged on the input and never cross documents.
    ``spans`` has the maximal removed runs (start, end), ``kept`` the other
    bytes. Rows with the same doc_id remove nothing from each other, rows
    without one neither remove nor lose anything. Texts shorter than ``length``
    stay whole. An empty table gives an empty table. One aggregation over the
    input measures its texts.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    extra = [f"kept_{i}" for i in range(len(keep))]
    kinds = "".join(f"{n} {docs.schema[k].dataType.simpleString()}, " for n, k in zip(extra, keep, strict=True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *(F.col(f"`{k}`").alias(n) for n, k in zip(extra, keep, strict=True)))
    size = text_bytes(rows)
    least = int((size * ROW_BYTES) ** 0.5)
    shards = max(8, -(-size // max(SHARD_BYTES, least)))
    bits = min(31, max(3, (-(-size // max(RANGE_BYTES, least)) - 1).bit_length()))
    tasks = max(8, -(-size // TASK_BYTES))
    # rows with one doc_id but different texts may lie in different shards
    own = rows.where("doc_id is not null").withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    texts = own.repartition(tasks, "shard").groupBy("shard")

    def send_anchors(key: tuple[pa.Scalar, ...], docs_of: pa.Table) -> pa.Table:
        codes, held = Shard(docs_of, length, bits).held()
        ranges = _ranges(codes, bits)
        return _table([(key[0].as_py(), int(ranges[a]), b - a, codes[a:b].astype("<u4").tobytes(), held[a:b].astype("<u2").tobytes(), None) for a, b in _runs(ranges)])

    def match_anchors(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        rows = _columns(sent, "shard", "n", "a", "b")
        codes, held = _read([r[2] for r in rows], "<u4"), _read([r[3] for r in rows], "<u2").astype(np.int64)
        _, number, times = np.unique(codes, return_inverse=True, return_counts=True)
        shared = (times > 1) | (np.bincount(number, held >> 15) > 0)
        hot = shared & (np.bincount(number, held & 0x7FFF) > HOT)
        out, at = [], 0
        for shard, n, _, _ in rows:
            i = number[at : at + n]
            out.append((shard, key[0].as_py(), n, np.packbits(np.append(shared[i], hot[i])).tobytes(), None, None))
            at += n
        return _table(out)

    def send_segments(key: tuple[pa.Scalar, ...], docs_of: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_of.num_rows:
            return _table([])
        shard = Shard(docs_of, length, bits)
        _, _, start, size, codes, ranges = shard.numbered(_columns(answers, "range", "a"))
        ids = shard.ids[np.searchsorted(shard.ends, start, "right")]
        out = []
        for a, b in _runs(ranges):
            head = codes[a:b].astype("<u4").tobytes() + size[a:b].astype("<u4").tobytes()
            data = shard.strings.joined(shard.data, start[a:b], size[a:b]).tobytes()
            out.append((key[0].as_py(), int(ranges[a]), b - a, head, data, np.diff(ids[a:b], prepend=0).astype("<i8").tobytes()))
        return _table(out)

    def match_segments(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        rows = _columns(sent, "shard", "n", "a", "b", "c")
        heads = [np.frombuffer(a, "<u4").reshape(2, n) for _, n, a, _, _ in rows]
        codes, size = np.concatenate([h[0] for h in heads]), np.concatenate([h[1] for h in heads]).astype(np.int64)
        least = np.concatenate([np.cumsum(np.frombuffer(c, "<i8")) for *_, c in rows])
        data = _read([b for _, _, _, b, _ in rows], np.uint8)
        counts = [r[:2] for r in rows]
        del rows, heads, sent
        start = np.cumsum(size) - size
        first, number = Strings(data, length + length).distinct(start, size)
        known = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(known, number, least)
        minima = _window_minima(data, start[first], size[first], codes[first], known, length)
        # runs of equal values within each segment
        windows = size[first] - length + 1
        new = np.append(np.ones(min(1, len(minima)), bool), minima[1:] != minima[:-1])
        new[np.cumsum(windows) - windows] = True
        at = np.flatnonzero(new)
        n_runs = np.diff(np.append(0, np.cumsum(new)[np.cumsum(windows) - 1]))
        run_size, run_doc, run_at = np.diff(at, append=len(minima)), minima[at], np.cumsum(n_runs) - n_runs
        out, a = [], 0
        for shard, n in counts:
            i = number[a : a + n]
            a += n
            k = n_runs[i]
            j = np.repeat(run_at[i], k) + _counting(k)
            out.append((shard, key[0].as_py(), n, k.astype("<u4").tobytes(), run_size[j].astype("<u4").tobytes(), run_doc[j].astype("<i8").tobytes()))
        return _table(out)

    def cut(key: tuple[pa.Scalar, ...], docs_of: pa.Table, answers: pa.Table) -> pa.Table:
        return _cut(Shard(docs_of, length, bits), docs_of, answers, extra)

    anchor_rows = texts.applyInArrow(send_anchors, _ROW)
    shared = anchor_rows.repartition(tasks, "range").groupBy("range").applyInArrow(match_anchors, _ROW)
    sent = texts.cogroup(shared.repartition(tasks, "shard").groupBy("shard")).applyInArrow(send_segments, _ROW)
    minima = sent.repartition(tasks, "range").groupBy("range").applyInArrow(match_segments, _ROW)
    # the answers of both steps, told apart by ``c``
    out = texts.cogroup(shared.unionByName(minima).repartition(tasks, "shard").groupBy("shard")).applyInArrow(
        cut, f"doc_id long, {kinds}n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    )
    rest = rows.where("doc_id is null").select(
        "doc_id", *extra, F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"),
    )
    names = [F.col(n).alias(k) for n, k in zip(extra, keep, strict=True)]
    return out.unionByName(rest).select("doc_id", *names, "n_bytes", "n_removed", "spans", "kept")


def _united(a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and document of the maximal runs that intervals from ``a`` to ``b`` cover; no interval crosses the end of a document, nor does a run."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    owner, reach = np.searchsorted(ends, a, "right"), np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] > reach[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return a[at], reach[np.append(at[1:], len(a)) - 1] if len(a) else b, owner[at]


def _cut(shard: Shard, docs_of: pa.Table, answers: pa.Table, extra: list[str]) -> pa.Table:
    """Step 3: the documents of a shard without the covered bytes."""
    rows = _columns(answers, "range", "a", "b", "c")
    start, number, *_ = shard.numbered([r[:2] for r in rows if r[3] is None])
    rows = sorted(r for r in rows if r[3] is not None)
    a = b = np.zeros(0, np.int64)
    if rows:
        n_runs = _read([r[1] for r in rows], "<u4").astype(np.int64)
        run_size, run_doc = _read([r[2] for r in rows], "<u4").astype(np.int64), _read([r[3] for r in rows], "<i8")
        run_at = np.cumsum(n_runs) - n_runs
        before = np.cumsum(run_size) - run_size
        k = n_runs[number]
        j = np.repeat(run_at[number], k) + _counting(k)
        a = np.repeat(start, k) + before[j] - np.repeat(before[run_at[number]], k)
        earlier = run_doc[j] < np.repeat(shard.ids[np.searchsorted(shard.ends, start, "right")], k)
        a, b = a[earlier], (a + run_size[j] + shard.length - 1)[earlier]
    begins = np.append(0, shard.ends[:-1])
    first, last, owner = _united(a, b, shard.ends)
    n_removed = np.bincount(owner, last - first, len(shard.ids)).astype(np.int64)
    # one byte for each byte of the shard: where a run begins and ends, summed up
    change = np.zeros(len(shard.data) + 1, np.int8)
    change[first] += 1
    change[last] -= 1
    stays = np.cumsum(change[:-1], dtype=np.int8) == 0
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(len(shard.ids) + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(first - begins[owner], pa.int64()), pa.array(last - begins[owner], pa.int64())], ["start", "end"]),
    )
    kept = shard.data[stays]
    offsets = np.append(0, np.cumsum(shard.ends - begins - n_removed)).astype("<i4")
    sorted_rows = docs_of.take(pa.array(shard.order, pa.int64()))
    return pa.table(
        [
            sorted_rows.column("doc_id"), *(sorted_rows.column(c) for c in extra), pa.array(shard.ends - begins, pa.int64()), pa.array(n_removed, pa.int64()),
            spans, pa.BinaryArray.from_buffers(pa.binary(), len(shard.ids), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]),
        ],
        ["doc_id", *extra, "n_bytes", "n_removed", "spans", "kept"],
    )
