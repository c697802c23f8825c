"""Interpolated modified Kneser-Ney trigrams, counted in Spark and read from mapped files.

A document is two starts, its words and one end; every word and end is an
event after two predecessors. Words get numbers, the frequent ones first.
Trigrams are dealt by their first two words, so that a part sees whole contexts;
what a part found goes on as bigrams, dealt by both words, and from there as
words, dealt by number. Between the steps go compressed arrays, one row for
each task and part, never a row for each n-gram.

Each part ends as one file of arrays sorted by hash: the start of every bucket,
32 bits of the hash for every entry, and a byte that says which of the part's
different values it has (rare values stand in a list of exceptions). Values are counts; discounts are eleven numbers that come
with them. Workers map the files into memory and score documents in whole
batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import mixed, remove, scratch_path, sliced, written

MAGIC = 0x4B4E3353
#: Stands for a row of values that is listed apart.
RARE = 255
#: Events that a task gathers before it counts them; the numbers of their words fit 21 bits each.
EVENTS = 1 << 20
#: Bytes of texts that a task takes at a time.
TEXTS = 2 << 20
#: Events, and different words, for each part of the counts (beyond 10**8, parts grow with the third root).
PART_EVENTS, PART_WORDS = 1_000_000, 1_000_000
#: Bytes of text that are hashed in one go.
WINDOW = 1 << 20
#: Stands for the end of a document among the hashes of words.
END = np.uint64(0x45D9F3B3335B369)
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUES[65:91] = _VALUES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES[SPACE] = 0
_STEP, _BACK = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for step in (_STEP, _BACK):
        x = np.full(n, step, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z as a-z), and the number of words of each; a null text is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    cuts = cuts - cuts[0] if len(cuts) else np.zeros(1, np.int64)
    word = ~SPACE[data]
    new = np.ones(len(data) + 1, bool)
    new[1:] = ~word
    new[cuts] = True
    begin = np.flatnonzero(word & new[:-1])
    after = np.ones(len(data), bool)
    after[:-1] = new[1:-1] | ~word[1:]
    end = np.flatnonzero(word & after) + 1
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + WINDOW, "right")))
        low, high = int(begin[i]), int(end[j - 1])
        power, back = _powers(1 << max(20, (high - low).bit_length()))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUES[data[low:high]] * power[: high - low], out=sums[1:])
        s, e = begin[i:j] - low, end[i:j] - low
        out[i:j] = mixed((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        i = j
    return out, np.diff(np.searchsorted(begin, cuts))


def hash2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a.astype(np.uint64) + np.uint64(1)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def hash3(ab: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mixed(ab + mixed(c.astype(np.uint64) ^ np.uint64(0x165667B19E3779F9)))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """``x`` (not negative) in the smallest unsigned type that holds it."""
    top = int(x.max(initial=0))
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns as compressed bytes, the lowest bytes of all rows first; the first column is sorted."""
    codec, out = pa.Codec("zstd", 1), []
    for k, x in enumerate(columns):
        x = _narrow(np.diff(x, prepend=0) if k == 0 else x)
        raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
        data = codec.compress(raw, asbytes=True)
        out += [np.array([x.itemsize, len(data)], "<i8").tobytes(), data]
    return b"".join(out)


def _restored(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd"), [], 0
    for k in range(columns):
        width, size = np.frombuffer(data, "<i8", 2, at)
        raw = codec.decompress(data[at + 16 : at + 16 + size], int(width) * n, asbytes=True)
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)
        out.append(np.cumsum(x) if k == 0 else x)
        at += 16 + int(size)
    return out


def _summed(keys: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Different tuples of numbers, in order, with the sums of ``n`` (without it, how often each occurs)."""
    size = len(keys[0])
    if not size:
        return keys, np.zeros(0, np.int64)
    top = max(int(k.max()) for k in keys)
    if top < 8 * size:  # numbers by rank among those that occur
        there = np.zeros(top + 1, bool)
        for k in keys:
            there[k] = True
        values, rank = np.flatnonzero(there), np.cumsum(there) - 1
        ranks = [rank[k] for k in keys]
    else:
        values, ranks = np.unique(np.concatenate(keys), return_inverse=True)
        ranks = np.split(ranks.ravel(), len(keys))
    bits = max(1, (len(values) - 1).bit_length())
    if bits * len(keys) > 63:
        order = np.lexsort(keys[::-1])
        first = np.flatnonzero(np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)))
        return [k[order[first]] for k in keys], np.add.reduceat(np.ones(size, np.int64) if n is None else n[order], first)
    packed = ranks[0]
    for r in ranks[1:]:
        packed = packed << bits | r
    if n is not None:
        order = np.argsort(packed)
        packed, n = packed[order], n[order]
    else:
        packed.sort()
    first = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
    packed = packed[first]
    out = [values[packed >> bits * k & (1 << bits) - 1] for k in reversed(range(len(keys)))]
    return out, np.diff(first, append=size) if n is None else np.add.reduceat(n, first)


def _save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """A file of arrays; a task that runs twice leaves the same file."""
    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place)
    task = TaskContext.get()
    own = f"{place}/.{name}.{task.taskAttemptId() if task else 'driver'}"
    head = [np.array([MAGIC, len(arrays)], "<i8")] + [np.array([len(a), a.itemsize], "<i8") for a in arrays]
    with store.open_output_stream(own) as f:
        f.write(b"".join(h.tobytes() for h in head))
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(b"\0" * (-a.nbytes % 8))
    if store.get_file_info(f"{place}/{name}").type != fs.FileType.NotFound:
        store.delete_file(f"{place}/{name}")
    store.move(own, f"{place}/{name}")


def _mapped(path: str) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory."""
    data = np.memmap(path, np.uint8, "r")
    magic, count = data[:16].view("<i8")
    if magic != MAGIC:
        raise ValueError("not a file of counts")
    sizes = data[16 : 16 + 16 * count].view("<i8").reshape(-1, 2)
    out, at = [], 16 + 16 * int(count)
    for n, width in sizes.tolist():
        out.append(data[at : at + n * width].view(f"<u{width}"))
        at += -(-n * width // 8) * 8
    return out


def _listed(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of columns, the most frequent first, and the place of each row among them."""
    code = columns[0]
    for c in columns[1:]:
        bits = max(1, int(c.max(initial=0)).bit_length())
        if int(code.max(initial=0)).bit_length() + bits > 63:
            code = np.unique(code, return_inverse=True)[1].ravel()
        code = code << bits | c
    _, first, code, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return [c[first[order]] for c in columns], place[code.ravel()]


def save_hashed(folder: str, name: str, keys: np.ndarray, *columns: np.ndarray, listed: bool = True) -> None:
    """A file with values by 64-bit ``keys``: buckets of about eight keys, and 32 bits of each key.

    ``listed``: the different rows of values once, and a byte for each key; the
    places of keys whose row is not among the first 255 stand in a list.
    """
    order = np.argsort(keys)
    keys, columns = keys[order], [c[order] for c in columns]
    bits = int(np.clip((len(keys) // 8).bit_length(), 1, 31))
    starts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    columns, code = _listed(columns) if listed else (columns, np.zeros(0, np.int64))
    shape, rest = np.array([bits, listed], np.uint64), (keys << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
    rare = np.flatnonzero(code >= RARE)
    _save(folder, name, shape, starts.astype(np.uint32), rest, np.minimum(code, RARE).astype(np.uint8), rare.astype(np.uint32), _narrow(code[rare]), *map(_narrow, columns))


class Hashed:
    """Values by key, from a file that ``save_hashed`` wrote."""

    def __init__(self, path: str):
        shape, self.starts, self.rest, self.code, self.rare, self.rare_code, *self.columns = _mapped(path)
        self.bits, self.listed = int(shape[0]), bool(shape[1])

    def of(self, keys: np.ndarray) -> list[np.ndarray]:
        """The columns' values for each key, zeros for keys that are not held, and whether a key is held."""
        n = len(self.rest)
        if not n:
            return [np.zeros(len(keys), np.int64) for _ in self.columns] + [np.zeros(len(keys), bool)]
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        low, high = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        want, end = (keys << np.uint64(self.bits) >> np.uint64(32)).astype(np.uint32), high
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            less = (self.rest[np.minimum(middle, n - 1)] < want) & (low < high)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        at = np.minimum(low, n - 1)
        held = (low < end) & (self.rest[at] == want)
        row = at
        if self.listed:
            row = self.code[at].astype(np.int64)
            odd = np.flatnonzero(row == RARE)
            row[odd] = self.rare_code[np.searchsorted(self.rare, at[odd])] if len(self.rare) else 0
        return [np.where(held, c[row], 0).astype(np.int64) for c in self.columns] + [held]


def discounts(n: np.ndarray) -> np.ndarray:
    """The discounts of counts 1, 2 and 3 or more, from how many n-grams have a count of 1, 2, 3 and 4.

    Where these numbers do not allow an estimate, it is half the count.
    """
    out = np.array([0.5, 1.0, 1.5])
    if n[0] > 0:
        y = n[0] / (n[0] + 2.0 * n[1])
        for k in range(3):
            d = k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] > 0 else -1
            out[k] = d if 0 < d < k + 1 else out[k]
    return out


@dataclass
class Model:
    """Where the files are, how many, and the numbers that hold for all of them."""

    folder: str
    mounted: bool
    parts: int
    word_parts: int
    words: int
    tokens: int
    by_count: dict[int, np.ndarray] = field(default_factory=dict)

    def of(self, name: str) -> Hashed:
        return Hashed(self.path(name))

    def path(self, name: str) -> str:
        """Where a worker finds a file: in the shared folder, or in its own copy."""
        folder = self.word_folder if name.startswith("words-") else self.folder
        return f"{fs.FileSystem.from_uri(folder)[1] if self.mounted else SparkFiles.get(folder.rpartition('/')[2])}/{name}"

    @property
    def word_folder(self) -> str:
        return f"{self.folder}-words"

    def range_of(self, part: int) -> int:
        """The first number of a part of the words."""
        return part * (self.words + 1) // self.word_parts


class Stream:
    """The events of a batch of texts as numbers of words."""

    def __init__(self, model: Model, texts: pa.Array, words: list[Hashed]):
        hashes, n = word_hashes(texts)
        self.sizes = n + 1
        ids = np.full(int(n.sum()) + 3 * len(n), model.words, np.int64)  # the start's number
        ends = np.cumsum(n + 3)
        inner = np.ones(len(ids), bool)
        first = ends - n - 3
        inner[first] = inner[first + 1] = inner[ends - 1] = False
        ids[inner], count = word_numbers(words, hashes, model)
        ids[ends - 1], last = word_numbers(words, np.array([END]), model)
        #: How often each event's word was counted.
        self.count = np.zeros(len(ids), np.int64)
        self.count[inner], self.count[ends - 1] = count, last
        event = np.ones(len(ids), bool)
        event[first] = event[first + 1] = False
        at = np.flatnonzero(event)
        self.u, self.v, self.w, self.count = ids[at - 2], ids[at - 1], ids[at], self.count[at]


def word_numbers(words: list[Hashed], hashes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The number and the count of each word; words that were not counted get the number behind the start's."""
    out, count = np.full(len(hashes), model.words + 1, np.int64), np.zeros(len(hashes), np.int64)
    for part, own in _by_part(part_of(hashes, model.word_parts)):
        number, count[own], held = words[part].of(hashes[own])
        out[own] = np.where(held, number, model.words + 1)
    return out, count


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if len(part):
        order = np.argsort(part.astype(np.uint16) if part.max() < 1 << 16 else part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
            yield int(part[order[a]]), order[a:b]


@lru_cache(maxsize=2)
def _word_files(folder: str, mounted: bool, parts: int) -> list[Hashed]:
    model = Model(folder, mounted, 0, parts, 0, 0)
    return [model.of(f"words-{p}") for p in range(parts)]


def _row_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds, parts, sizes, data = zip(*rows, strict=True) if rows else ([],) * 4
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(parts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], ["kind", "part", "n", "data"])


ROWS = "kind int, part long, n long, data binary"
#: Kinds of rows: n-grams of three, two and one words; counts of counts by order.
TRI, BI, UNI, COUNTS = 3, 2, 1, 0


def _dealt(kind: int, part: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each part, a few at a time."""
    rows, size = [], 0
    for p, own in _by_part(part):
        rows.append((kind, p, len(own), _squeezed(*(c[own] for c in columns))))
        size += len(rows[-1][3])
        if size > 4 << 20:
            yield _row_batch(rows)
            rows, size = [], 0
    if rows:
        yield _row_batch(rows)


def _counts_of(order: int, counts: np.ndarray) -> tuple[int, int, int, bytes]:
    """How many n-grams have a count of 1, 2, 3, 4, and how many there are."""
    return COUNTS, order, 0, np.append(np.bincount(np.minimum(counts, 5), minlength=6)[1:5], len(counts)).astype("<i8").tobytes()


def _count_trigrams(model: Model):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_files(model.folder, model.mounted, model.word_parts)
        held: list[Stream] = []

        def flush() -> Iterator[pa.RecordBatch]:
            u, v, w = (np.concatenate([getattr(s, c) for s in held]) for c in "uvw")
            held.clear()
            for a in range(0, len(u), EVENTS):
                (x, y, z), n = _summed([c[a : a + EVENTS] for c in (u, v, w)])
                yield from _dealt(TRI, part_of(hash2(x, y), model.parts), x, y, z, n)

        size = 0
        for batch in sliced(batches, rows=20_000, most=TEXTS):
            stream = Stream(model, batch.column(0), words)
            if held and size + len(stream.u) > EVENTS:
                yield from flush()
                size = 0
            held.append(stream)
            size += len(stream.u)
        if held:
            yield from flush()

    return of


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[int, bytes]]]]:
    """Rows of sorted batches, gathered by kind and part."""
    now, rows = None, []
    for batch in batches:
        for kind, part, n, data in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if (kind, part) != now:
                if rows:
                    yield *now, rows
                now, rows = (kind, part), []
            rows.append((n, data))
    if rows:
        yield *now, rows


def _gathered(rows: list[tuple[int, bytes]], columns: int) -> list[np.ndarray]:
    each = [_restored(data, n, columns) for n, data in rows]
    return [np.concatenate(c) for c in zip(*each, strict=True)]


def _of_counts(counts: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each run of counts: the sum, and how many are 1, 2, and 3 or more."""
    return [np.add.reduceat(x.astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts >= 3)]


def _keep_trigrams(model: Model):
    """Write a part's trigrams and contexts; its bigrams go on, each with the number of words before it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, rows in _by_key(batches):
            u, v, w, n = _gathered(rows, 4)
            (u, v, w), n = _summed([u, v, w], n)
            before = hash2(u, v)
            save_hashed(model.folder, f"trigrams-{part}", hash3(before, w), n)
            first = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
            save_hashed(model.folder, f"contexts-{part}", before[first], *_of_counts(n, first))
            yield _row_batch([_counts_of(3, n)])
            (v, w), n = _summed([v, w])
            yield from _dealt(BI, part_of(hash2(v, w), model.parts), v, w, n)

    return of


def _keep_bigrams(model: Model):
    """Write a part's bigrams; each word's share as context and as event goes on."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, part, rows in _by_key(batches):
            if kind == COUNTS:
                yield _row_batch([(kind, part, n, data) for n, data in rows])
                continue
            v, w, n = _gathered(rows, 3)
            (v, w), n = _summed([v, w], n)
            save_hashed(model.folder, f"bigrams-{part}", hash2(v, w), n)
            yield _row_batch([_counts_of(2, n)])
            first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            events, times = np.unique(w, return_counts=True)
            sums, none = _of_counts(n, first), np.zeros(len(events), np.int64)
            ids = np.concatenate([v[first], events])
            columns = [np.concatenate([c, none]) for c in sums] + [np.concatenate([np.zeros(len(first), np.int64), times])]
            order = np.argsort(ids, kind="stable")
            bounds = np.array([model.range_of(p) for p in range(model.word_parts)])
            yield from _dealt(UNI, np.searchsorted(bounds, ids[order], "right") - 1, ids[order], *(c[order] for c in columns))

    return of


def _keep_words(model: Model):
    """Write what is known of a part's words as arrays by number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, part, rows in _by_key(batches):
            if kind == COUNTS:
                yield _row_batch([(kind, part, n, data) for n, data in rows])
                continue
            low, high = model.range_of(part), model.range_of(part + 1)
            sums = [np.zeros(high - low, np.int64) for _ in range(5)]
            for n, data in rows:
                ids, *columns = _restored(data, n, 6)
                for total, c in zip(sums, columns, strict=True):
                    at = np.flatnonzero(c)
                    np.add.at(total, ids[at] - low, c[at])
            _save(model.folder, f"known-{part}", *map(_narrow, sums))
            yield _row_batch([_counts_of(1, sums[4][sums[4] > 0]), (COUNTS, 1, 1, np.array([(sums[4] >= 3).sum()], "<i8").tobytes())])

    return of


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words with their numbers, summed in the task as far as they fit."""
    keys, n, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def rows() -> Iterator[pa.RecordBatch]:
        for a in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000])], ["word", "n"])

    for batch in sliced(batches, rows=20_000, most=TEXTS):
        hashes, _ = word_hashes(batch.column(0))
        docs += batch.num_rows
        own, count = np.unique(hashes, return_counts=True)
        both = np.append(keys, own)
        keys, inverse = np.unique(both, return_inverse=True)
        n = np.bincount(inverse.ravel(), np.append(n, count), len(keys)).astype(np.int64)
        if len(keys) > 500_000:
            yield from rows()
            keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, n = np.append(keys, END), np.append(n, docs)
    if docs:
        yield from rows()


def _keep_numbers(model: Model):
    """Write a part's words: number and count by hash."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def saved() -> Iterator[pa.RecordBatch]:
            if rows:
                word, number, count = (np.concatenate(x) for x in zip(*rows, strict=True))
                save_hashed(model.word_folder, f"words-{now}", word.view(np.uint64), number, count, listed=False)
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64())], ["part"])

        for batch in batches:
            word, number, count, part = (batch.column(c).to_numpy() for c in range(4))
            for p, own in _by_part(part):
                if p != now:
                    yield from saved()
                    now, rows = p, []
                rows.append((word[own], number[own], count[own]))
        yield from saved()

    return of


def _parts(total: int, each: int) -> int:
    return max(1, -(-total // int(each * max(1.0, (total / 1e8) ** (1 / 3)))))


def train(texts: DataFrame) -> Model:
    """Count the trigrams of ``texts(text)`` and write the model's files to the shared folder."""
    spark = texts.sparkSession
    folder = scratch_path(spark, "trigram-model")
    counts = texts.select("text").mapInArrow(_word_rows, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    path = scratch_path(spark, "words")
    counts.repartitionByRange(F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word").withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    counted = spark.read.schema("word long, n long, row long").parquet(path)
    slots = counted.groupBy(F.shiftright("row", 33).alias("slot")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).orderBy("slot").collect()
    words, tokens = sum(r.k for r in slots), sum(r.n for r in slots)
    starts, at = [], 0
    for r in slots:  # a row for each range of the sort
        starts.append((r.slot, at))
        at += r.k
    model = Model(folder, mounted(folder), _parts(tokens, PART_EVENTS), _parts(words, PART_WORDS), words, tokens)
    if not words:
        return model
    number = F.col("start") + F.col("row").bitwiseAND((1 << 33) - 1)
    numbered = counted.withColumn("slot", F.shiftright("row", 33)).join(F.broadcast(spark.createDataFrame(starts, "slot long, start long")), "slot")
    part = F.shiftright(F.shiftrightunsigned("word", 32) * model.word_parts, 32).alias("part")
    dealt = numbered.select("word", number.alias("number"), "n", part).repartition("part").sortWithinPartitions("part")
    done = written(dealt.mapInArrow(_keep_numbers(model), "part long"), "word-files")
    held = {r.part for r in done.collect()}
    for p in set(range(model.word_parts)) - held:
        save_hashed(model.word_folder, f"words-{p}", np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2, listed=False)
    remove(spark, path)
    _given(spark, model, model.word_folder)
    return _count(texts, model)


def mounted(folder: str) -> bool:
    """Whether workers can map files of the shared folder; else each gets a copy."""
    return folder.startswith("file:")


def _given(spark, model: Model, folder: str) -> None:
    if not model.mounted:
        spark.sparkContext.addFile(folder, recursive=True)


def _count(texts: DataFrame, model: Model) -> Model:
    def dealt(df: DataFrame) -> DataFrame:
        # a sorted partition gives its parts one after the other
        return df.repartition("kind", "part").sortWithinPartitions("kind", "part")

    tri = dealt(texts.select("text").mapInArrow(_count_trigrams(model), ROWS)).mapInArrow(_keep_trigrams(model), ROWS)
    bi = dealt(tri).mapInArrow(_keep_bigrams(model), ROWS)
    rows = written(dealt(bi).mapInArrow(_keep_words(model), ROWS).select("part", "n", "data"), "counts-of-counts")
    for r in rows.collect():  # a row for each part and order
        if r.n == 0:
            model.by_count[r.part] = model.by_count.get(r.part, 0) + np.frombuffer(r.data, "<i8")
        else:
            model.by_count[0] = model.by_count.get(0, 0) + np.frombuffer(r.data, "<i8")
    store, place = fs.FileSystem.from_uri(model.folder)
    held = {f.base_name for f in store.get_file_info(fs.FileSelector(place))}
    for p in range(model.parts):
        for name, columns in ((f"trigrams-{p}", 1), (f"contexts-{p}", 4), (f"bigrams-{p}", 1)):
            if name not in held:
                save_hashed(model.folder, name, np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * columns)
    _given(texts.sparkSession, model, model.folder)
    return model


class Scorer:
    """Log probabilities from the mapped files."""

    def __init__(self, model: Model):
        self.model = model
        if not model.words:
            return
        self.words = _word_files(model.folder, model.mounted, model.word_parts)
        files = lambda kind: [model.of(f"{kind}-{p}") for p in range(model.parts)]
        self.trigrams, self.contexts, self.bigrams = files("trigrams"), files("contexts"), files("bigrams")
        self.known = [_mapped(model.path(f"known-{p}")) for p in range(model.word_parts)]
        self.bounds = np.array([model.range_of(p) for p in range(model.word_parts)])
        self.d = {k: discounts(model.by_count[k]) for k in (1, 2, 3)}
        n, total = model.by_count[1], float(model.by_count[2][4])
        d = self.d[1]
        rest = (d[0] * n[0] + d[1] * n[1] + d[2] * model.by_count[0][0]) / total
        self.total, self.floor = total, rest / (model.words + 1)

    def _taken(self, k: int, counts: np.ndarray) -> np.ndarray:
        d = np.append(0.0, self.d[k])
        return counts - d[np.minimum(counts, 3)]

    def _left(self, k: int, total: np.ndarray, *n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of contexts (sum, ones, twos, more): the sum, and the share that the discounts leave (1 where nothing is known)."""
        some = np.maximum(total, 1).astype(np.float64)
        return some, np.where(total > 0, sum(d * x for d, x in zip(self.d[k], n, strict=True)) / some, 1.0)

    @staticmethod
    def _of(files: list[Hashed], part: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(len(keys), np.int64) for _ in files[0].columns]
        for p, own in _by_part(part):
            for to, values in zip(out, files[p].of(keys[own]), strict=False):
                to[own] = values
        return out

    def _numbered(self, ids: np.ndarray) -> list[np.ndarray]:
        """What is known of words by number; zeros for unknown words."""
        out = [np.zeros(len(ids), np.int64) for _ in self.known[0]]
        for p, own in _by_part(np.searchsorted(self.bounds, ids, "right") - 1):
            at = ids[own] - self.bounds[p]
            ok = at < len(self.known[p][0])
            for to, values in zip(out, self.known[p], strict=True):
                to[own[ok]] = values[at[ok]]
        return out

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens, known ones, and log10 probabilities by counts of words alone and by the model."""
        model = self.model
        if not model.words:
            _, n = word_hashes(texts)
            return n + 1, np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))
        s = Stream(model, texts, self.words)
        # what depends on one word is looked up once for each
        words, at = np.unique(np.append(s.v, s.w), return_inverse=True)
        *context, events = self._numbered(words)
        at_v, at_w = np.split(at.ravel(), 2)
        base = np.log10((s.count + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
        one = (self._taken(1, events) / self.total + self.floor)[at_w]
        total, left = self._left(2, *context)
        pair = hash2(s.v, s.w)
        (n,) = self._of(self.bigrams, part_of(pair, model.parts), pair)
        two = self._taken(2, n) / total[at_v] + left[at_v] * one
        before = hash2(s.u, s.v)
        part = part_of(before, model.parts)
        total, left = self._left(3, *self._of(self.contexts, part, before))
        (n,) = self._of(self.trigrams, part, hash3(before, s.w))
        three = self._taken(3, n) / total + left * two
        first = np.cumsum(s.sizes) - s.sizes
        sums = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
        return s.sizes, sums((s.count > 0).astype(np.int64)), sums(base), sums(np.log10(three))


@lru_cache(maxsize=1)
def _scorer(folder: str, model) -> Scorer:
    return Scorer(model.value)


def language_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Rows where ``held_out`` is true are scored but not learned from. Tokens are
    the words of a text (A-Z as a-z, cut at ASCII white space) and one end; a
    null text is empty and has only its end. A null doc_id stays null, repeated
    rows are counted and scored each. Without training rows every score is 0
    (one unknown word takes all). Words and n-grams are told apart by 64 bits
    of hash (54 or more within a file). ``score`` is the log10 probability of
    the text, 10 ** (-score / n_tokens) its perplexity. A text is read in one
    piece.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = train(own.where("not held_out"))
    shared = spark.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value.folder, shared)
        for batch in sliced(batches, rows=20_000, most=TEXTS):
            tokens, known, base, score = scorer.score(batch.column(1))
            columns = [batch.column(0), batch.column(2), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = own.mapInArrow(of, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
