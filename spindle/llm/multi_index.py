"""Embedding near-duplicates over an inverted multi-index.

Each half of the vectors has its own codebook, and a vector lies in the cell
of its two nearest codewords. A search visits cells by the sum of the halves'
distances, nearest first: it walks the two sequences of codewords side by side
and stops where the sum exceeds the least one by more than a margin. The margin
is the one that reached the wanted recall on measured queries, so a search
visits few cells where codewords lie apart and more where they lie close. What
it meets there is verified by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import written
from spindle.llm.components import connected_components, forest

#: Stored vectors of a cell that one task holds; fuller cells are cut into blocks.
BLOCK = 2048
PARTS = 1_000_000
#: Groups of near-copies among the queries that are enough to judge the margin by.
GROUPS = 64
#: Margins are measured in steps of this size.
STEP = 1e-4


def usable(name: str = "embedding"):
    """True for vectors without null or non-finite components that are not zero."""
    bad = F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(name, lambda x: x != 0)
    return F.col(name).isNotNull() & (F.size(name) > 0) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False))


def units(column: pa.Array, width: int) -> np.ndarray:
    """Vectors stored as little-endian doubles, scaled to length one."""
    x = np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class MultiIndex:
    """Two codebooks and how much farther than the nearest cell a search goes."""

    first: np.ndarray
    second: np.ndarray
    margin: float = 0.0

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return _squared(x[:, :cut], self.first), _squared(x[:, cut:], self.second)

    def home(self, x: np.ndarray) -> np.ndarray:
        d1, d2 = self.distances(x)
        return d1.argmin(1) * len(self.second) + d2.argmin(1)

    def nearest_cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells that a search from each row visits, nearest first and row by row, and their number by row."""
        d1, d2 = self.distances(x)
        o1, o2 = d1.argsort(1, kind="stable"), d2.argsort(1, kind="stable")
        d1, d2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        d1, d2 = d1 - d1[:, :1], d2 - d2[:, :1]
        # ranks of the first half that a search reaches, and of the second half beside each of them
        row, a = np.nonzero(d1 <= self.margin)
        left = self.margin - d1[row, a]
        wide = int((d2 <= self.margin).sum(1).max(initial=0))
        reached = (d2[row, :wide] <= left[:, None]).sum(1)
        pair = np.repeat(np.arange(len(row)), reached)
        b = np.arange(len(pair)) - np.repeat(np.cumsum(reached) - reached, reached)
        row, a = row[pair], a[pair]
        order = np.lexsort((d1[row, a] + d2[row, b], row))
        row, a, b = row[order], a[order], b[order]
        return o1[row, a] * d2.shape[1] + o2[row, b], np.bincount(row, minlength=len(x))

    def excess(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How much farther than the nearest cell the given one is from each row."""
        d1, d2 = self.distances(x)
        row = np.arange(len(x))
        return d1[row, cells // d2.shape[1]] - d1.min(1) + d2[row, cells % d2.shape[1]] - d2.min(1)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]


def codebook(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k-means of the rows of ``x``; an empty codeword moves to the row worst served."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        d = _squared(x, c)
        own = d.argmin(1)
        count = np.bincount(own, minlength=len(c))
        for j in range(x.shape[1]):
            c[:, j] = np.bincount(own, x[:, j], len(c)) / np.maximum(count, 1)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            c[empty] = x[np.argsort(-d.min(1))[: len(empty)]]
    return c


def fit_index(nodes: DataFrame, width: int, least: float, recall: float = 0.995, sample: int = 20_000, queries: int = 512) -> MultiIndex:
    """Codebooks from about ``sample`` vectors at most; the margin from ``queries`` measured searches, or eight times as many.

    The queries (chosen by a hash) are compared with all vectors in blocks, and
    the excess of each true partner's cell is counted; see ``_measured``. Where
    fewer than ``GROUPS`` groups are met, made-up partners are searched too. The number of codewords
    grows with the square root of the number of vectors, up to 1024 a half.
    """
    n = nodes.count()
    k = int(np.clip(round((n / 50) ** 0.5), 4, 1024))
    pick = lambda most, salt: nodes.where(F.pmod(F.xxhash64("tag", F.lit(salt)), F.lit(PARTS)) < int(min(PARTS, PARTS * most / max(n, 1))))
    got = pick(sample, 1).select("tag", "vector").toArrow().sort_by("tag")
    if not got.num_rows:
        return MultiIndex(np.zeros((1, width - width // 2)), np.zeros((1, width // 2)))
    x = units(got.column("vector"), width)
    cut = width - width // 2
    k = min(k, len(x))
    index = MultiIndex(codebook(x[:, :cut], k), codebook(x[:, cut:], k) if width > 1 else np.zeros((1, 0)))
    if recall > 1:
        index.margin = float("inf")
        return index
    for most in (queries, 8 * queries):
        groups, index.margin = _measured(nodes, index, pick(most, 2), width, least, recall)
        if groups >= GROUPS or most >= n:
            break
    if groups < GROUPS:
        # too few to judge by: also reach made-up partners at the limit
        index.margin = max(index.margin, _reach(index, x, least, recall))
    return index


def _measured(nodes: DataFrame, index: MultiIndex, picked: DataFrame, width: int, least: float, recall: float) -> tuple[int, float]:
    """Groups of the picked queries that have partners, and the margin that they need.

    Queries linked to each other are one group, and each group weighs one: the
    margin meets ``recall`` of the partners on the mean over the groups, and of
    each query's own partners in all but a hundredth of the weight.
    """
    own = picked.select("label", "tag", "vector").toArrow()
    if not own.num_rows:
        return 0, STEP
    q, label, tag = units(own.column("vector"), width), np.array(own.column("label").to_pylist()), own.column("tag").to_numpy()
    a, b = np.nonzero((q @ q.T >= least) & (label[:, None] == label))
    size = np.bincount(root := forest(len(q), a, b), minlength=len(q))[root]
    shared = nodes.sparkSession.sparkContext.broadcast((index, q, label, tag))  # the sampled vectors

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, q, label, tag = shared.value
        seen: dict[tuple[int, int], int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = units(batch.column(2), width)
                hit = (x @ q.T >= least) & (np.array(batch.column(0).to_pylist())[:, None] == label) & (batch.column(1).to_numpy()[:, None] != tag)
                i, j = np.nonzero(hit)
                for a in range(0, len(i), 4096):
                    part = slice(a, a + 4096)
                    steps = np.ceil(index.excess(q[j[part]], index.home(x[i[part]])) / STEP).astype(np.int64)
                    values, counts = np.unique(np.stack([j[part], steps]), axis=1, return_counts=True)
                    for v, c in zip(values.T.tolist(), counts.tolist(), strict=True):
                        seen[tuple(v)] = seen.get(tuple(v), 0) + c
        j, steps = ([k[i] for k in seen] for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int64()), pa.array(steps, pa.int64()), pa.array(list(seen.values()), pa.int64())], ["query", "steps", "n"])

    found = nodes.select("label", "tag", "vector").mapInArrow(of, "query long, steps long, n long").groupBy("query", "steps").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return 0, STEP
    query, steps, n = (found.column(c).to_numpy() for c in ("query", "steps", "n"))
    order = np.lexsort((steps, query))
    query, steps, n = query[order], steps[order], n[order].astype(float)
    total = np.bincount(query, n, len(q))
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    met = np.cumsum(n) - np.repeat((np.cumsum(n) - n)[first], np.diff(np.append(first, len(n))))
    enough = np.flatnonzero(met >= recall * total[query] - 1e-9)
    need = steps[enough[np.unique(query[enough], return_index=True)[1]]]
    weight = 1 / size
    mean = _weighted(steps, n / total[query] * weight[query], recall)
    low = _weighted(need, weight[query[first]], 0.99)
    return len(np.unique(root[query])), (max(mean, low) + 1) * STEP


def _weighted(values: np.ndarray, weight: np.ndarray, share: float) -> int:
    """The least value that with the smaller ones has that share of the weight."""
    order = np.argsort(values, kind="stable")
    sums = np.cumsum(weight[order])
    return int(values[order][min(np.searchsorted(sums, share * sums[-1] - 1e-9), len(order) - 1)])


def _reach(index: MultiIndex, x: np.ndarray, least: float, recall: float, most: int = 2000) -> float:
    """The margin that meets ``recall`` of partners at cosine ``least``, half of them towards other vectors, half anywhere."""
    rng = np.random.default_rng(5)
    x = x[rng.permutation(len(x))[:most]]
    to = np.where(np.arange(len(x))[:, None] % 2 == 0, x[rng.permutation(len(x))], rng.normal(size=x.shape))
    side = to - (to * x).sum(1, keepdims=True) * x
    length = np.sqrt((side * side).sum(1, keepdims=True))
    y = least * x + np.sqrt(max(0.0, 1 - least * least)) * side / np.where(length > 1e-9, length, 1)
    return float(np.quantile(index.excess(x, index.home(y)), min(recall, 1), method="higher")) + STEP


def _rows(index, width: int):
    """mapInArrow function: a stored row in a vector's own cell, a probe in every other cell it visits."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                cells, number = own.nearest_cells(units(batch.column("vector"), width))
                cells = cells.astype(np.int64)
                begin = np.cumsum(number) - number
                home, data = cells[begin], cells.astype("<i8").tobytes()
                lists = [data[8 * a : 8 * (a + n)] for a, n in zip(begin.tolist(), number.tolist(), strict=True)]
                row = np.repeat(np.arange(len(number)), number)
                first = np.zeros(len(cells), bool)
                first[begin] = True
                # a stored row carries the list of cells that it visits, a probe none
                for a in range(0, len(cells), 4096):
                    own_rows, stored = row[a : a + 4096], first[a : a + 4096]
                    some = batch.take(pa.array(own_rows))
                    yield pa.RecordBatch.from_arrays(
                        [some.column("label"), pa.array(cells[a : a + 4096]), pa.array((~stored).astype(np.int32)), pa.array(home[own_rows]),
                         some.column("first_id"), some.column("tag"), some.column("copies"), some.column("vector"),
                         pa.array([lists[r] if s else None for r, s in zip(own_rows.tolist(), stored.tolist(), strict=True)], pa.binary())],
                        ["label", "cell", "role", "home", "first_id", "tag", "copies", "vector", "visits"],
                    )

    return of


class _Cell:
    """The stored vectors of a cell (or block), and what is found for them."""

    def __init__(self, least: float):
        self.least, self.rows, self.x = least, [], []
        self.ready = False

    def store(self, batch: pa.RecordBatch, x: np.ndarray) -> None:
        self.rows.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("first_id", "tag", "copies")] + [batch.column("visits").to_pylist()])
        self.x.append(x)

    def close(self) -> None:
        self.ready = True
        self.ids, self.tags, self.copies = (np.concatenate([r[i] for r in self.rows]) if self.rows else np.zeros(0, np.int64) for i in range(3))
        visits = [np.frombuffer(v, "<i8") for r in self.rows for v in r[3]]
        # the cells that each stored vector visits, as one list of numbers
        self.seen = np.concatenate([(i << 32) + v for i, v in enumerate(visits)]) if visits else np.zeros(0, np.int64)
        self.x = np.concatenate(self.x) if self.x else np.zeros((0, 1))
        self.extra = np.zeros(len(self.ids), np.int64)
        self.tie_a: list[np.ndarray] = []
        self.tie_b: list[np.ndarray] = []

    def meet(self, ids, tags, copies, x, home, probe: bool, among: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """Compare rows with the stored ones; yield counts and edges.

        ``probe``: rows of other cells; a stored vector that does not visit
        their home cell is given the link here, as it finds them nowhere else.
        """
        if not len(self.ids):
            return
        for a in range(0, len(ids), 1024):
            part = slice(a, a + 1024)
            q, m = np.nonzero(x[part] @ self.x.T >= self.least)
            q = q + a
            if among:
                q, m = q[q != m], m[q != m]
            if not len(q):
                continue
            total = np.bincount(q, self.copies[m], len(ids)).astype(np.int64)
            who = np.flatnonzero(total)
            yield 1, ids[who], tags[who], total[who]
            first = np.full(len(ids), -1)
            first[q[::-1]] = m[::-1]
            self.tie_a.append(m)
            self.tie_b.append(first[q])
            if among:
                self.tie_a.append(q)
                self.tie_b.append(m)
            else:
                yield 0, ids[who], self.ids[first[who]], np.zeros(len(who), np.int64)
            if probe:
                unseen = ~np.isin((m << 32) + home[q], self.seen)
                self.extra += np.bincount(m[unseen], copies[q[unseen]], len(self.ids)).astype(np.int64)

    def rest(self) -> Iterator[tuple[np.ndarray, ...]]:
        if self.tie_a:
            root = forest(len(self.ids), np.concatenate(self.tie_a), np.concatenate(self.tie_b))
            i = np.flatnonzero(self.ids != self.ids[root])
            yield 0, self.ids[i], self.ids[root[i]], np.zeros(len(i), np.int64)
        i = np.flatnonzero(self.extra)
        yield 1, self.ids[i], self.tags[i], self.extra[i]


def _search(width: int, least: float):
    """mapInArrow function over rows sorted by cell and role (stored, copied, probing)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, None

        def out(found) -> Iterator[pa.RecordBatch]:
            for kind, a, b, n in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n)], ["kind", "a", "b", "n"])

        def closed() -> Iterator[pa.RecordBatch]:
            if not cell.ready:
                cell.close()
                yield from out(cell.meet(cell.ids, cell.tags, cell.copies, cell.x, None, False, among=True))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column("label").to_pylist(), batch.column("cell").to_pylist(), batch.column("block").to_pylist(), batch.column("role").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            x = units(batch.column("vector"), width)
            for a, b in zip(cuts, cuts[1:], strict=False):
                key, role, part = keys[a][:3], keys[a][3], batch.slice(a, b - a)
                if key != now:
                    if cell is not None:
                        yield from closed()
                        yield from out(cell.rest())
                    now, cell = key, _Cell(least)
                if role == 0:
                    cell.store(part, x[a:b])
                    continue
                yield from closed()
                ids, tags, copies, home = (part.column(c).to_numpy(zero_copy_only=False) for c in ("first_id", "tag", "copies", "home"))
                yield from out(cell.meet(ids, tags, copies, x[a:b], home, role == 1))
        if cell is not None:
            yield from closed()
            yield from out(cell.rest())

    return of


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98, recall: float = 0.995) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Rows are compared only where labels are equal and not null; vectors that
    are null, empty, zero or hold null or non-finite components, and rows
    without vec_id, link with nothing. Vectors of another length than the most
    frequent one are compared among themselves the same way. n_links counts
    other rows with cosine >= ``least`` that the index met, component_id is the
    smallest vec_id reachable, kept is vec_id = component_id (null ids: null).
    Equal vectors are one node with a number of copies. ``recall`` is the share
    of partners that the measured queries met.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>"))
    base = base.withColumn("ok", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable())
    base = base.withColumn("tag", F.xxhash64("label", "embedding")).withColumn("tag2", F.xxhash64(F.lit(1), "embedding", "label"))
    rows = written(base.select("vec_id", "ok", "tag", "tag2"), "vector-rows")
    nodes = base.where("ok").groupBy("tag", "tag2").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    found = None
    widths = [r.w for r in base.where("ok").groupBy(F.size("embedding").alias("w")).count().collect()]
    for width in sorted(widths):
        own = written(_packed(nodes.where(F.size("embedding") == width)), f"vectors-{width}")
        part = _links(own, width, least, recall)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "kind int, a long, b long, n long")
    found = written(found, "vector-links")
    parts = connected_components(found.where("kind = 0").select("a", "b"))
    counts = found.where("kind = 1").groupBy(F.col("a").alias("first_id"), F.col("b").alias("tag")).agg(F.sum("n").alias("n"))
    named = nodes.select("tag", "tag2", "first_id", "copies").join(counts, ["first_id", "tag"], "left").join(parts.withColumnRenamed("node", "first_id"), "first_id", "left")
    named = written(
        named.select("tag", "tag2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first_id").alias("component_id")), "vector-names"
    )
    out = rows.where("ok").join(named, ["tag", "tag2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _packed(nodes: DataFrame) -> DataFrame:
    """Vectors as bytes of little-endian doubles, which tasks read without a loop."""
    kind = nodes.schema["label"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array(v, "<f8").tobytes() for v in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "tag", "first_id", "copies")), pa.array(data, pa.binary())], ["label", "tag", "first_id", "copies", "vector"])

    return nodes.select("label", "tag", "first_id", "copies", "embedding").mapInArrow(of, f"label {kind}, tag long, first_id long, copies long, vector binary")


def _links(nodes: DataFrame, width: int, least: float, recall: float) -> DataFrame:
    """``kind, a, b, n``: kind 0, an edge of first_ids a and b; kind 1, n links of the node (first_id a, tag b)."""
    spark = nodes.sparkSession
    index = fit_index(nodes, width, least, recall)
    shared = spark.sparkContext.broadcast(index)
    label = nodes.schema["label"].dataType.simpleString()
    rows = nodes.mapInArrow(
        _rows(shared, width), f"label {label}, cell long, role int, home long, first_id long, tag long, copies long, vector binary, visits binary"
    )
    homes = nodes.mapInArrow(_home_only(shared, width), f"label {label}, cell long").groupBy("label", "cell").agg(F.count("*").alias("stored"))
    full = written(homes.where(F.col("stored") > BLOCK), "cells")
    if full.isEmpty():
        rows = rows.withColumn("block", F.lit(0).cast("long"))
    else:
        rows = rows.join(full, ["label", "cell"], "left")
        k = F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce("stored", F.lit(0)) / BLOCK))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("tag"), k)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), k - 1)))
        # stored vectors lie in one block and are copied to the others
        rows = rows.withColumn("role", F.when((F.col("role") == 0) & (F.col("block") != F.col("own")), 2).otherwise(F.col("role"))).drop("own", "stored")
    dealt = rows.repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", "role")
    return dealt.mapInArrow(_search(width, least), "kind int, a long, b long, n long")


def _home_only(index, width: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(index.value.home(units(batch.column("vector"), width)).astype(np.int64))], ["label", "cell"])

    return of
