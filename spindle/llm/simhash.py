"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint of 64 bits is cut into parts; part i gets a threshold t_i, and
the sum of all (t_i + 1) is tau + 1. Two fingerprints at most tau bits apart
then agree in some part to within its threshold (-1: the part is not probed).
Correlated bits go into the same part, and a dynamic program over the estimated
number of candidates allots the thresholds. The statistics come from all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import mixed, sliced, written
from spindle.llm.components import connected_components, forest

SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Relative costs of writing one probe and of comparing one pair.
PROBE_COST, VERIFY_COST = 250.0, 1.0
#: Buckets of more fingerprints are cut into blocks, and tasks get pairs of blocks.
BLOCK = 4096
#: Texts in a block of those that are compared whole.
TEXTS = 256


def shingles(text: str | None, words: int) -> Iterator[bytes] | None:
    """All runs of ``words`` words (a shorter text is one run); None without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return None
    if len(tokens) < words:
        return iter([b" ".join(tokens)])
    return map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles, sorted."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, SEED) for g in shingles(text, words) or ()], np.uint64))


def set_fingerprint(hashes: np.ndarray, bits: int) -> bytes:
    """SimHash of a set of shingles, each counted once, as the Jaccard similarity does."""
    if not len(hashes):
        return bytes(bits // 8)
    ones = np.zeros(bits, np.int64)
    for a in range(0, len(hashes), 65536):
        _add_bits(ones, hashes[a : a + 65536])
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def _add_bits(ones: np.ndarray, h: np.ndarray) -> None:
    for k in range(len(ones) // 64):
        if k:  # further words come from the first hash
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31)) ^ np.uint64(k)
        ones[64 * k : 64 * k + 64] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: str | None, words: int = 3, bits: int = 64) -> bytes:
    """SimHash of ``text`` in ``bits`` bits (little-endian words of 64); see ``fingerprints``."""
    grams = shingles(text, words)
    if grams is None:
        return bytes(bits // 8)
    digest = xxhash.xxh64_intdigest
    ones, n, chunk = np.zeros(bits, np.int64), 0, []

    for g in grams:
        chunk.append(digest(g, SEED))
        if len(chunk) == 65536:
            _add_bits(ones, np.array(chunk, np.uint64))
            n += len(chunk)
            chunk.clear()
    if chunk:
        _add_bits(ones, np.array(chunk, np.uint64))
    n += len(chunk)
    return np.packbits(ones * 2 > n, bitorder="little").tobytes()


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as bytes, lowest bit first), one row per row of ``docs``.

    Words are separated by ASCII white space after A-Z are lower-cased; a bit
    is set if it is set in over half the hashes of all runs of ``words`` words
    (a shorter text is one run; without words no bit is set). A null text
    counts as empty. A null doc_id stays null. Other columns are ignored.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = [fingerprint(t.as_py(), words, bits) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, fp binary")


def _words(column: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, bits // 64)


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")


def bit_statistics(nodes: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bit i and bit j set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((bits, bits), np.float32), 0
        for batch in batches:
            if batch.num_rows:
                own = _bits(_words(batch.column(0), bits)).astype(np.float32)
                total += own.T @ own
                n += len(own)
        i, j = np.triu_indices(bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total[i, j], n).astype(np.int64))],
            ["i", "j", "n"],
        )

    rows = nodes.select("fp").mapInArrow(of, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    i, j, n = (rows.column(c).to_numpy() for c in ("i", "j", "n"))
    both = np.zeros((bits, bits))
    both[i[i >= 0], j[i >= 0]] = both[j[i >= 0], i[i >= 0]] = n[i >= 0]
    return int(n[i < 0].sum()), both


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the bits into ``parts`` parts; a part grows by the bit most correlated with it."""
    total = len(both)
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, out = np.ones(total, bool), []
    for k in range(parts):
        width = total // parts + (k < total % parts)
        rest = np.flatnonzero(free)
        part = [int(rest[corr[np.ix_(rest, rest)].max(1).argmax()])]
        free[part] = False
        near = corr[part[0]].copy()
        while len(part) < width:
            best = int(np.where(free, near, -1).argmax())
            part.append(best)
            free[best] = False
            near += corr[best]
        out.append(sorted(part))
    return out


def within(n: int, both: np.ndarray, part: list[int], most: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0, 1, ... ``most`` bits of the part."""
    p = np.diag(both)[part] / max(n, 1)
    differ = 2 * p * (1 - p)
    dist = np.zeros(most + 1)
    dist[0] = 1
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist)


def probes(width: int, t: int) -> int:
    total, c = 0, 1
    for k in range(t + 1):
        total += c
        c = c * (width - k) // (k + 1)
    return total


def plan(n: int, both: np.ndarray, tau: int, recall: float | None = None) -> tuple[list[list[int]], list[int]]:
    """The parts and thresholds of least estimated cost.

    A dynamic program spends units on the parts; a part costs its probes and
    the candidates that it is expected to bring. Exact (``recall`` None): a
    threshold t counts t + 1 units of tau + 1, and no pair within ``tau`` is
    missed. With ``recall``: it counts the logarithm by which it lowers the
    chance that a pair exactly ``tau`` bits apart agrees in no part, until that
    is 1 - recall; nearer pairs are missed more rarely.
    """
    bits = len(both)
    if recall is None:
        need, most = tau + 1, tau
        sizes = [(m, lambda width, t: t + 1) for m in range(2, tau + 2)]
    else:
        q = tau / bits
        need, most = int(np.ceil(-100 * np.log(1 - recall))), 2

        def gain(width: int, t: int) -> int:
            chance = sum(comb(width, k) * q**k * (1 - q) ** (width - k) for k in range(t + 1))
            return int(-100 * np.log(1 - chance)) if t >= 0 else 0

        sizes = [(max(2, bits // w), gain) for w in (10, 12, 14, 16, 20, 24)]
    best: tuple[float, list, list] | None = None
    for m, units in sizes:
        parts = grouped_bits(n, both, m)
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            near, after = within(n, both, part, most), {}
            options = [(0, 0.0, -1)]
            for t in range(most + 1):
                options.append((units(len(part), t), n * (probes(len(part), t) + (t > 0)) * PROBE_COST + n * n / 2 * near[t] * VERIFY_COST, t))
            for spent, (cost, ts) in state.items():
                for unit, own, t in options:
                    key, value = min(need, spent + unit), cost + own
                    if key not in after or value < after[key][0]:
                        after[key] = (value, [*ts, t])
            state = after
        if need in state and (best is None or state[need][0] < best[0]):
            best = (state[need][0], parts, state[need][1])
    if best is None:
        raise ValueError("no thresholds reach the wanted recall")
    return best[1], best[2]


def _probe_rows(parts: list[list[int]], thresholds: list[int], bits: int):
    """mapInArrow function: the keys under which a fingerprint is stored and probes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _bits(_words(batch.column(0), bits)).astype(np.int64)
            for k, (part, t) in enumerate(zip(parts, thresholds, strict=True)):
                if t < 0:
                    continue
                key = own[:, part] @ (1 << np.arange(len(part), dtype=np.int64))
                flips = [0] + [sum(1 << j for j in c) for r in range(1, t + 1) for c in combinations(range(len(part)), r)]
                for f in flips:
                    # role 0: stored and probing under its own value; role 1: probes a value nearby
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), k, np.int32)), pa.array(key ^ f), pa.array(np.full(len(key), int(f > 0), np.int32)), *batch.columns],
                        ["part", "key", "role", "fp", "first_id"],
                    )

    return of


def _pairs_within(fp: np.ndarray, role: np.ndarray, start: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked rows; ``start`` has the first row of each bucket, sorted."""
    n = len(fp)
    ends = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
    out_a, out_b = [], []
    i, d = np.arange(n), 1
    while len(i := i[i + d < ends[i]]):
        j = i + d
        far = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64)
        ok = ((role[i] == 0) | (role[j] == 0)) & (far <= tau)
        out_a.append(i[ok])
        out_b.append(j[ok])
        d += 1
    none = np.zeros(0, np.int64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def _linked(tau: int, bits: int):
    """mapInArrow function over rows sorted by bucket: a spanning forest of each bucket's links."""

    def edges(buckets: np.ndarray, role: np.ndarray, ids: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        start = np.flatnonzero(np.append(True, np.any(buckets[1:] != buckets[:-1], axis=1)))
        a, b = _pairs_within(fp, role, start, tau)
        if not len(a):
            return None
        root = forest(len(fp), a, b)
        i = np.flatnonzero(ids != ids[root])
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[root[i]])], ["a", "b"])

    return _by_bucket(edges, bits)


def _candidates(far: int, bits: int):
    """mapInArrow function over rows sorted by bucket: candidate links at most ``far`` bits apart.

    Only as many are given as connect what all candidates of a bucket connect,
    the nearest first: fewer than the rows of a bucket for each step in
    distance. Every link is a pair that was compared.
    """
    steps = sorted({far // 8, far // 4, far // 2, 3 * far // 4, far})

    def edges(buckets: np.ndarray, role: np.ndarray, ids: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        n = len(fp)
        start = np.flatnonzero(np.append(True, np.any(buckets[1:] != buckets[:-1], axis=1)))
        ends = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
        root, out, a, b = np.arange(n), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for most in steps:
            i, d = np.arange(n), 1
            while len(i := i[i + d < ends[i]]):
                open_ = i[(root[i] != root[i + d]) & ((role[i] == 0) | (role[i + d] == 0)) & (ids[i] != ids[i + d])]
                ok = open_[np.bitwise_count(fp[open_] ^ fp[open_ + d]).sum(1, dtype=np.int64) <= most]
                if len(ok):
                    # one link for each pair of trees
                    x, y = np.minimum(root[ok], root[ok + d]), np.maximum(root[ok], root[ok + d])
                    ok = ok[np.unique(x * n + y, return_index=True)[1]]
                    out.append((ids[ok], ids[ok + d]))
                    a, b = np.concatenate([a, ok]), np.concatenate([b, ok + d])
                    root = forest(n, a, b)
                d += 1
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b"])

    return _by_bucket(edges, bits)


def _joins(similarity: float, far: int, bits: int):
    """mapInArrow function over texts sorted by cluster and pair of blocks: verified links that join their groups.

    All texts of different groups that are candidates by their fingerprints are
    compared, but for those that links found here have joined by then; only
    these links are given, fewer than there are texts.
    """

    def links(ids: np.ndarray, groups: np.ndarray, blocks: np.ndarray, fp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        root = np.unique(groups, return_inverse=True)[1]
        size = np.array([len(x) for x in sets], np.float64)
        two = len(np.unique(blocks)) > 1
        out = []
        for i in range(len(ids) - 1):
            j = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (not two or blocks[i + 1 :] != blocks[i]))
            j = j[np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]) - 1e-9]
            for k in j[np.bitwise_count(fp[j] ^ fp[i]).sum(1, dtype=np.int64) <= far].tolist():
                if root[k] != root[i] and _similar(sets[i], sets[k], similarity):
                    out.append((int(ids[i]), int(ids[k])))
                    root[root == root[k]] = root[i]
        return out

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            ids, groups, blocks, fps, sets = zip(*held, strict=True)
            fp = np.frombuffer(b"".join(fps), "<u8").reshape(-1, bits // 64)
            found = links(np.array(ids), np.array(groups), np.array(blocks), fp, [np.frombuffer(x, np.uint64) for x in sets])
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in sliced(batches):
            for cluster, pair, *row in zip(*(batch.column(c).to_pylist() for c in ("cluster", "pair", "first_id", "group", "block", "fp", "hashes")), strict=True):
                if (cluster, pair) != key and held:
                    yield done()
                    held.clear()
                key = (cluster, pair)
                held.append(row)
        if held:
            yield done()

    return of


def _by_bucket(edges, bits: int):
    """mapInArrow function that calls ``edges`` on whole buckets of sorted rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, fps = np.zeros((0, 5), np.int64), np.zeros((0, bits // 64), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "key", "pair", "role", "first_id")]
            rows = np.concatenate([rows, np.stack(own, axis=1)])
            fps = np.concatenate([fps, _words(batch.column("fp"), bits)])
            # the last bucket may go on in the next batch
            last = int(np.flatnonzero(np.append(True, np.any(rows[1:, :3] != rows[:-1, :3], axis=1)))[-1])
            if last and (done := edges(rows[:last, :3], rows[:last, 3], rows[:last, 4].copy(), fps[:last])) is not None:
                yield done
            rows, fps = rows[last:], fps[last:]
        if len(rows) and (done := edges(rows[:, :3], rows[:, 3], rows[:, 4].copy(), fps)) is not None:
            yield done

    return of


def linked_fingerprints(nodes: DataFrame, tau: int = 3, bits: int = 64, recall: float | None = None) -> DataFrame:
    """``a, b``: links between nodes (``fp, first_id``) at most ``tau`` bits apart, by first_id.

    Of the links within a bucket a spanning forest is returned, so that the
    components are those of all links. A bucket of more than ``BLOCK`` rows is
    split again: fingerprints at most tau bits apart agree in one of tau + 1
    slices of the bits outside the part, so each row goes to tau + 1 finer
    buckets, however many rows there are. Where that is not possible, or not enough, buckets are cut into
    blocks and their pairs of blocks go to different tasks: no task holds more
    than two blocks of such a bucket.
    """
    n, both = bit_statistics(nodes, bits)
    parts, thresholds = plan(n, both, tau, recall)
    return _dealt(nodes, parts, thresholds, bits, tau).mapInArrow(_linked(tau, bits), "a long, b long")


def _finer(parts: list[list[int]], bits: int, tau: int):
    """mapInArrow function: rows of full buckets in a finer one for each of tau + 1 slices of the bits outside the bucket's part."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = _bits(_words(batch.column(3), bits)).astype(np.uint64) if batch.num_rows else None
            for k in np.unique(part).tolist():
                at = np.flatnonzero(part == k)
                rest = [j for j in range(bits) if j not in parts[k]]
                some = batch.take(pa.array(at))
                for i in range(tau + 1):
                    # buckets whose hashes meet are one, which costs comparisons and loses nothing
                    value = np.full(len(at), i, np.uint64) + mixed(key[at].view(np.uint64))
                    for j in range(0, len(cut := rest[i :: tau + 1]), 63):
                        value = mixed(value + own[np.ix_(at, cut[j : j + 63])] @ (np.uint64(1) << np.arange(len(cut[j : j + 63]), dtype=np.uint64)))
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(value.view(np.int64)), *some.columns[2:]], some.schema)

    return of


def _refined(rows: DataFrame, parts: list[list[int]], bits: int, tau: int) -> DataFrame:
    """``rows`` with those of full buckets in finer ones."""
    counts = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = written(counts.select("part", "key"), "full-buckets")
    if large.isEmpty():
        return rows
    full = rows.join(large, ["part", "key"], "left_semi").select("part", "key", "role", "fp", "first_id")
    return rows.join(large, ["part", "key"], "left_anti").select(*full.columns).unionByName(full.mapInArrow(_finer(parts, bits, tau), full.schema))


def _dealt(nodes: DataFrame, parts: list[list[int]], thresholds: list[int], bits: int, tau: int | None = None) -> DataFrame:
    """The stored rows and probes of ``nodes``, dealt and sorted by bucket and pair of blocks; ``tau``: no pair farther apart matters."""
    rows = nodes.select("fp", "first_id").mapInArrow(_probe_rows(parts, thresholds, bits), "part int, key long, role int, fp binary, first_id long")
    if tau is not None and tau < bits // 8:
        rows = _refined(rows, parts, bits, tau)
    counts = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = written(counts, "buckets")
    if large.isEmpty():
        blocks = rows.withColumn("pair", F.lit(0).cast("long"))
    else:
        # a row in block x goes to the pairs {x, y} for every y: each pair of blocks meets once
        rows = rows.join(large, ["part", "key"], "left")
        k = F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce("n", F.lit(0)) / (BLOCK // 2)))
        x = F.pmod(F.xxhash64("fp"), k)
        rows = rows.withColumn("k", k).withColumn("x", x).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        blocks = rows.withColumn("pair", F.least("x", "y") * F.col("k") + F.greatest("x", "y")).drop("n", "k", "x", "y")
    return blocks.repartition("part", "key", "pair").sortWithinPartitions("part", "key", "pair", "first_id")


def tau_for(similarity: float, bits: int) -> int:
    """Differing bits to be expected between texts of that Jaccard similarity, and half a standard deviation more."""
    cosine = 2 * similarity / (1 + similarity)
    p = float(np.arccos(cosine) / np.pi)
    return int(np.ceil(bits * p + 0.5 * np.sqrt(bits * p * (1 - p))))


def near_duplicates(docs: DataFrame, tau: int = 3, words: int = 3, bits: int = 64, recall: float | None = None) -> DataFrame:
    """``doc_id, fp, component_id``: one row per row of ``docs``.

    component_id is the smallest doc_id reachable over fingerprints at most
    ``tau`` bits apart, the row's own doc_id included. Equal fingerprints are
    one node, so copies are never paired. Without ``recall`` no link is lost;
    see ``plan``. Rows whose doc_id is null have a null component_id and link
    nothing. Repeated rows come out as often as they came in. An empty table
    gives an empty table.
    """
    if bits % 64 or tau < 0:
        raise ValueError("bits must be a multiple of 64, tau not negative")
    fps = written(fingerprints(docs, words, bits), "fingerprints")
    nodes = written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    found = connected_components(linked_fingerprints(nodes, tau, bits, recall)).withColumnRenamed("node", "first_id")
    named = nodes.join(found, "first_id", "left").select("fp", F.coalesce("component", "first_id").alias("component_id"))
    out = fps.join(written(named, "named"), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def similar_texts(docs: DataFrame, similarity: float = 0.8, words: int = 5, bits: int = 512, recall: float = 0.99) -> DataFrame:
    """``doc_id, text_key, node, component_id, first``: one row per row of ``docs`` with a doc_id.

    Two texts are linked if their sets of runs of ``words`` words have a Jaccard
    similarity of ``similarity`` or more, counted on 64-bit hashes of the runs;
    equal sets are one node. component_id is the smallest doc_id of the rows
    connected by links, ``first`` marks one text (of that doc_id) of each
    component; ``text_key`` is xxhash64 of the text.

    SimHash only finds the candidates: pairs up to four standard deviations
    above the expected distance, met with the chance ``recall`` at ``tau_for``.
    First only as many of them are verified as connect what all candidates
    connect, the nearest ones. Where one of these fails, the texts of the
    components on both sides are compared with each other in blocks, until they
    are joined; within a component no further pair matters. Pairs are compared
    inside tasks, only links that join components leave them.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    deviation = float(np.sqrt(bits * p * (1 - p)))
    far = int(np.ceil(bits * p + 4 * deviation))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            nodes, fps = [], []
            for t in batch.column(2):
                own = shingle_set(t.as_py(), words)
                nodes.append(_node(own))
                fps.append(set_fingerprint(own, bits))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes, pa.int64()), pa.array(fps, pa.binary())], ["doc_id", "text_key", "node", "fp"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    rows = written(texts.mapInArrow(of, "doc_id long, text_key long, node long, fp binary"), "fingerprints")
    nodes = written(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.min(F.struct("doc_id", "text_key")).alias("least")), "nodes")
    named = nodes.select("fp", F.col("node").alias("first_id"))
    n, both = bit_statistics(named, bits)
    parts, thresholds = plan(n, both, tau_for(similarity, bits), recall)

    def sets_of(ids: DataFrame) -> DataFrame:
        """``node, hashes`` of the distinct ``ids(node)``."""
        asked = nodes.join(ids, "node").select("node", "least.doc_id", "least.text_key")
        return written(texts.join(asked, ["doc_id", "text_key"]).select("node", "text").mapInArrow(_sets(words), "node long, hashes binary").dropDuplicates(["node"]), "sets")

    links = _dealt(named, parts, thresholds, bits).mapInArrow(_candidates(far, bits), "a long, b long")
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    sets = sets_of(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct())
    pairs = links.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    links = written(pairs.select("a", "b", "x", "y").mapInArrow(_jaccard(similarity), "a long, b long, ok boolean"), "verified")
    real = links.where("ok").select("a", "b")
    failed = links.where("not ok").select("a", "b")
    if not failed.isEmpty():
        # what a failed link holds apart: two candidates of different components have such a link on the way between them
        known = named.join(connected_components(real).withColumnRenamed("node", "first_id"), "first_id", "left").select("fp", "first_id", F.coalesce("component", "first_id").alias("group"))
        known = written(known, "known")
        group = lambda end, name: known.select(F.col("first_id").alias(end), F.col("group").alias(name))
        apart = failed.join(group("a", "x"), "a").join(group("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        clusters = written(connected_components(apart).select(F.col("node").alias("group"), F.col("component").alias("cluster")), "clusters")
        near = known.join(clusters, "group").join(sets.withColumnRenamed("node", "first_id"), "first_id")
        blocks = clusters.join(known, "group").groupBy("cluster").agg(F.ceil(F.count("*") / TEXTS).alias("k"))
        near = near.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("first_id"), "k")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        near = near.withColumn("pair", F.least("block", "other") * F.col("k") + F.greatest("block", "other"))
        dealt = near.select("cluster", "pair", "first_id", "group", "block", "fp", "hashes").repartition("cluster", "pair").sortWithinPartitions("cluster", "pair", "first_id")
        real = real.unionByName(written(dealt.mapInArrow(_joins(similarity, far, bits), "a long, b long"), "joins"))
    found = connected_components(real)
    whole = written(nodes.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "named")
    first = whole.groupBy("component").agg(F.min(F.struct("least", "node")).alias("m"))
    out = rows.drop("fp").join(whole.join(first, "component").select("node", "m"), "node")
    own = (F.col("node") == F.col("m.node")) & (F.col("doc_id") == F.col("m.least.doc_id")) & (F.col("text_key") == F.col("m.least.text_key"))
    return out.select("doc_id", "text_key", "node", F.col("m.least.doc_id").alias("component_id"), own.alias("first"))


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def _sets(words: int):
    """mapInArrow function: the shingle set of every text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data = [shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["node", "hashes"])

    return of


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _jaccard(similarity: float):
    """mapInArrow function: whether two sorted sets have that Jaccard similarity."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in (2, 3))
            ok = [_similar(x, y, similarity) for x, y in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return of
