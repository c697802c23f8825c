"""Deduplication operators against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import xxhash

from spindle.llm import simhash, suffix_dedup
from spindle.llm import suffix_array as arrays
from spindle.llm.components import connected_components
from spindle.llm.multi_index import MultiIndex, near_duplicate_vectors
from spindle.llm.suffix_dedup import remove_repeats


def roots(nodes, edges) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2200)] + [(5, 5)]
    frame = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == roots({n for e in real for n in e}, real)
    assert connected_components(frame.limit(0)).count() == 0


def plain_fingerprint(text: str) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_links_all_within_three_bits(docs, no_docs):
    rows = docs.collect()
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {(r.doc_id, plain_fingerprint(r.text or "")) for r in rows}
    known = sorted((i, f) for i, f in fps if i is not None)
    edges = [(a, b) for a, f in known for b, g in known if a < b and (f ^ g).bit_count() <= 3]
    component = roots([i for i, _ in known], edges)
    assert got == {(i, f.to_bytes(8, "little"), component.get(i)) for i, f in fps}
    assert simhash.near_duplicates(docs).count() == len(rows)
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("block", [8, 4096])
def test_planned_probes_lose_no_pair(spark, monkeypatch, block):
    """Clustered fingerprints, unequal parts and cut buckets; every plan is tried by changing the costs."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:12]:
        for _ in range(8):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(bytearray(f.to_bytes(8, "little")), i) for i, f in enumerate(fps)], "fp binary, first_id long")
    expected = roots(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    for cost in (0.001, 250.0) if block > 8 else (250.0,):
        monkeypatch.setattr(simhash, "PROBE_COST", cost)
        found = connected_components(simhash.linked_fingerprints(nodes)).collect()
        got = {i: i for i in range(len(fps))} | {r.node: r.component for r in found}
        assert got == expected


def test_plans_satisfy_the_principle():
    rng = np.random.default_rng(0)
    bits = (rng.random((500, 64)) < np.linspace(0.1, 0.9, 64)).astype(float)
    bits[:, 1] = bits[:, 0]
    both = bits.T @ bits
    for n in (500, 10**6, 10**10):
        parts, thresholds = simhash.plan(n, both, 3)
        assert sorted(b for p in parts for b in p) == list(range(64))
        assert sum(t + 1 for t in thresholds) >= 4
        assert any(0 in p and 1 in p for p in parts)


def test_long_fingerprints_find_similar_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, groups = [], []
    for g in range(12):
        base = [word() for _ in range(200)]
        own = []
        for k in range(4):
            text = list(base)
            for _ in range(2 * (k > 0)):
                text[rng.randrange(200)] = word()
            own.append(len(rows))
            rows.append((len(rows), " ".join(text)))
        groups.append(own)
    singles = range(len(rows), len(rows) + 40)
    rows += [(i, " ".join(word() for _ in range(150))) for i in singles]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tau=simhash.tau_for(0.8, 512), words=5, bits=512, recall=0.98)
    component = {r.doc_id: r.component_id for r in found.collect()}
    assert all(component[i] == i for i in singles)
    assert sum(component[i] == own[0] for own in groups for i in own) >= 46


@pytest.mark.parametrize("short", [4, 1 << 17])
def test_suffix_arrays(monkeypatch, short):
    """Random, periodic and constant texts; with a small ``short`` the recursion goes down to the last names."""
    monkeypatch.setattr(arrays, "SHORT", short)
    rng = np.random.default_rng(1)
    for turn in range(300):
        n, k = int(rng.integers(0, 150)), int(rng.choice([1, 2, 3, 4, 256]))
        text = rng.integers(0, k, n).astype(np.uint8)
        if turn % 4 == 0 and n:
            text = np.resize(text[: int(rng.integers(1, 9))], n)
        data = text.tobytes()
        sa = arrays.suffix_array(text)
        assert sa.tolist() == sorted(range(n), key=lambda i: data[i:])
        prefixes = arrays.permuted_prefixes(text, sa)
        for a, b in zip(sa.tolist(), sa[1:].tolist(), strict=False):
            same = 0
            while max(a, b) + same < n and data[a + same] == data[b + same]:
                same += 1
            assert prefixes[b] == same


def brute_repeats(rows, length: int) -> list[tuple]:
    first: dict[bytes, int] = {}
    for doc_id, data in rows:
        for k in range(len(data) - length + 1 if doc_id is not None else 0):
            s = data[k : k + length]
            first[s] = min(doc_id, first.get(s, doc_id))
    out = []
    for doc_id, data in rows:
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1 if doc_id is not None else 0):
            if first[data[k : k + length]] < doc_id:
                gone[k : k + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).tolist()
        out.append((-1 if doc_id is None else doc_id, len(data), int(gone.sum()), list(zip(edge[::2], edge[1::2], strict=True)), bytes(np.frombuffer(data, np.uint8)[~gone])))
    return sorted(out)


def found_repeats(frame, length: int) -> list[tuple]:
    rows = remove_repeats(frame, length).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows)


@pytest.mark.parametrize("texts", [["short", None, "also short"], [None, ""], ["one row " * 20], ["x" * 49, "x" * 50, "x" * 51], ["short", "long enough " * 9, "long enough " * 12]])
def test_repeats_of_short_texts(spark, texts):
    """Shards without a string of the length, single rows, fewer rows than shards."""
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found_repeats(frame, 50) == brute_repeats([(i, (t or "").encode()) for i, t in enumerate(texts)], 50)


def test_repeats_after_a_join(spark, docs):
    """An input without file statistics."""
    frame = docs.join(docs.select("doc_id", "label").withColumnRenamed("label", "l").distinct(), "doc_id").select("doc_id", "text")
    assert found_repeats(frame, 50) == brute_repeats([(r.doc_id, (r.text or "").encode()) for r in frame.collect()], 50)


def test_repeats_with_a_hot_passage_and_long_texts(spark, monkeypatch):
    """One passage in very many documents: its anchors are dealt by windows. Arrays, pieces and rows are small."""
    for name, value in (("HOT", 20), ("PIECE", 1 << 10), ("ARRAY_BYTES", 1 << 12), ("SHARD_BYTES", 1 << 15), ("RANGE_BYTES", 1 << 15)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    passage, long = some(30), some(40_000)
    texts = [f"{some(12)} {passage} {some(12)}" for _ in range(300)] + [long, some(5) + long[50_000:150_000] + some(5)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert found_repeats(frame, 50) == brute_repeats([(i, t.encode()) for i, t in enumerate(texts)], 50)


@pytest.mark.parametrize("length", [50, 20, 9])
def test_repeats_are_those_of_brute_force(docs, no_docs, length):
    rows = docs.collect()
    expected = brute_repeats([(r.doc_id, (r.text or "").encode()) for r in rows], length)
    assert found_repeats(docs, length) == expected
    langs = {r.doc_id: (r.lang, r.fp) for r in rows}
    out = remove_repeats(docs, length, keep=("lang", "fp"))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes) for r in out.collect()) == [e[:2] for e in expected]
    assert all((r.lang, r.fp) == langs[r.doc_id] for r in out.collect())
    assert remove_repeats(no_docs, length).count() == 0


def vectors_of():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=16) * 0.05 * (i % 7)
        rows.append([i, v.astype(np.float32).tolist(), int(i % 40 % 3)])
    rows += [[1000 + i, rows[7][1], rows[7][2]] for i in range(5)]
    rows += [[2000, [0.0] * 16, 0], [2001, None, 0], [2002, rows[7][1], None], [2003, [float("nan")] * 16, 0], [2004, [None] + [1.0] * 15, 0], [2005, [float("inf")] * 16, 0], [2006, [], 0], [2007, [1.0, 2.0], 0], [2008, [2.0, 4.0], 0], [None, rows[7][1], rows[7][2]]]
    return rows


def test_vectors_against_brute_force(spark):
    rows = vectors_of()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, tag string, n int")
    got = {r.vec_id: r for r in near_duplicate_vectors(frame).collect()}
    assert len(got) == len(rows)
    usable = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = {(a[0], b[0]) for a in usable for b in usable if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98}
    true = {i: sum(x == i for x, _ in links) for i in got if i is not None}
    assert all(got[i].n_links <= n for i, n in true.items())
    assert sum(r.n_links for i, r in got.items() if i is not None) >= 0.95 * len(links)
    assert got[2007].n_links == 1
    assert got[2008].component_id == 2007
    assert got[None].component_id is None
    for i, r in got.items():
        if i is not None:
            assert r.kept == (i == r.component_id)
            assert r.component_id <= i
    assert near_duplicate_vectors(frame.limit(0)).count() == 0
    # visiting all cells is exact
    exact = {r.vec_id: r for r in near_duplicate_vectors(frame, recall=2.0).collect()}
    assert {i: r.n_links for i, r in exact.items() if i is not None} == true | {i: 0 for i in exact if i is not None and i not in true}


def test_cells_are_visited_in_order():
    """Nearest first, and all that lie within the margin, as many as there are for each row."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 8))
    for margin in (0.0, 3.0, float("inf")):
        index = MultiIndex(rng.normal(size=(6, 4)), rng.normal(size=(5, 4)), margin)
        d1, d2 = index.distances(x)
        total = (d1[:, :, None] + d2[:, None, :]).reshape(50, -1)
        cells, number = index.nearest_cells(x)
        begin = np.cumsum(number) - number
        assert (cells[begin] == index.home(x)).all()
        for i, (a, n) in enumerate(zip(begin, number, strict=True)):
            own = cells[a : a + n]
            assert np.allclose(total[i, own], np.sort(total[i])[:n])
            assert n == (total[i] - total[i].min() <= margin + 1e-12).sum()
        far = total.argmax(1)
        assert np.allclose(index.excess(x, far), total.max(1) - total.min(1))


def test_recursion_with_the_default_base_case(monkeypatch):
    """A text of a few hundred kilobytes is named and sorted again at least twice."""
    levels = []
    plain = arrays._sorted_suffixes
    monkeypatch.setattr(arrays, "_sorted_suffixes", lambda *a: levels.append(len(a[0])) or plain(*a))
    rng = np.random.default_rng(2)
    words = [rng.integers(97, 110, int(rng.integers(2, 9))).astype(np.uint8).tobytes() for _ in range(400)]
    data = b" ".join(words[i] for i in rng.integers(0, 400, 50_000))
    sa = arrays.suffix_array(np.frombuffer(data, np.uint8))
    assert len(levels) >= 3 and levels[1] > arrays.SHORT
    assert np.array_equal(np.sort(sa), np.arange(len(data)))
    checked = rng.integers(0, len(data) - 1, 3000)
    assert all(data[sa[i] : sa[i] + 4000] < data[sa[i + 1] : sa[i + 1] + 4000] or data[sa[i] :] < data[sa[i + 1] :] for i in checked.tolist())


def test_united_runs():
    ends = np.array([10, 10, 25])
    a, b = np.array([12, 2, 4, 7, 10, 20]), np.array([15, 4, 6, 10, 12, 25])
    first, last, owner = suffix_dedup._united(a, b, ends)
    assert list(zip(first.tolist(), last.tolist(), owner.tolist())) == [(2, 6, 0), (7, 10, 0), (10, 15, 2), (20, 25, 2)]
    assert all(len(x) == 0 for x in suffix_dedup._united(a[:0], b[:0], ends))


def test_a_full_bucket_of_different_fingerprints_is_not_copied_with_its_size(spark):
    """20,000 fingerprints that share their first bits: rows dealt stay a few times their number, and no link is lost."""
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 44, 20_000, dtype=np.uint64)  # 20 bits are 0 in all
    fps[10_000:10_300] = fps[:300] ^ (np.uint64(1) << rng.integers(0, 44, 300, dtype=np.uint64)) ^ (np.uint64(1) << np.uint64(50))
    rows = [(f.tobytes(), i) for i, f in enumerate(np.unique(fps))]
    nodes = spark.createDataFrame(rows, "fp binary, first_id long").repartition(4)
    n, both = simhash.bit_statistics(nodes, 64)
    parts, thresholds = [list(range(44, 64)), list(range(44))], [1, 1]
    dealt = simhash._dealt(nodes, parts, thresholds, 64, 3)
    stored = sum(t >= 0 for t in thresholds) + sum(len(p) for p in parts)
    # every row and its 64 probes, four finer buckets for those in full ones, and no factor for blocks
    assert dealt.count() <= 4 * (stored + 1) * len(rows)
    found = {(min(r), max(r)) for r in dealt.mapInArrow(simhash._linked(3, 64), "a long, b long").distinct().collect()}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[root(a)] = root(b)
    where = {int(np.frombuffer(f, np.uint64)[0]): i for f, i in rows}
    pairs = [(where[int(fps[i])], where[int(fps[10_000 + i])]) for i in range(300)]
    assert all(root(a) == root(b) for a, b in pairs)
