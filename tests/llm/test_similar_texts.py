"""The pipeline's near-duplicate stage against brute-force Jaccard similarities."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from spindle.llm import simhash


def sets_of(text: str) -> set[tuple[str, ...]]:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(x: str, y: str) -> float:
    a, b = sets_of(x), sets_of(y)
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def pairs():
    """Pairs of texts of 400 shingles at 0.78, 0.80 and 0.82: the second has another end."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    out = []
    for target in (0.78, 0.80, 0.82):
        shared = -(-int(2 * 400 * target * 1000) // int(1000 * (1 + target))) + (target == 0.80)
        for _ in range(60):
            base = [word() for _ in range(404)]
            other = [*base[: shared + 4], *(word() for _ in range(400 - shared))]
            out.append((target, " ".join(base), " ".join(other)))
    return out


def test_pairs_are_judged_by_their_jaccard_similarity(spark, pairs):
    rows = [(2 * i + k, t) for i, (_, *two) in enumerate(pairs) for k, t in enumerate(two)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    met = {0.78: [], 0.80: [], 0.82: []}
    for i, (target, x, y) in enumerate(pairs):
        assert 2 * i in kept
        if jaccard(x, y) < 0.8:
            assert 2 * i + 1 in kept  # precision is exact
        else:
            met[target].append(2 * i + 1 not in kept)
    assert not met[0.78] and len(met[0.80]) == len(met[0.82]) == 60
    assert sum(met[0.80]) >= 57 and sum(met[0.82]) >= 57


@pytest.mark.parametrize("far", [None, 200])
def test_components_are_those_of_brute_force(spark, monkeypatch, far):
    """Groups of very near copies, chains at the limit, short and empty texts; with ``far`` most candidates fail."""
    rng = random.Random(9)
    texts = ["", " ", "a b", "A  b", "a c"]
    for g in range(6):
        base = [f"w{g}x{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(8):
            own = list(base)
            for _ in range(g):
                own[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    if far:
        real = simhash._candidates
        monkeypatch.setattr(simhash, "_candidates", lambda _, bits: real(far, bits))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(docs, recall=0.9999).collect()}
    parent = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(texts):
            for j in range(i):
                if (not x.split() and not texts[j].split()) or (x.split() and texts[j].split() and jaccard(x, texts[j]) >= 0.8):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    assert got == dict(enumerate(parent))


def test_rows_with_one_doc_id_are_judged_by_their_texts(spark):
    texts = ["one " * 3 + " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))]
    rows = [(1, texts[0], "en", "s", 1), (2, texts[0], "en", "s", 1), (2, texts[1], "en", "s", 1), (2, texts[1], "en", "s", 1), (None, texts[1], "en", "s", 1)]
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
        got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
        assert got == [(0, texts[1]), (1, texts[0]), (2, texts[1])]
