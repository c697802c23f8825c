from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindle.llm import kneser_ney
from spindle.llm.kneser_ney import discounts, language_scores, word_hashes


def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def brute_force(rows):
    """The model with dictionaries, from its definition; also checks that the probabilities of a context add up to one."""
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    seqs = [["<s>", "<s>", *words_of(t), "</s>"] for d, t in rows if not out(d)]
    tri = Counter((s[i - 2], s[i - 1], s[i]) for s in seqs for i in range(2, len(s)))
    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)
    seen = Counter(w for s in seqs for w in s[2:])
    total, vocab = sum(seen.values()), len(seen)

    def of(counts):
        n = Counter(counts.values())
        return [0.0, *discounts(np.array([n[1], n[2], n[3], n[4]]))]

    d3, d2, d1 = of(tri), of(bi), of(uni)

    def contexts(counts, d):
        sums, rest = defaultdict(int), defaultdict(float)
        for g, c in counts.items():
            sums[g[:-1]] += c
            rest[g[:-1]] += d[min(c, 3)]
        return sums, rest

    s3, r3 = contexts(tri, d3)
    s2, r2 = contexts(bi, d2)
    floor = sum(d1[min(c, 3)] for c in uni.values()) / max(len(bi), 1) / (vocab + 1)

    def p(u, v, w):
        if not vocab:
            return 1.0
        x = (uni[w] - d1[min(uni[w], 3)]) / len(bi) + floor
        if s2[(v,)]:
            x = (bi[v, w] - d2[min(bi[v, w], 3)] + r2[(v,)] * x) / s2[(v,)]
        if s3[u, v]:
            x = (tri[u, v, w] - d3[min(tri[u, v, w], 3)] + r3[u, v] * x) / s3[u, v]
        return x

    for u, v in list(s3)[:3]:
        assert math.isclose(sum(p(u, v, w) for w in [*seen, "<unk>"]), 1.0, rel_tol=1e-9)
    found = []
    for d, t in rows:
        s = ["<s>", "<s>", *words_of(t), "</s>"]
        base = sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (vocab + 1))) for w in s[2:])
        score = sum(math.log10(p(s[i - 2], s[i - 1], s[i])) for i in range(2, len(s)))
        found.append((d if d is not None else -1, out(d), len(s) - 2, sum(seen[w] > 0 for w in s[2:]), total, base, score))
    return sorted(found)


def result(df):
    rows = [(r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()]
    return sorted(rows)


def same(a, b):
    assert [r[:5] for r in a] == [r[:5] for r in b]
    for x, y in zip(a, b, strict=True):
        assert x[5:] == pytest.approx(y[5:], rel=1e-9, abs=1e-9)


def test_word_hashes_follow_the_words():
    texts = ["Ab ab\tAB\x0b\x0cb", None, "", " \n ", "é É x\x1cy x\x85y", "a b", "b", "x" * 3000 + " " + "X" * 3000]
    hashes, n = word_hashes(pa.array(texts).slice(0))
    assert n.tolist() == [len(words_of(t)) for t in texts]
    words = [w for t in texts for w in words_of(t)]
    assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(words, hashes.tolist(), strict=True)))
    part, m = word_hashes(pa.array(texts).slice(4, 2))
    assert part.tolist() == hashes[n[:4].sum() : n[:6].sum()].tolist() and m.tolist() == n[4:6].tolist()


def test_windows_do_not_change_hashes(monkeypatch):
    text = pa.array(["one two " + "z" * 500 + " three four " * 40])
    whole = word_hashes(text)[0]
    monkeypatch.setattr(kneser_ney, "WINDOW", 32)
    assert word_hashes(text)[0].tolist() == whole.tolist()


def test_scores_against_dictionaries(docs):
    same(result(language_scores(docs, held())), brute_force([(r.doc_id, r.text) for r in docs.collect()]))


def test_small_parts_and_copied_files(docs, monkeypatch):
    whole = result(language_scores(docs, held()))
    for name, value in (("PART_EVENTS", 500), ("PART_WORDS", 300)):
        monkeypatch.setattr(kneser_ney, name, value)
    monkeypatch.setattr(kneser_ney, "mounted", lambda folder: False)
    same(result(language_scores(docs, held())), whole)


def test_nothing_to_learn_from(docs, no_docs):
    assert language_scores(no_docs, held()).collect() == []
    rows = result(language_scores(docs.where("doc_id is not null"), F.lit(True)))
    assert {r[3:] for r in rows} == {(0, 0, 0.0, 0.0)}


def test_shared_folder_without_a_scheme(spark, docs, tmp_path, monkeypatch):
    from spindle.functions.lineage import shared_dir

    conf = type(spark.conf)
    monkeypatch.setattr(conf, "get", lambda self, key, *a, get=conf.get: str(tmp_path) if key == "spark.checkpoint.dir" else get(self, key, *a))
    # a cluster takes no local folder as a file that workers get
    monkeypatch.setattr(spark.sparkContext, "addFile", lambda *a, **b: pytest.fail("files are shared already"))
    assert shared_dir(spark) == f"file:{tmp_path}"
    same(result(language_scores(docs, held())), brute_force([(r.doc_id, r.text) for r in docs.collect()]))
