from __future__ import annotations

from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spindle.llm import alignment
from spindle.llm.alignment import aligned_documents
from spindle.llm.tokens import byte_chars

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_force(rows):
    """Links from all pairs of byte ranges, by the libraries alone."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: b for b, c in byte_chars().items()}
    out, df = [], Counter()
    for doc_id, text in rows:
        whole = b" " + (text or "").encode()
        ids_a = first.encode(whole.decode(), add_special_tokens=False).ids if text else []
        ids_b = second.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in first.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:-1], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [second.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((doc_id, [], [], [], ""))
            continue

        def ranges(parts):
            at, found = 0, []
            for p in parts:
                found.append((at, at + len(p)))
                at += len(p)
            return found

        own_a, own_b = ranges(bytes_a), ranges(bytes_b)
        links = []
        for i, (s, e) in enumerate(own_a):
            links += [(ids_a[i], ids_b[j]) for j, (t, f) in enumerate(own_b) if t < e and s < f]
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in own_a} & {e for _, e in own_b}):
            m, n = i, j
            while i < len(own_a) and own_a[i][1] <= end:
                i += 1
            while j < len(own_b) and own_b[j][1] <= end:
                j += 1
            groups.append(",".join(map(str, ids_a[m:i])) + "|" + ",".join(map(str, ids_b[n:j])))
        df.update(set(links))
        out.append((doc_id, ids_a, ids_b, links, ";".join(groups)))
    best: dict = {}
    for (a, _), n in df.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(
        (d if d is not None else -1, len(a), len(b), len(g.split(";")) if g else 0, len(k), sum(df[p] == best[p[0]] for p in k), sum(df[p] for p in k), sha256(g.encode()).hexdigest() if g else "")
        for d, a, b, k, g in out
    )


def result(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def short(docs):
    return docs.where("text is null or length(text) < 3000")


def test_against_all_pairs_of_ranges(spark, short):
    assert result(aligned_documents(short, A, B)) == brute_force([(r.doc_id, r.text) for r in short.collect()])


def test_odd_texts_and_repeated_rows(spark):
    texts = ["▁x▁y", " a  b ", "ﬁ ① Ａ 中文字", "a\tb\nc\r\n", "<|endoftext|> <s> <0x41>", "\0a", "🙂👍🏽" * 7, "don't", "don't", "", None, " ", "x" * 900]
    rows = [(i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(aligned_documents(df, A, B)) == brute_force(rows)


def test_small_blocks_and_empty_table(spark, short, monkeypatch):
    whole = result(aligned_documents(short, A, B))
    monkeypatch.setattr(alignment, "DIFFERENT", 50)
    monkeypatch.setattr(alignment, "CHARS", 200)
    assert result(aligned_documents(short, A, B)) == whole
    assert aligned_documents(short.limit(0), A, B).collect() == []
