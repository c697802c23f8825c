"""Tokenizer operators against the tokenizers library itself."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindle.llm import packing, token_files
from spindle.llm.token_count import token_counts, whole_tokens
from spindle.llm.tokens import Memo, Merges, Pretokens, RankTable, text_encoder
from spindle.llm.transducer import Codec, Lexicon, compile_words, encode_documents, frequent_words

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
MERGES = Merges(BYTE)
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
TEXTS = st.text(st.one_of(st.sampled_from("ab 's'tlé\n\t\r\x0b<|>12²ßſIİŉ.!"), st.characters(exclude_categories=["Cs"])), max_size=60)


def ids(path: str, text: str) -> list[int]:
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_memoised_encoding_is_the_library_s(text):
    for path in (BYTE, WORD):
        assert np.frombuffer(next(text_encoder(path)([text])), "<u4").tolist() == ids(path, text)


@pytest.fixture(scope="module")
def codec(tmp_path_factory):
    merges = Merges(WORD)
    words = ["the", "there", "then", "and", "hand", "é", "!!", "7", "ing", "king"]
    path = tmp_path_factory.mktemp("lexicon") / "lexicon.bin"
    path.write_bytes(compile_words([w.encode() for w in words], [merges.ids(w) for w in words]))
    lexicon = Lexicon(str(path))
    places = lexicon.places([w.encode() for w in [*words, "th", "thereof", "", "xyz", "kin"]])
    assert sorted(places[: len(words)].tolist()) == list(range(len(words)))
    assert (places[len(words) :] == -1).all()
    assert [lexicon.ids_of(p) for p in places[: len(words)]] == [merges.ids(w) for w in words]
    return Codec(WORD, lexicon)


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_codec_is_the_library_s(codec, text):
    found, expected = next(codec.encode([text])), ids(WORD, text)
    assert np.frombuffer(found, "<u4").tolist() == expected
    assert codec.decode(found) == LIBRARY[WORD].decode(expected, skip_special_tokens=False)


def test_automaton_is_minimal(tmp_path):
    words = sorted({a + b + c for a in ("s", "t", "") for b in ("ab", "ac", "b") for c in ("ing", "ed")})
    path = tmp_path / "l.bin"
    path.write_bytes(compile_words([w.encode() for w in words], [[i] for i in range(len(words))]))
    lexicon = Lexicon(str(path))
    # right languages of all prefixes, told apart: the number of states of the minimal automaton
    right = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in [w[:i] for i in range(len(w) + 1)]}
    assert len(lexicon.ends) == len(right)
    empty = tmp_path / "e.bin"
    empty.write_bytes(compile_words([], []))
    assert Lexicon(str(empty)).places([b"a"]).tolist() == [-1]


def test_merges_of_long_words_by_heap():
    merges, rng = Merges(BYTE), random.Random(2)
    for _ in range(30):
        word = "".join(rng.choice("theanrs") for _ in range(rng.randint(40, 300)))
        assert merges.ids(word) == ids(BYTE, word)


def test_whole_tokens_are_one_token_each():
    known = whole_tokens(BYTE)
    assert any(not s.isascii() and ord(max(s)) > 0x17F for s in known)
    assert all(len(ids(BYTE, s)) == 1 and Pretokens(BYTE).words(s) == [s] for s in random.Random(1).sample(known, 500))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_are_the_library_s(text):
    """The shortcut's pre-tokens, whole texts with any characters."""
    assert sum(len(Merges.ids(MERGES, w)) if w not in Pretokens(BYTE).specials else 1 for w in Pretokens(BYTE).words(text)) == len(ids(BYTE, text))


def test_memo_forgets_but_does_not_err():
    memo = Memo(lambda words: [w * 2 for w in words], {"kept": "k"}, limit=5)
    for k in range(50):
        words = [f"w{k}", f"w{k + 1}", "kept", f"w{k}"]
        assert memo.of(words) == [f"w{k}" * 2, f"w{k + 1}" * 2, "k", f"w{k}" * 2]
        assert len(memo.known) + len(memo.old) <= 16


def test_counts(docs, no_docs):
    got = sorted(tuple(r) for r in token_counts(docs, BYTE, 50).select("doc_id", "n_bytes", "n_tokens", "over_limit").na.fill(-1).collect())
    expected = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), n := len(ids(BYTE, r.text or "")), n > 50) for r in docs.collect())
    assert got == expected
    assert token_counts(no_docs, BYTE).count() == 0


def test_codec_over_documents(docs, no_docs):
    got = sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in encode_documents(docs, WORD, most=200).collect())
    expected = sorted((r.doc_id or -1, i := ids(WORD, r.text or ""), LIBRARY[WORD].decode(i, skip_special_tokens=False)) for r in docs.collect())
    assert got == expected
    assert encode_documents(no_docs, WORD).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 5000), st.integers(0, 2**32 - 1), st.integers(0, 33), st.floats(0.5, 1.0))
def test_block_files_round_trip(n, seed, bits, percentile):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 1 << min(bits, 32), n).astype(np.uint32)
    values[rng.random(n) < 0.02] = 2**32 - 1
    data = token_files.encode_file(np.array([5]), np.array([n]), values, percentile)
    doc_ids, lengths, back = token_files.decode_file(data)
    assert doc_ids.tolist() == [5]
    assert lengths.tolist() == [n]
    assert np.array_equal(back, values)
    assert np.array_equal(token_files.decode_file(data, 1, 3)[2], values[1024:3072])


def test_token_files(spark, docs, no_docs, tmp_path):
    path = (tmp_path / "ids").as_uri()
    files = token_files.write_token_files(docs, path, BYTE, ids_per_file=5000)
    assert files.count() > 3
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read_token_files(files, path).collect())
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for (at, doc_id, own), row in zip(got, rows, strict=True):
        assert (at, doc_id, own) == (start, -1 if row.doc_id is None else row.doc_id, [*ids(BYTE, row.text or ""), 0])
        start += len(own)
    digests = {r.start: r.ids_crc32 for r in token_files.token_file_digests(files, path).collect()}
    assert digests == {at: zlib.crc32(np.array(own, "<u4").tobytes()) for at, _, own in got}
    assert token_files.encoded_digests(no_docs, BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_places_every_piece(lengths):
    counts = np.bincount(np.array(lengths, np.int64), minlength=65) if lengths else np.zeros(65, np.int64)
    plan = packing.best_two_fit(counts, 64)
    used = np.zeros(65, np.int64)
    for bin_, times in plan:
        assert sum(bin_) <= 64
        for n in bin_:
            used[n] += times
    assert np.array_equal(used, counts)
    bins, least = sum(t for _, t in plan), -(-sum(lengths) // 64)
    assert least <= bins <= max(1, 11 * least // 9 + 1) or not lengths


def test_two_replace_the_smallest():
    counts = np.zeros(11, np.int64)
    # 6 and 3 leave a gap of one; 2 and 2 in place of 3 fill the bin
    counts[[6, 3]] = 1
    counts[2] = 2
    assert sorted(packing.best_two_fit(counts, 10)[0][0]) == [2, 2, 6]


def test_packed_documents(docs, no_docs):
    rows = packing.packed_documents(docs, WORD, capacity=128).collect()
    expected = sorted((r.doc_id or -1, np.array([*ids(WORD, r.text or ""), 0], "<u4")) for r in docs.collect() if r.doc_id is None or r.doc_id != 16)
    got = sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id != 16)
    pieces = [(i, k, k * 128, len(p), zlib.crc32(p.tobytes())) for i, x in expected for k, p in enumerate(x[a : a + 128] for a in range(0, len(x), 128))]
    assert got == sorted(pieces)
    bins: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.05 * total / 128 + 1
    assert packing.packed_documents(no_docs, WORD).count() == 0


def test_pieces_beyond_the_capacity_are_refused(spark):
    rows = spark.createDataFrame([(1, 0, 9), (2, 0, 0)], "doc_id long, piece int, length long")
    with pytest.raises(ValueError):
        packing.pack(rows, 8)


def test_rank_table():
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 1 << 40, 3000))
    rng.shuffle(pairs)
    table = RankTable(pairs)
    asked = np.concatenate([pairs, pairs + 1])
    known = {int(p): i for i, p in enumerate(pairs)}
    assert table.of((asked >> 32).astype(np.int32), (asked & 0xFFFFFFFF).astype(np.int64)).tolist() == [known.get(int(p), len(pairs)) for p in asked]


def test_many_words_are_merged_as_the_library_does():
    rng = random.Random(6)
    words = ["".join(rng.choice("theanrsioé ") for _ in range(rng.randint(1, 70))).strip().replace(" ", "x") or "x" for _ in range(3000)]
    for path in (BYTE, WORD):
        assert [np.frombuffer(x, "<u4").tolist() for x in Merges(path).many(words)] == [ids(path, w) for w in words]


def test_equal_counts_fill_the_lexicon(spark):
    """Where a level of counts does not fit, its first words take what room is left."""
    words = [f"w{i:04d}x" for i in range(300)]
    rows = [" ".join("".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words)] + ["common common common"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    for most in (1, 50, 10_000):
        found = frequent_words(docs, WORD, most)
        assert len(found) == min(most, 301) and ("common", 3) in found
    some = [w for w, n in frequent_words(docs, WORD, 50) if n == 1]
    every = [w for w, n in frequent_words(docs, WORD, 10_000) if n == 1]
    assert some == sorted(every)[:49]
    assert frequent_words(docs.limit(0), WORD, 50) == []
