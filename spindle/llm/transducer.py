"""BPE encoding and decoding over a minimal acyclic transducer.

Frequent words are compiled into an automaton whose states share prefixes and
suffixes; an edge adds a number, and the sum along a word is its place in a
table of ids. The compiled file is memory-mapped by the tasks. Words that it
does not hold are merged by rank.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import shared_dir, sliced, written
from spindle.llm.tokens import Memo, Merges, Pretokens, grouped, load, spec

MAGIC = 0x4C4F4144


def compile_words(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The transducer of distinct ``words``, each with its ids, as the bytes of a file.

    Words are added in sorted order; when a branch is done, its states are
    replaced by equal ones already seen, from the end on, which gives the
    minimal automaton.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    final, edges = [False], [{}]  # by state; edges: byte -> state
    seen: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (state, byte, next state) not yet minimal

    def settle(depth: int) -> None:
        while len(path) > depth:
            state, byte, after = path.pop()
            edges[state][byte] = seen.setdefault((final[after], *edges[after].items()), after)

    before = b""
    for k in order:
        word = words[k]
        shared = os.path.commonprefix([before, word])
        settle(len(shared))
        state = path[-1][2] if path else 0
        for byte in word[len(shared) :]:
            final.append(False)
            edges.append({})
            path.append((state, byte, len(edges) - 1))
            state = len(edges) - 1
        final[state] = True
        before = word
    settle(0)
    # number the states that are left, and count the words below each
    number, stack, below = {0: 0}, [0], {}
    while stack:
        for t in edges[stack.pop()].values():
            if t not in number:
                number[t] = len(number)
                stack.append(t)
    for root in number:
        todo = [root]
        while todo:
            s = todo[-1]
            if s in below:
                todo.pop()
            elif open_ := [t for t in edges[s].values() if t not in below]:
                todo += open_
            else:
                below[s] = final[s] + sum(below[t] for t in edges[s].values())
                todo.pop()
    keys, targets, adds = [], [], []
    for s, n in sorted(number.items(), key=lambda x: x[1]):
        add = int(final[s])
        for byte, t in sorted(edges[s].items()):
            keys.append(n << 8 | byte)
            targets.append(number[t])
            adds.append(add)
            add += below[t]
    ends = np.zeros(len(number), np.uint8)
    for s, n in number.items():
        ends[n] = final[s]
    flat = [i for k in order for i in ids[k]]
    starts = np.cumsum([0, *(len(ids[k]) for k in order)])
    parts = [np.array(x, np.int64) for x in (keys, targets, adds, ends, starts, flat)]
    return np.array([MAGIC, *map(len, parts)], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled file, memory-mapped."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int64, "r")
        if data[0] != MAGIC:
            raise ValueError("not a compiled lexicon")
        cuts = np.cumsum([7, *data[1:7]])
        self.keys, self.targets, self.adds, self.ends, self.starts, self.ids = (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the id table, -1 for words that are not held; all words move in step."""
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(sizes) - sizes
        state, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive, step = np.flatnonzero(sizes > 0), 0
        if not len(self.keys):
            return np.full(len(words), -1)
        while len(alive):
            key = state[alive] << 8 | text[begin[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            place[alive[~ok]], state[alive[~ok]] = -1, -1
            alive, at = alive[ok], at[ok]
            state[alive] = self.targets[at]
            place[alive] += self.adds[at]
            step += 1
            alive = alive[sizes[alive] > step]
        out = np.full(len(words), -1)
        live = np.flatnonzero((state >= 0) & (place >= 0))
        out[live] = np.where(self.ends[state[live]] > 0, place[live], -1)
        return out

    def bytes_of(self, place: int) -> bytes:
        return self.ids[self.starts[place] : self.starts[place + 1]].astype("<u4").tobytes()

    def ids_of(self, place: int) -> list[int]:
        return self.ids[self.starts[place] : self.starts[place + 1]].tolist()


def frequent_words(docs: DataFrame, path: str, most: int) -> list[tuple[str, int]]:
    """The at most ``most`` most frequent pre-tokens, counted over all documents.

    Tasks count what they read before anything is shuffled. A histogram of the
    counts says which levels fit whole; of the next one the most frequent words
    (equal counts: in the order of words) fill what is left.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens, seen = Pretokens(path), Counter()

        def rows() -> pa.RecordBatch:
            words, counts = list(seen), list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

        for batch in sliced(batches):
            for text in batch.column(0):
                seen.update(pretokens.words(text.as_py() or ""))
            if len(seen) > 400_000:
                yield rows()
        for special in pretokens.specials:
            seen.pop(special, None)
        yield rows()

    counted = docs.select("text").mapInArrow(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counted.where(F.length("word") <= 64), "words")
    level = F.floor(F.log2("n") * 16)
    levels = sorted(((r.level, r.k) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least, part = 0, float("inf"), None
    for value, k in levels:
        if total + k > most:
            part = value
            break
        total, least = total + k, value
    found = counts.where(level >= least).collect()
    if part is not None and total < most:
        # the level that does not fit gives as many words as there is room for
        found += counts.where(level == part).orderBy(F.desc("n"), "word").limit(most - total).collect()
    return sorted((r.word, r.n) for r in found)


def build_lexicon(docs: DataFrame, tokenizer: str, most: int = 65_536) -> str:
    """Compile the frequent words of ``docs`` and give the file to all executors; return its name.

    ``most`` bounds the file, not what is encoded: other words are merged.
    """
    merges = Merges(tokenizer)
    words = [w for w, _ in frequent_words(docs, tokenizer, most)]
    data = compile_words([w.encode("utf-8") for w in words], [merges.ids(w) for w in words])
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    # equal lexicons have one path in the shared folder: a file may be added again only from where it was
    path = f"{shared_dir(docs.sparkSession)}/{name}"
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place.rpartition("/")[0])
    with store.open_output_stream(place) as f:
        f.write(data)
    docs.sparkSession.sparkContext.addFile(path)
    return name


class Codec:
    """Encodes texts to ids and back with a lexicon and exact merges."""

    def __init__(self, path: str, lexicon: Lexicon):
        self.pretokens, self.merges, self.lexicon = Pretokens(path), Merges(path), lexicon
        ids = spec(path)["model"]["vocab"] | self.pretokens.specials
        self.strings = [""] * (max(ids.values()) + 1)
        for s, i in ids.items():
            self.strings[i] = s
        self.memo = Memo(self.resolve, {w: i.to_bytes(4, "little") for w, i in self.pretokens.specials.items()})
        if load(path).decoder is not None:
            raise ValueError("a tokenizer without a decoder is expected")

    def resolve(self, words: list[str]) -> list[bytes]:
        """Ids (32-bit, little-endian) of each word, from the lexicon or by merging."""
        places = self.lexicon.places([w.encode("utf-8") for w in words]).tolist()
        unseen = [w for w, p in zip(words, places, strict=True) if p < 0]
        merged = dict(zip(unseen, self.merges.many(unseen), strict=True))
        return [merged[w] if p < 0 else self.lexicon.bytes_of(p) for w, p in zip(words, places, strict=True)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        for group in grouped(texts):
            lists = [self.pretokens.words(t) for t in group]
            known = self.memo.learned(lists).__getitem__
            for words in lists:
                yield b"".join(map(known, words))

    def decode(self, ids: bytes) -> str:
        """As the library's decode without a decoder: the tokens' strings with spaces between."""
        return " ".join(map(self.strings.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def codec(path: str, name: str) -> Codec:
    return Codec(path, Lexicon(SparkFiles.get(name)))


def encode_documents(docs: DataFrame, path: str, most: int = 65_536) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row of ``docs``.

    ``ids`` holds little-endian 32-bit ids as the tokenizers library gives them
    for the whole text, ``decoded`` what its decode makes of them with special
    tokens kept. A null text is empty: no ids, an empty string. A null doc_id
    stays null. An empty table gives an empty table.
    """
    name = build_lexicon(docs, path, most)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, name)
        for part in sliced(batches, rows=500):
            made = list(own.encode([t or "" for t in part.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array([len(i) // 4 for i in made], pa.int64()), pa.array(made, pa.binary()), pa.array(map(own.decode, made), pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, n_tokens long, ids binary, decoded string")
