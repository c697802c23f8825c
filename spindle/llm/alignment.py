"""Alignment of two tokenizers' tokens over a corpus, through a dictionary of groups.

The places where tokens of both end cut a text into groups. Most groups occur
again and again, so a task interns them: a document is a list of numbers of a
block's own dictionary. Over the corpus the dictionaries meet by the groups'
keys; each different group is expanded into links once, its links take their
pairs' counts, and the sums go back to the blocks, where documents add them up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import mixed, sliced, written
from spindle.llm.tokens import Memo, Merges, Pretokens, byte_chars, grouped, spec

#: A block's dictionary is closed at so many different groups, or so many groups in all.
DIFFERENT, TOTAL = 1_000_000, 6_000_000
#: Characters of the texts that are aligned in one go (a longer text goes alone).
CHARS = 3 << 20
ROWS = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups binary, number int, key long, mark long, a binary, b binary, pair long, n long"


class TwoTokenizers:
    """Ids by both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        bytes_of = {c: b for b, c in byte_chars().items()}
        vocab = spec(path_a)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(bytes_of[c] for c in token) if all(c in bytes_of for c in token) else token.encode("utf-8")
        self.pretokens, self.memo = Pretokens(path_a), Memo(Merges(path_a).many)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.pieces.get_piece_size()
        self.bytes_b = [
            bytes([int(p[3:-1], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(map(self.pieces.id_to_piece, range(size)))
        ]
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by both; none where a text is empty or the tokens' bytes are not those of space and text."""
        lists = [self.pretokens.of_part(" " + t) if t else [] for t in texts]
        known = self.memo.learned(lists).__getitem__
        ids_a = [np.frombuffer(b"".join(map(known, words)), "<u4") for words in lists]
        ids_b = self.pieces.encode(texts, num_threads=1)
        out_b, none = [], np.zeros(0, np.uint32)
        for k, t in enumerate(texts):
            whole = b" " + t.encode("utf-8") if t else b""
            own = ids_b[k]
            if not t or b"".join(map(self.bytes_b.__getitem__, own)) != whole or self.sizes_a[ids_a[k]].sum() != len(whole):
                # a's tokens are runs of the text's own bytes in their order, so none is lost where the length is right
                ids_a[k] = none
                own = ()
            out_b.append(np.array(own, np.uint32) if len(own) else none)
        return ids_a, out_b


@lru_cache(maxsize=2)
def two_tokenizers(path_a: str, path_b: str) -> TwoTokenizers:
    return TwoTokenizers(path_a, path_b)


class Groups:
    """The groups of some texts with as many bytes by a's tokens as by b's, one after the other."""

    def __init__(self, a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.a, self.b = a, b
        ends_a, ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
        total = int(ends_a[-1]) + 1 if len(a) else 1
        at_a, at_b = np.zeros(total, bool), np.zeros(total, bool)
        at_a[ends_a] = True
        at_b[ends_b] = True
        last_a, last_b = np.flatnonzero(at_b[ends_a]), np.flatnonzero(at_a[ends_b])
        #: First tokens and numbers of tokens of each group.
        self.n_a, self.n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        self.first_a, self.first_b = last_a - self.n_a + 1, last_b - self.n_b + 1
        self.ends = ends_a[last_a]
        self._at = at_a, at_b

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers for each group that follow from its ids."""
        if not len(self.ends):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        parts = []
        for ids, first, n, salt in ((self.a, self.first_a, self.n_a, 1), (self.b, self.first_b, self.n_b, 2)):
            place = np.arange(len(ids)) - np.repeat(first, n)
            parts.append(np.add.reduceat(mixed(ids.astype(np.uint64) | (place.astype(np.uint64) << np.uint64(32)) | np.uint64(salt << 62)), first))
        sizes = self.n_a.astype(np.uint64) << np.uint64(32) | self.n_b.astype(np.uint64)
        return mixed(parts[0] + mixed(parts[1] ^ sizes)), mixed(mixed(parts[0]) + parts[1] + np.uint64(7))

    def links(self, chosen: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of links of each chosen group, and their pairs (a times ``size_b`` plus b), group by group.

        Between two neighbouring ends lies a piece of one token of each side;
        in a group no two pieces have the same two tokens.
        """
        at_a, at_b = self._at
        ends = np.flatnonzero(at_a | at_b)
        group = np.searchsorted(self.ends, ends, "left")
        take = np.zeros(len(self.ends), bool)
        take[chosen] = True
        own = take[group]
        ends, group = ends[own], group[own]
        i, j = ((np.cumsum(x, dtype=np.int32)[ends - 1]) for x in (at_a, at_b))
        pairs = self.a[i].astype(np.int64) * size_b + self.b[j]
        return np.bincount(group, minlength=len(self.ends))[np.sort(chosen)], pairs


class Block:
    """The dictionary of a block of documents, and in how many of them each pair of ids is linked."""

    def __init__(self, number: int):
        self.number, self.total = number, 0
        self.keys, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.marks: list[np.ndarray] = []
        self.named: list[np.ndarray] = []
        self.strings: list[bytes] = []
        self.a: list[bytes] = []
        self.b: list[bytes] = []
        self.begin, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []

    def numbers(self, groups: Groups, size_b: int) -> np.ndarray:
        """The number of each group in this block's dictionary; new groups get the next ones."""
        key, mark = groups.keys()
        different, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, different), max(len(self.keys) - 1, 0))
        seen = self.keys[at] == different if len(self.keys) else np.zeros(len(different), bool)
        number = np.empty(len(different), np.int32)
        if len(self.keys):
            number[seen] = self.order[at[seen]]
        # new ones are numbered by where they stand
        new = np.flatnonzero(~seen)
        new = new[np.argsort(first[new])]
        where = first[new]
        number[new] = len(self.strings) + np.arange(len(new), dtype=np.int32)
        n, pairs = groups.links(where, size_b)
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(n))
        self.pairs = np.append(self.pairs, pairs)
        ids_a, ids_b = groups.a.astype("<u4"), groups.b.astype("<u4")
        for s, m, t, k in zip(groups.first_a[where].tolist(), groups.n_a[where].tolist(), groups.first_b[where].tolist(), groups.n_b[where].tolist(), strict=True):
            own_a, own_b = ids_a[s : s + m], ids_b[t : t + k]
            self.a.append(own_a.tobytes())
            self.b.append(own_b.tobytes())
            self.strings.append((",".join(map(str, own_a.tolist())) + "|" + ",".join(map(str, own_b.tolist()))).encode())
        self.named.append(key[where])
        self.marks.append(mark[where])
        keys, order = np.append(self.keys, different[new]), np.append(self.order, number[new])
        sort = np.argsort(keys)
        self.keys, self.order = keys[sort], order[sort]
        self.total += len(key)
        return number[inverse.ravel()]

    def count(self, doc: np.ndarray, number: np.ndarray) -> None:
        """Count each pair once for each document (0, 1, ... in ``doc``) that holds it in any of its groups."""
        both = np.unique(doc.astype(np.int64) << 32 | number)
        doc, number = both >> 32, both & 0xFFFFFFFF
        n = self.begin[number + 1] - self.begin[number]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[number], n)
        own = np.repeat(doc, n) << 44 | self.pairs[at]
        pairs, counts = np.unique(np.unique(own) & ((1 << 44) - 1), return_counts=True)
        self.counts.append((pairs, counts))
        if sum(len(p) for p, _ in self.counts) > 8_000_000:
            self.counts = [self.pair_counts()]

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.counts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, counts = (np.concatenate(x) for x in zip(*self.counts, strict=True))
        different, inverse = np.unique(pairs, return_inverse=True)
        return different, np.bincount(inverse.ravel(), counts, len(different)).astype(np.int64)


def _batch(size: int, kind: int, block: int, **columns) -> pa.RecordBatch:
    """Rows of one kind; columns that are not given are null."""
    schema = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in ROWS.split(", ")])
    columns |= {"kind": np.full(size, kind, np.int32), "block": np.full(size, block, np.int64)}
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _aligned(path_a: str, path_b: str):
    """mapInArrow function: rows of documents (kind 0), of a block's dictionary (1) and of its pairs (2)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, codec = two_tokenizers(path_a, path_b), pa.Codec("zstd", 1)
        size_b = len(two.bytes_b)
        base = TaskContext.get().partitionId() << 32
        block = Block(base)

        def closed() -> Iterator[pa.RecordBatch]:
            key, mark = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (block.named, block.marks))
            for at in range(0, len(block.strings), 50_000):
                part = slice(at, at + 50_000)
                own = block.a[part]
                yield _batch(len(own), 1, block.number, number=np.arange(at, at + len(own), dtype=np.int32), key=key[part].view(np.int64), mark=mark[part].view(np.int64), a=own, b=block.b[part])
            pairs, counts = block.pair_counts()
            for at in range(0, len(pairs), 100_000):
                part = slice(at, at + 100_000)
                yield _batch(len(pairs[part]), 2, block.number, pair=pairs[part], n=counts[part])

        for batch in sliced(batches):
            doc_ids, at = batch.column(0).to_pylist(), 0
            for texts in grouped([t or "" for t in batch.column(1).to_pylist()], chars=CHARS):
                ids_a, ids_b = two.encode(texts)
                groups = Groups(np.concatenate(ids_a), np.concatenate(ids_b), two.sizes_a, two.sizes_b)
                number = block.numbers(groups, size_b)
                n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
                # the groups up to the end of each document
                upto = np.searchsorted(groups.first_a, np.cumsum(n_a), "left")
                n_groups = np.diff(upto, prepend=0)
                block.count(np.repeat(np.arange(len(texts)), n_groups), number)
                hashes, lists = [], []
                name = block.strings.__getitem__
                for end, n in zip(upto.tolist(), n_groups.tolist(), strict=True):
                    own = number[end - n : end]
                    hashes.append(sha256(b";".join(map(name, own.tolist()))).hexdigest() if n else "")
                    data = own.astype("<u4").tobytes()
                    lists.append(len(data).to_bytes(8, "little") + codec.compress(data, asbytes=True) if n else b"")
                yield _batch(
                    len(texts), 0, block.number, doc_id=doc_ids[at : at + len(texts)], n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=np.where(n_groups > 0, n_a + n_b - n_groups, 0),
                    groups_sha256=hashes, groups=lists,
                )
                at += len(texts)
                if len(block.strings) >= DIFFERENT or block.total >= TOTAL:
                    yield from closed()
                    block = Block(block.number + 1)
        yield from closed()

    return of


def _links_of(path_a: str, path_b: str):
    """mapInArrow function: the links of each different group, as pairs with their number in it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = two_tokenizers(path_a, path_b)
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4") for c in (2, 3))
                groups = Groups(a, b, two.sizes_a, two.sizes_b)
                n, pairs = groups.links(np.arange(len(groups.ends)), len(two.bytes_b))
                # equal ends inside a group do not occur, so the groups are the rows
                row = np.repeat(np.arange(batch.num_rows), n)
                keys, marks = (batch.column(c).to_numpy()[row] for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(marks), pa.array(pairs)], ["key", "mark", "pair"])

    return of


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """``pair, n, best``: in how many documents a pair is linked, and whether none of its a's pairs is in more."""
    counts = written(rows.where("kind = 2").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    counts = counts.withColumn("id_a", F.expr(f"pair div {size_b}"))
    most = counts.groupBy("id_a").agg(F.max("n").alias("most"))
    return counts.join(most, "id_a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def aligned_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``.

    ``path_a`` is a byte-level tokenizer of the tokenizers library, which gets
    a space and the text with special strings as plain text; ``path_b`` is a
    sentencepiece model, which puts the space there itself. A null or empty
    text, and one whose tokens' bytes are not those of space and text, has no
    tokens: zeros and ''. A null doc_id stays null, repeated rows count each as
    a document of its own. A text is encoded in one piece. Groups are told
    apart by 128 bits over the corpus and 64 bits within a block. An empty
    table gives an empty table.
    """
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_aligned(path_a, path_b), ROWS), "aligned")
    pairs = written(pair_counts(rows, size_b), "pair-counts")
    own = rows.where("kind = 1").select("block", "number", "key", "mark", "a", "b")
    groups = own.groupBy("key", "mark").agg(F.first("a").alias("a"), F.first("b").alias("b"))
    links = groups.mapInArrow(_links_of(path_a, path_b), "key long, mark long, pair long")
    values = links.join(pairs, "pair").groupBy("key", "mark").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    back = own.select("block", "number", "key", "mark").join(written(values, "group-values"), ["key", "mark"])
    back = back.select(*(F.col(c).alias(c) for c in ("block", "number", "n_best", "count_sum")))

    def of(doc: pd.DataFrame, value: pd.DataFrame) -> pd.DataFrame:
        codec = pa.Codec("zstd")
        size = int(value["number"].max()) + 1 if len(value) else 0
        best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        best[value["number"]], total[value["number"]] = value["n_best"], value["count_sum"]
        sums = []
        for data in doc["groups"]:
            ids = np.frombuffer(codec.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), "<u4") if data else np.zeros(0, np.uint32)
            sums.append((int(best[ids].sum()), int(total[ids].sum())))
        doc = doc.drop(columns=["groups", "block"])
        return doc.assign(n_best=[s[0] for s in sums], count_sum=[s[1] for s in sums])[COLUMNS]

    each = rows.where("kind = 0").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")
    kind = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return each.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(of, kind)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
