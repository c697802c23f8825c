"""Token counts with a whole-token shortcut.

Ahead of the scan it is proved which strings of the vocabulary are one
pre-token that encodes to one token. A pre-token among them counts one; the
rest are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import sliced
from spindle.llm.tokens import Memo, Merges, Pretokens, byte_chars, grouped, load, spec


def whole_tokens(path: str) -> list[str]:
    """The vocabulary's strings that are one pre-token and that the library encodes as one token."""
    bytes_of = {c: b for b, c in byte_chars().items()}
    pretokens, vocab = Pretokens(path), spec(path)["model"]["vocab"]
    strings = {}
    for token, i in vocab.items():
        try:
            s = bytes(bytes_of[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if s and s not in pretokens.specials and pretokens.words(s) == [s]:
            strings[s] = i
    found = load(path).encode_batch(list(strings), add_special_tokens=False)
    return [s for (s, i), e in zip(strings.items(), found, strict=True) if e.ids == [i]]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    Counts are those of the tokenizers library on the whole text with special
    strings taken as special tokens. A null text is empty: 0 bytes, 0 tokens.
    A null doc_id stays null; repeated rows are counted each. ``path`` must be
    readable on the executors; the shortcut list is at most the vocabulary and
    is broadcast.
    """
    shortcut = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens, merges = Pretokens(path), Merges(path)
        memo = Memo(lambda words: [len(i) // 4 for i in merges.many(words)], dict.fromkeys([*shortcut.value, *pretokens.specials], 1))
        for batch in sliced(batches):
            texts, counts = [t or "" for t in batch.column(1).to_pylist()], []
            for group in grouped(texts):
                lists = [pretokens.words(t) for t in group]
                known = memo.learned(lists).__getitem__
                counts += [sum(map(known, words)) for words in lists]
            sizes = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
