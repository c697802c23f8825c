"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

Features: densities of two lexicons (words and word beginnings that mark toxic
training rows, and a short general list), nearness of their hits to words of
address, capitals, punctuation, and obfuscated or stretched words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import sliced
from spindle.llm.gbdt import Classifier, fit_classifier
from spindle.llm.labelled import held_out, training_rows
from spindle.llm.tokens import Memo

#: General words of insult in the languages of the corpus.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown dumb fool ugly hate vermin "
    "filth garbage imbecile cretin freak jerk creep bastard dumm dummkopf trottel abschaum widerlich arschloch idiotisch "
    "débile crétin imbécile ordure minable connard stupide abruti estúpido idiota imbécil basura asqueroso inútil patético".split()
)
#: Words of address.
ADDRESS = frozenset("you your yours yourself u ur you're du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre tú ti usted ustedes vosotros tuyo su".split())
LEET = str.maketrans("013457@$!|", "oieastasii")
LETTERS = re.compile(r"[^\W\d_]+")
STRETCHED = re.compile(r"(\w)\1\1")
PREFIXES = (4, 5, 6)
WORD, START, GENERAL, ADDRESSED, CAPS, MASKED, LEETED, LONG = (1 << k for k in range(8))
HIT = WORD | START | GENERAL | LEETED


@dataclass
class Lexicon:
    """Words and beginnings with their weights (log-odds, from 0 to 8)."""

    words: dict[str, float]
    starts: dict[str, float]


def terms_of(text: str) -> set[str]:
    """Distinct words (``=word``) and beginnings of 4 to 6 letters (``^begi``) of a text."""
    out = set()
    for w in set(LETTERS.findall(text.lower())):
        out.add("=" + w)
        out.update("^" + w[:k] for k in PREFIXES if len(w) > k)
    return out


def learn_lexicon(rows: DataFrame, most: int = 2000, least: int = 5) -> Lexicon:
    """The terms that mark the rows with y = 1: at least ``least`` such rows, lowest log-odds above 1."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in sliced(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t in terms_of(text or ""):
                    seen.setdefault(t, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())],
            ["term", "clean", "toxic"],
        )

    totals = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return Lexicon({}, {})
    counts = rows.select("text", "y").mapInArrow(of, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # the log-odds less their standard error twice
    odds = F.log((F.col("toxic") + 0.5) / n1) - F.log((F.col("clean") + 0.5) / n0)
    sure = odds - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = counts.where(F.col("toxic") >= least).withColumn("weight", sure).where("weight > 1").orderBy(F.desc("weight"), "term").limit(most).collect()
    pick = lambda mark: {r.term[1:]: min(8.0, r.weight) for r in found if r.term[0] == mark}
    return Lexicon(pick("="), pick("^"))


class Features:
    """Vectors of texts; the code of a word is computed once and kept."""

    names = (
        "words word start general leet weight top hits distinct near nearest address capitals all_caps exclaim question "
        "stops commas symbols digits masked long bytes ascii mean_length"
    ).split()

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.memo = Memo(lambda words: [self.code(w) for w in words])

    def code(self, raw: str) -> int:
        """Flags of a word in the low byte, its lexicon weight (32nds) above."""
        flags, weight = 0, 0.0
        low = raw.lower()
        parts = LETTERS.findall(low)
        for w in parts:
            if w in self.lexicon.words:
                flags |= WORD
                weight = max(weight, self.lexicon.words[w])
            for k in PREFIXES:
                if len(w) > k and w[:k] in self.lexicon.starts:
                    flags |= START
                    weight = max(weight, self.lexicon.starts[w[:k]])
            if w in INSULTS:
                flags |= GENERAL
            if w in ADDRESS:
                flags |= ADDRESSED
        if len(raw) > 1 and raw.isupper():
            flags |= CAPS
        if STRETCHED.search(low) and parts:
            flags |= LONG
        core = low.strip(".,;:!?\"'()[]")
        if len(parts) != 1 or parts[0] != core:
            plain = "".join(LETTERS.findall(core.translate(LEET)))
            if len(core) > 2 and parts and len(plain) > 2 and core not in parts:
                flags |= MASKED
                if plain in self.lexicon.words or plain in INSULTS:
                    flags |= LEETED
        return flags | min(255, int(weight * 32)) << 8

    def of(self, text: str) -> list[float]:
        raw = text.encode("utf-8")
        chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words = text.split()
        n = max(1, len(words))
        codes = np.array(self.memo.of(words), np.int64)
        flags, weight = codes & 255, (codes >> 8) / 32
        count = lambda f: float(np.count_nonzero(flags & f))
        hits, address = np.flatnonzero(flags & HIT), np.flatnonzero(flags & ADDRESSED)
        near = 0.0
        nearest = 0.0
        if len(hits) and len(address):
            at = np.searchsorted(address, hits)
            gap = np.minimum(np.abs(hits - address[np.minimum(at, len(address) - 1)]), np.abs(hits - address[np.maximum(at - 1, 0)]))
            near, nearest = float(np.count_nonzero(gap <= 5)) / n, 1 / (1 + float(gap.min()))
        letters = max(1, int(chars[65:91].sum() + chars[97:123].sum() + chars[128:].sum() // 2))
        size = max(1, len(raw))
        symbols = int(chars[35:39].sum() + chars[42] + chars[43] + chars[60:63].sum() + chars[64] + chars[91:97].sum() + chars[123:127].sum())
        return [
            math.log1p(len(words)), count(WORD) / n, count(START) / n, count(GENERAL) / n, count(LEETED) / n,
            float(weight.sum()) / n, float(weight.max()) if len(weight) else 0.0, math.log1p(len(hits)), float(len(np.unique(codes[hits]))), near, nearest,
            count(ADDRESSED) / n, float(chars[65:91].sum()) / letters, count(CAPS) / n, float(chars[33]) / size, float(chars[63]) / size,
            float(chars[46]) / size, float(chars[44]) / size, symbols / size, float(chars[48:58].sum()) / size, count(MASKED) / n, count(LONG) / n,
            math.log1p(len(raw)), float(chars[128:].sum()) / size, size / n,
        ]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.of(t or "") for t in texts], np.float64).reshape(len(texts), len(self.names))


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    classifier: Classifier


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> ToxicityModel:
    """Fit on about ``most`` labelled rows that are not held out, at most.

    Each half of them gets the lexicon of the other half for the trees, so that
    a word that marks its own row only by chance is worth nothing; documents
    are scored with the lexicon of both. Only lexicon terms (at most 2000) and
    feature vectors come to the driver.
    """
    rows = training_rows(docs, labels, "toxic", most).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))).persist()
    parts = []
    for half in (0, 1):
        other = learn_lexicon(rows.where(F.col("half") != half))
        parts.append(collect_features(rows.where(F.col("half") == half), lambda lexicon=other: Features(lexicon)))
    lexicon = learn_lexicon(rows)
    rows.unpersist()
    some = [p for p in parts if len(p[1])]
    x, y = (np.concatenate([p[k] for p in some]) if some else np.zeros((0, 1)[: 2 - k]) for k in (0, 1))
    # halves alternate, so that folds hold both
    order = np.random.default_rng(5).permutation(len(y))
    return ToxicityModel(lexicon, fit_classifier(x[order], y[order], trees=80, depth=3))


def collect_features(rows: DataFrame, make) -> tuple[np.ndarray, np.ndarray]:
    """Feature vectors and labels of the bounded training rows, in the order of a hash of the id."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = make()
        for batch in sliced(batches):
            x = features.matrix(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = rows.select("doc_id", "text", "y").mapInArrow(of, "doc_id long, y int, x array<double>").toArrow()
    if not got.num_rows:
        return np.zeros((0, 1)), np.zeros(0)
    ids = got.column("doc_id").to_numpy().astype(np.uint64)
    order = np.lexsort((ids, (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)))
    x = np.array(got.column("x").combine_chunks().values.to_numpy()).reshape(got.num_rows, -1)
    return x[order], got.column("y").to_numpy().astype(np.float64)[order]


def scored(docs: DataFrame, make, classifier: Classifier, threshold: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` (and the columns ``keep``) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # a few thousand tree nodes
    # the text is not sent twice
    extra = [f"kept_{i}" for i, k in enumerate(keep) if k != "text"]
    names = ["text" if k == "text" else f"kept_{i}" for i, k in enumerate(keep)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = make()
        for batch in sliced(batches):
            score = shared.value.score(features.matrix(batch.column(1).to_pylist()))
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept, pa.array(score)], ["doc_id", *names, "score"])

    fields = "".join(f"{n} {docs.schema[k].dataType.simpleString()}, " for n, k in zip(names, keep, strict=True))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), *(F.col(f"`{k}`").alias(n) for n, k in zip(names, keep, strict=True) if n in extra))
    out = rows.mapInArrow(of, f"doc_id long, {fields}score double")
    return out.select("doc_id", *(F.col(n).alias(k) for n, k in zip(names, keep, strict=True)), held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = 20_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``held_out, score, predicted`` for every row of ``docs``.

    Held-out rows teach nothing; ids, languages, sources and labels are no
    features. A null text is scored as an empty one, a null doc_id stays null
    and is not held out, repeated rows are scored each. Without labels of both
    kinds the score is the calibrated base rate.
    """
    model = fit_toxicity(docs, labels, most)
    lexicon = model.lexicon
    return scored(docs, lambda: Features(lexicon), model.classifier, threshold, keep)
