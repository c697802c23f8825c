"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are those of the byte histogram, of words, lines and repeated
parts of a text; none knows the language, the source or the id.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from spindle.llm.gbdt import Classifier, fit_classifier
from spindle.llm.labelled import training_rows
from spindle.llm.toxicity import collect_features, scored

ENDS = re.compile(r"[.!?]+[\s]+")
LETTERS = re.compile(r"[^\W\d_]+")
#: Frequent short words of the corpus' languages.
COMMON = frozenset(
    "the of and to in a is that it for was on be with as by at from or this an are he have not "
    "der die das und in den von zu mit ist im für auf dem nicht ein eine als auch es an "
    "le la les de et un une en du des que dans est pour qui sur par au il ne se pas "
    "el los las y del que en un una por con para es se no su al lo como".split()
)


class Statistics:
    """Vectors of document statistics."""

    names = (
        "words bytes word_length word_spread upper digits spaces lines ascii_rest exclaim question stop comma pipe hash_like "
        "brackets quotes percent entropy distinct common plain_words caps_words symbol_ends top_word second_word line_length "
        "short_lines repeated_lines repeated_sentences repeated_pairs sentence_length stop_ends upper_starts longest_run"
    ).split()

    def of(self, text: str) -> list[float]:
        raw = text.encode("utf-8")
        size = max(1, len(raw))
        data = np.frombuffer(raw, np.uint8)
        chars = np.bincount(data, minlength=256).astype(np.float64)
        words = text.split()
        n = max(1, len(words))
        lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
        count: dict[str, int] = {}
        for w in words:
            count[w] = count.get(w, 0) + 1
        top = sorted(count.values(), reverse=True)[:2] + [0, 0]
        plain = caps = ends = common = starts = 0
        for w, c in count.items():
            if w.isalpha():
                plain += c
            elif not (w[-1].isalnum() or w[-1] in ".,;:!?)\"'"):
                ends += c
            if len(w) > 1 and w.isupper():
                caps += c
            if w[:1].isupper():
                starts += c
            if w.lower().strip(".,;:!?\"'()") in COMMON:
                common += c
        lines = text.split("\n")
        sentences = ENDS.split(text)
        pairs = len(set(zip(words, words[1:], strict=False)))
        p = chars[chars > 0] / size
        change = np.flatnonzero(np.diff(data)) if len(data) > 1 else np.zeros(0, np.int64)
        run = float(np.diff(np.concatenate([[-1], change, [len(data) - 1]])).max()) if len(data) else 0.0
        letters = max(1.0, chars[65:91].sum() + chars[97:123].sum() + chars[128:].sum() / 2)
        return [
            math.log1p(len(words)), math.log1p(len(raw)), float(lengths.mean()), float(lengths.std()), chars[65:91].sum() / letters,
            chars[48:58].sum() / size, chars[32] / size, chars[10] / size, chars[128:].sum() / size, chars[33] / size, chars[63] / size,
            chars[46] / size, chars[44] / size, chars[124] / size, (chars[35] + chars[36] + chars[38] + chars[42]) / size,
            (chars[40:42].sum() + chars[60] + chars[62] + chars[91] + chars[93] + chars[123] + chars[125]) / size, (chars[34] + chars[39]) / size,
            chars[37] / size, float(-(p * np.log2(p)).sum()) if len(raw) else 0.0, len(count) / n, common / n, plain / n, caps / n, ends / n,
            top[0] / n, top[1] / n, math.log1p(len(text) / len(lines)), sum(len(x) < 20 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines),
            1 - len(set(sentences)) / len(sentences), 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0, math.log1p(len(words) / len(sentences)),
            (len(sentences) - 1) / n, starts / n, math.log1p(run),
        ]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.of(t or "") for t in texts], np.float64).reshape(len(texts), len(self.names))


@dataclass
class QualityModel:
    classifier: Classifier


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> QualityModel:
    """Fit on about ``most`` labelled rows that are not held out, at most; only vectors come to the driver."""
    x, y = collect_features(training_rows(docs, labels, "quality", most), Statistics)
    return QualityModel(fit_classifier(x, y, trees=100, depth=4))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 20_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``held_out, score, predicted`` for every row of ``docs``.

    Held-out rows teach nothing; ids, languages, sources and labels are no
    features. A null text is scored as an empty one, a null doc_id stays null
    and is not held out, repeated rows are scored each. Without labels of both
    kinds the score is the base rate.
    """
    return scored(docs, Statistics, fit_quality(docs, labels, most).classifier, threshold, keep)
