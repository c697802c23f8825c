from __future__ import annotations

import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, fp string, length long, label int"


def random_text(rng: random.Random, words: int, odd: bool = False) -> str:
    syllables = "an er in the re on at nd ou ti ed es st en to é ß ciòn".split()
    out = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    if odd:
        for extra in ("中文字", "don't", "é́", "１２³", "<|endoftext|>", "<|startoftext|>", "İstanbul", "ΣΑΣ", "  ", "🙂👍🏽", "\x1c\x85"):
            out.insert(rng.randrange(len(out) + 1), extra)
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, copies, near copies, shared passages, repeated rows and odd characters."""
    rng = random.Random(11)
    texts: list[str | None] = [random_text(rng, rng.randint(1, 120), odd=i % 5 == 0) for i in range(40)]
    passage = random_text(rng, 40)
    texts += [None, "", " ", "a", "one two", "x" * 30_000, "ab" * 9_000, "\n\n\t", "!!! !!! !!!" * 40]
    texts += [texts[3]] * 4 + [f"{random_text(rng, 20)} {passage} {random_text(rng, 9)}" for _ in range(6)]
    base = random_text(rng, 100).split()
    for i in range(8):
        near = list(base)
        near[i * 7] = f"changed{i}"
        texts.append(" ".join(near))
    texts.append(random_text(rng, 12_000))
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t, "en", f"s{i % 3}", len(t or ""), "clash", 7, i % 2) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5]]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with the operators' own, and a row without an id."""
    return spark.createDataFrame([*corpus, (None, "no id here but some words that stay " * 4, None, None, None, None, None, None)], KINDS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
