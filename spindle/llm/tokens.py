"""Pre-tokens of the public tokenizers, and memos of what they encode to.

A byte-pair tokenizer first cuts a text into pre-tokens and encodes each by
itself, so a task encodes a pre-token once and reuses the result. Texts with
characters outside the plain range are cut by the library's own normalizer and
pre-tokenizer, all others by patterns that give the same pre-tokens.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

# The apostrophe endings of both tokenizers' split patterns.
ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
#: Letters of the plain range (Latin-1 and Latin Extended-A, without the dotted capital I).
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f"
#: Characters whose class, case or composition the plain patterns below do not settle.
ODD = re.compile("[\x1c-\x1f\x85\xa0\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\u0130\u0149\u0180-\u200f\u2028-\u202f\u205f-\U0010ffff]")
#: The spaces of the plain range, and ASCII characters that count as space for Python only.
SPACES, CONTROLS = " \t\n\r\f\v", "\x1c\x1d\x1e\x1f"


def _patterns(letters: str) -> tuple[re.Pattern, re.Pattern]:
    """Pre-tokens of a byte-level vocabulary, and of one with word ends (of lower-cased texts)."""
    space, gap = f"[{SPACES}]", f"{SPACES}{letters}0-9"
    return (
        re.compile(rf"{ENDINGS}| ?[{letters}]+| ?[0-9]+| ?[^{gap}]+|{space}+(?![^{SPACES}])|{space}+"),
        re.compile(rf"{ENDINGS}|[{letters}]+|[0-9]|[^{gap}]+"),
    )


PLAIN_PRETOKENS, ASCII_PRETOKENS = _patterns(LETTERS), _patterns("A-Za-z")
#: Entries of a memo's younger generation; what is forgotten is learned again.
MEMO = 150_000


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    """The tokenizer in ``path``, without truncation and padding."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def specials(path: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in spec(path)["added_tokens"]}


class Pretokens:
    """Cuts texts into pre-tokens as the tokenizer in ``path`` does."""

    def __init__(self, path: str):
        self.word_ends = bool(spec(path)["model"].get("end_of_word_suffix"))
        self.specials = specials(path)
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.library = load(path)

    def of_part(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if text.isascii() and not any(c in text for c in CONTROLS):
            patterns = ASCII_PRETOKENS
        elif ODD.search(text) is None:
            patterns = PLAIN_PRETOKENS
        else:
            return self._of_library(text)
        return patterns[1].findall(text.lower()) if self.word_ends else patterns[0].findall(text)

    def _of_library(self, text: str) -> list[str]:
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        """Pre-tokens of any text, and its special strings where they stand."""
        if "<|" not in text:
            return self.of_part(text)
        out: list[str] = []
        for k, part in enumerate(self.at_special.split(text)):
            out += [part] if k % 2 else self.of_part(part)
        return out


class Memo:
    """Pre-token -> what ``resolve`` makes of it.

    Two generations of up to ``limit`` entries are held: when the younger one
    is full it becomes the older one, whose entries stay if they are met again.
    ``kept`` is never forgotten.
    """

    def __init__(self, resolve: Callable[[list[str]], Iterable], kept: dict | None = None, limit: int = MEMO):
        self.kept, self.resolve, self.limit = kept or {}, resolve, limit
        self.known, self.old = dict(self.kept), {}

    def learned(self, lists: Iterable[list[str]]) -> dict:
        """The memo with all words of ``lists`` in it."""
        words = set().union(*lists)
        new = words.difference(self.known)
        if new:
            if len(self.known) - len(self.kept) + len(new) > self.limit:
                self.old, self.known, new = self.known, dict(self.kept), words.difference(self.kept)
            old = self.old
            self.known.update((w, old[w]) for w in new if w in old)
            fresh = [w for w in new if w not in old]
            self.known.update(zip(fresh, self.resolve(fresh), strict=True))
        return self.known

    def of(self, words: list[str]) -> list:
        return list(map(self.learned([words]).__getitem__, words))


class RankTable:
    """Ranks of pairs of ids in an open table: a pair lies at its hash or shortly behind it."""

    def __init__(self, pairs: np.ndarray):
        self.none = len(pairs)
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int32)
        at, rest = self._home(pairs), np.arange(len(pairs))
        while len(rest):
            # of the pairs at a free place one takes it, the others go on
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = pairs[rest[free]]
            self.ranks[at[free]] = rest[free]
            lost = self.keys[at] != pairs[rest]
            at, rest = (at[lost] + 1) & ((1 << self.bits) - 1), rest[lost]

    def _home(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, the number of pairs where there is none."""
        key = ((a.astype(np.int64) << 32) | b).ravel()
        at = self._home(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], np.int32(self.none))
        live = np.flatnonzero((found != key) & (found >= 0))
        while len(live):
            at[live] = (at[live] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[live]]
            hit = found == key[live]
            out[live[hit]] = self.ranks[at[live[hit]]]
            live = live[~hit & (found >= 0)]
        return out.reshape(np.shape(a))


class Merges:
    """Byte-pair merges by rank; ``ids`` gives the ids of one pre-token."""

    def __init__(self, path: str):
        model = spec(path)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.chars = byte_chars()

    def ids(self, word: str) -> list[int]:
        return [self.vocab[p] for p in self.parts([*word.encode("utf-8").decode("latin-1").translate(self.chars)])]

    def _arrays(self) -> tuple[np.ndarray, np.ndarray, RankTable]:
        """First ids by byte, inside and at the end of a word; merged ids by rank; ranks of pairs of ids."""
        if not hasattr(self, "_held"):
            first = np.array([[self.vocab[c + end] for c in (self.chars[b] for b in range(256))] for end in ("", self.suffix)], np.int32)
            pairs = np.array([(self.vocab[a] << 32) | self.vocab[b] for a, b in self.ranks], np.int64)
            self._held = first, np.array([self.vocab[a + b] for a, b in self.ranks], np.int32), RankTable(pairs)
        return self._held

    def many(self, words: list[str]) -> list[bytes]:
        """``ids`` of many words as little-endian 32-bit bytes; words of like length are merged in step."""
        raw = [w.encode("utf-8") for w in words]
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, r in enumerate(raw):
            n = len(r)
            groups.setdefault(n if n <= 16 else (n + 7) // 8 * 8, []).append(i)
        for width, own in groups.items():
            if width > 64:
                for i in own:
                    out[i] = np.array(self.ids(words[i]), "<u4").tobytes()
            elif width:
                for a in range(0, len(own), 8192):
                    self._merge([raw[i] for i in own[a : a + 8192]], own[a : a + 8192], width, out)
        return out

    def _merge(self, raw: list[bytes], to: list[int], width: int, out: list[bytes]) -> None:
        first, merged, ranks = self._arrays()
        none = len(merged)
        size = np.fromiter(map(len, raw), np.int32, len(raw))
        data = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(len(raw), width)
        column = np.arange(width, dtype=np.int32)
        t = first[0][data]
        t[np.arange(len(raw)), size - 1] = first[1][data[np.arange(len(raw)), size - 1]]
        r = np.full((len(raw), width), none, np.int32)
        r[:, :-1] = np.where(column[1:] < size[:, None], ranks.of(t[:, :-1], t[:, 1:]), none)
        live = np.arange(len(raw))
        left_of = lambda best: np.maximum(best - 1, 0)
        done = np.zeros((len(raw), width), np.int32)
        while True:
            best = r.argmin(1).astype(np.int32)  # the leftmost of the least rank
            row = np.arange(len(live))
            go = r[row, best] < none
            if not go.all():
                done[live[~go]] = t[~go]
                live, best, t, r = live[go], best[go], t[go], r[go]
                row = np.arange(len(live))
            if not len(live):
                break
            # the right part of the pair goes, and what follows moves up
            value = r[row, best]
            take = np.minimum(column + (column > best[:, None]), width - 1)
            t = np.take_along_axis(t, take, 1)
            t[row, best] = merged[value]
            size[live] -= 1
            r = np.take_along_axis(r, np.minimum(column + (column >= best[:, None]), width - 1), 1)
            r[:, -1] = none
            left, after = left_of(best), np.minimum(best + 1, width - 1)
            r[row, best] = np.where(best + 1 < size[live], ranks.of(t[row, best], t[row, after]), none)
            r[row, left] = np.where(best > 0, ranks.of(t[row, left], t[row, best]), r[row, left])
        data = done.astype("<u4").tobytes()
        for i, k, n in zip(to, range(0, 4 * width * len(to), 4 * width), size.tolist(), strict=True):
            out[i] = data[k : k + 4 * n]

    def parts(self, parts: list[str]) -> list[str]:
        if self.suffix and parts:
            parts[-1] += self.suffix
        if len(parts) > 48:
            return self._long(parts)
        rank = self.ranks.get
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _long(self, parts: list[str]) -> list[str]:
        """The same merges with a heap, for long pre-tokens."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]


@lru_cache(maxsize=1)
def byte_chars() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def grouped(texts: list[str], rows: int = 1024, chars: int = 2 << 20) -> Iterator[list[str]]:
    """Cut a list of texts into groups of bounded size; a longer text comes alone."""
    group: list[str] = []
    size = 0
    for t in texts:
        if group and (len(group) == rows or size + len(t) > chars):
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


@lru_cache(maxsize=4)
def text_encoder(path: str) -> Callable[[list[str]], Iterator[bytes]]:
    """texts -> the ids of each as little-endian 32-bit bytes, as the tokenizers library gives them for the whole text."""
    pretokens = Pretokens(path)
    memo = Memo(Merges(path).many, {s: i.to_bytes(4, "little") for s, i in pretokens.specials.items()})

    def encode(texts: list[str]) -> Iterator[bytes]:
        for group in grouped(texts):
            lists = [pretokens.words(t) for t in group]
            known = memo.learned(lists).__getitem__
            for words in lists:
                yield b"".join(map(known, words))

    return encode
