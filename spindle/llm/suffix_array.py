"""Suffix arrays by induced sorting, in numpy, and permuted common prefixes.

The scans of induced sorting go over runs of buckets: all suffixes that the
entries of a run induce are placed at once, in order. Entries may induce into their own run
once, but not twice in a row, so a scan over a large alphabet of names takes
few steps. A bucket that would stands alone, and is read again until nothing
new falls into it.
"""

from __future__ import annotations

import numpy as np

#: Where the recursion ends: strings of names up to this length are sorted by pairs.
SHORT = 1 << 10


def stable_order(keys: np.ndarray, bound: int) -> np.ndarray:
    """Stable order of integers from 0 to below ``bound``, by counting 16 bits at a time."""
    if bound <= 1 << 16:
        return np.argsort(keys.astype(np.uint16), kind="stable")
    low = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((keys >> 16).astype(np.uint16)[low], kind="stable")]


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last (sentinel) is."""
    small = np.append(t[:-1] < t[1:], True)
    equal = np.flatnonzero(t[:-1] == t[1:])
    if len(equal):
        end = np.flatnonzero(np.append(equal[1:] != equal[:-1] + 1, True))
        small[equal] = np.repeat(small[equal[end] + 1], np.diff(end, prepend=-1))
    return small


def _runs(target: np.ndarray) -> list[tuple[int, int, bool]]:
    """Cut buckets 0, 1, ... into runs (begin, end, alone); ``target`` is the least bucket each reaches in two steps."""
    out, lo, n = [], 0, len(target)
    while lo < n:
        if target[lo] <= lo:
            out.append((lo, lo + 1, True))
            lo += 1
            continue
        hi, least, step = lo, n, 32
        while hi < n:
            part = np.minimum(np.minimum.accumulate(target[hi : hi + step]), least)
            clash = part <= np.arange(hi, hi + len(part))
            if clash.any():
                hi += int(clash.argmax())
                break
            hi, least, step = hi + len(part), part[-1], 2 * step
        out.append((lo, hi, False))
        lo = hi
    return out


class Induction:
    """The buckets of a text, and the scans that sort all suffixes from leftmost-smaller ones."""

    def __init__(self, t: np.ndarray, bound: int):
        self.t, self.bound, self.small = t, bound, classify(t)
        sizes = np.bincount(t, minlength=bound)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.places = np.arange(len(t), dtype=np.int32)
        none = t.dtype.type(-1)
        # the character before each position, where that suffix is larger (smaller) than the one at the position
        self.larger, self.smaller = np.full(len(t), none), np.full(len(t), none)
        np.copyto(self.larger[1:], t[:-1], where=~self.small[:-1])
        np.copyto(self.smaller[1:], t[:-1], where=self.small[:-1])
        self.lms = np.flatnonzero(self.small & (self.larger >= 0))
        self.upward = _runs(self._reach(self.larger, 0, 1))
        self.downward = [(bound - hi, bound - lo, alone) for lo, hi, alone in _runs(self._reach(self.smaller, bound - 1, -1))]

    def _reach(self, before: np.ndarray, base: int, sign: int) -> np.ndarray:
        """By bucket, the nearest one that its entries reach in two steps."""
        out = np.full(self.bound, self.bound, np.int64)
        i = np.flatnonzero((before[2:] >= 0) & (before[1:-1] >= 0))
        np.minimum.at(out, base + sign * self.t[i + 2].astype(np.int64), base + sign * self.t[i].astype(np.int64))
        return out

    def _place(self, out: np.ndarray, at: np.ndarray, entries: np.ndarray, c: np.ndarray, step: int) -> None:
        """Append the predecessors of ``entries``, whose first characters are ``c``, to their buckets, in order."""
        if not len(c):
            return
        order = stable_order(c, self.bound)
        c = c[order]
        place = self.places[: len(c)]
        first = np.zeros(len(c), np.int32)
        np.multiply(place[1:], c[1:] != c[:-1], out=first[1:])
        slot = at[c] + step * (place - np.maximum.accumulate(first))
        out[slot] = entries[order] - 1
        at[c] = slot + step  # the last entry of a bucket sets its new border

    def _scan(self, out: np.ndarray, at: np.ndarray, entries: np.ndarray, before: np.ndarray, step: int) -> None:
        c = before[entries]
        go = c >= 0
        self._place(out, at, entries[go], c[go], step)

    def sort(self, seeds: np.ndarray) -> np.ndarray:
        """All suffixes, induced from the leftmost-smaller ones in the order of ``seeds``."""
        out = np.full(len(self.t), -1, np.int32)
        number = np.bincount(self.t[seeds], minlength=self.bound)
        self._place(out, self.ends - number, seeds + 1, self.t[seeds], 1)
        seeded = np.flatnonzero(out >= 0)[1:]  # all but the sentinel, which nothing induces
        head = self.begins.copy()
        for lo, hi, alone in self.upward:
            a, b = self.begins[lo], self.ends[hi - 1]
            if a == b:
                continue
            if alone:
                while a < head[lo]:
                    e = out[a : head[lo]]
                    a = head[lo]
                    self._scan(out, head, e, self.larger, 1)
                self._scan(out, head, out[b - number[lo] : b], self.larger, 1)
                continue
            # what falls into the run itself comes first; it induces nothing that does
            e = out[a:b]
            e = e[e >= 0]
            c = self.larger[e]
            inside = (c >= 0) & (c < hi)
            if inside.any():
                self._place(out, head, e[inside], c[inside], 1)
                e = out[a:b]
                e = e[e >= 0]
                c = self.larger[e]
            go = c >= hi
            self._place(out, head, e[go], c[go], 1)
        out[seeded] = -1
        tail = self.ends - 1
        for lo, hi, alone in self.downward:
            a, b = self.begins[lo], self.ends[hi - 1]
            if a == b:
                continue
            if alone:
                while b > tail[lo] + 1:
                    e = out[tail[lo] + 1 : b][::-1]
                    b = tail[lo] + 1
                    self._scan(out, tail, e, self.smaller, -1)
                self._scan(out, tail, out[a : head[lo]][::-1], self.smaller, -1)
                continue
            e = out[a:b][::-1]
            e = e[e >= 0]
            c = self.smaller[e]
            inside = c >= lo
            if inside.any():
                self._place(out, tail, e[inside], c[inside], -1)
                e = out[a:b][::-1]
                e = e[e >= 0]
                c = self.smaller[e]
            go = (c >= 0) & (c < lo)
            self._place(out, tail, e[go], c[go], -1)
        return out


def _names(data: np.ndarray, width: int, lms: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings, equal for equal ones, and their number.

    ``data`` has the characters as ``width`` bytes each; ``place`` lists the
    substrings (by their place in ``lms``) in order.
    """
    size = np.append(np.diff(lms) + 1, 1) * width
    words = _words(data, 8)
    a, b = place[:-1], place[1:]
    same = size[a] == size[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        rest = np.minimum(size[a[live]] - k, 8)
        differ = (words[lms[a[live]] * width + k] ^ words[lms[b[live]] * width + k]) << (8 * (8 - rest)).astype(np.uint64) != 0
        same[live[differ]] = False
        live = live[~differ & (rest == 8)]
        k += 8
        live = live[size[a[live]] > k]
    names = np.empty(len(lms), np.int32)
    names[place] = np.concatenate([[0], np.cumsum(~same)])
    return names, int((~same).sum()) + 1


def _words(data: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes from every byte on (zeros behind the end), as little-endian numbers."""
    padded = np.append(data.view(np.uint8), np.zeros(pad + 8, np.uint8))
    return np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))


def _doubled(t: np.ndarray) -> np.ndarray:
    """The suffix array of a short ``t``, which ends with its only 0, by pairs of ranks."""
    n, reach, rank = len(t), 1, t
    while True:
        after = np.append(rank[reach:], np.zeros(min(reach, n), rank.dtype))
        order = stable_order(after, SHORT + 1)
        order = order[stable_order(rank[order], SHORT + 1)]
        differ = (rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]])
        if differ.all():
            return order.astype(np.int32)
        rank = np.empty(n, np.int32)
        rank[order] = np.concatenate([[0], np.cumsum(differ)])
        reach *= 2


def _sorted_suffixes(t: np.ndarray, bound: int, data: np.ndarray, width: int) -> np.ndarray:
    """The suffix array of ``t``, which ends with its only 0; the recursion ends at short strings of names."""
    if width > 1 and len(t) <= SHORT:
        return _doubled(t)
    scan = Induction(t, bound)
    lms = scan.lms
    if len(lms) > 1:
        # sort the leftmost-smaller substrings, name them, and sort the string of names
        rank = np.full(len(t), -1, np.int32)
        rank[lms] = np.arange(len(lms), dtype=np.int32)
        place = rank[scan.sort(lms)]
        place = place[place >= 0]
        names, distinct = _names(data, width, lms, place)
        if distinct < len(lms):
            place = _sorted_suffixes(names, distinct, names, 4)
        lms = lms[place]
    return scan.sort(lms)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (bytes) in the order of their suffixes."""
    if len(text) < 2:
        return np.arange(len(text), dtype=np.int32)
    t = np.append(text.astype(np.int16) + 1, 0).astype(np.int16)
    return _sorted_suffixes(t, 257, text, 1)[1:]


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For every position the common prefix with the suffix before it in ``sa``.

    Where both suffixes follow the same byte, the prefix is one shorter than
    the one at the position before, so only the others are compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    told = np.zeros(n, bool)
    told[1:] = (before[1:] > 0) & (text[:-1] == text[before[1:] - 1])
    compared = np.flatnonzero(~told)
    a, b = compared, before[compared]
    words = _words(text, 8)
    out = np.zeros(len(compared), np.int32)
    live = np.flatnonzero(b >= 0)
    most = n - np.maximum(a, b)
    k = 0
    while len(live):
        x = words[a[live] + k] ^ words[b[live] + k]
        low = x & (~x + np.uint64(1))
        out[live] += np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        k += 8
        live = live[(x == 0) & (most[live] > k)]
    out = np.minimum(out, most)
    return np.repeat(out + compared, np.diff(compared, append=n)) - np.arange(n)
