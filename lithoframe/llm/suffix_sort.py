"""External induced suffix sorting with common-prefix values, over a set of byte strings.

Suffixes that start a rise after a fall (S*) are named by their stretch up to
the next, the names form a shorter text, and its order, found the same way, is
theirs. All other suffixes follow by induction: going through the symbols in
order, each suffix puts its left neighbour at the end of that neighbour's
symbol. A priority queue by symbol holds what is put; in a symbol it is first
in, first out, and beyond its share of memory it goes to disk. A tuple is a
position and the length of the prefix shared with the tuple before it in its
symbol, which follows from the least such length between their inducers.

Everything works on chunks as arrays. Text and types may be memory-mapped.
Lengths are cut at ``depth``; suffixes that share so much are in any order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 16
_LOG = np.zeros(CHUNK + 1, np.int64)
for _k in range(1, 17):
    _LOG[1 << _k :] = _k


class BucketQueue:
    """Tuples by symbol, first in, first out; beyond ``memory`` bytes the largest part goes to files, each of many parts."""

    def __init__(self, symbols: int, memory: int, folder: str, name: str):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.next = [0] * symbols
        self.memory, self.held, self.stem, self.files = memory, 0, os.path.join(folder, name), 0

    def push(self, symbol: int, places: np.ndarray, shared: np.ndarray) -> None:
        self.parts[symbol].append((places, shared))
        self.held += places.nbytes + shared.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        sizes = [sum(p[0].nbytes + p[1].nbytes for p in parts if not isinstance(p, str)) for parts in self.parts]
        for symbol in np.argsort(sizes)[::-1].tolist():
            if self.held <= self.memory // 2 or not sizes[symbol]:
                break
            # The order is kept: neighbours in memory become one file, but for those that a reader has had and those to come.
            old, new, cut, group = self.parts[symbol], [], self.next[symbol], []
            for i, part in enumerate([*old, ""]):
                if group and (i == cut or isinstance(part, str)):
                    new.append(self.store(group))
                    group = []
                if i == cut:
                    self.next[symbol] = len(new)
                if isinstance(part, str):
                    new.append(part)
                else:
                    group.append(part)
            old[:] = new[:-1]
            self.held -= sizes[symbol]

    def drop(self, symbol: int) -> None:
        """Forget a symbol's tuples; what they took of the memory is free again."""
        for part in self.parts[symbol]:
            if isinstance(part, str):
                os.unlink(part)
            else:
                self.held -= part[0].nbytes + part[1].nbytes
        self.parts[symbol] = []

    def store(self, group: list) -> str:
        path = f"{self.stem}-{self.files}.npz"
        np.savez(path, places=np.concatenate([g[0] for g in group]), shared=np.concatenate([g[1] for g in group]))
        self.files += 1
        return path

    @staticmethod
    def load(part) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part, str):
            with np.load(part) as f:
                return f["places"], f["shared"]
        return part

    def chunks(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a symbol in order, in chunks, with those that are put while it runs."""
        parts = self.parts[symbol]
        while self.next[symbol] < len(parts):
            group, n = [], 0
            while self.next[symbol] < len(parts) and n < CHUNK:
                group.append(self.load(parts[self.next[symbol]]))
                n += len(group[-1][0])
                self.next[symbol] += 1
            places, shared = group[0] if len(group) == 1 else (np.concatenate([g[0] for g in group]), np.concatenate([g[1] for g in group]))
            for i in range(0, n, CHUNK):
                yield places[i : i + CHUNK], shared[i : i + CHUNK]

    def backwards(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a symbol from the last, each with the prefix shared with its follower (0 for the last)."""
        follower = np.zeros(1, np.uint8)
        for part in reversed(self.parts[symbol]):
            places, shared = self.load(part)
            for end in range(len(places), 0, -CHUNK):
                begin = max(0, end - CHUNK)
                s = shared[begin:end]
                yield places[begin:end][::-1], np.concatenate([s[1:], follower])[::-1]
                follower = s[:1]


class _Inducer:
    """Puts left neighbours of one type, with shared prefixes."""

    def __init__(self, text, rises, queue: BucketQueue, type_: bool, depth: int, symbols: int, lcp: bool):
        self.text, self.rises, self.queue, self.type, self.depth, self.lcp = text, rises, queue, type_, depth, lcp
        self.since = np.full(symbols, depth, np.uint8)

    def feed(self, places: np.ndarray, shared: np.ndarray) -> None:
        """``shared``: the prefix each tuple shares with the one fed before it."""
        left = places - 1
        take = np.flatnonzero(left >= 0)
        take = take[self.rises[left[take]] == self.type]
        symbols = self.text[left[take]]
        order = np.argsort(symbols, kind="stable")
        at, symbols = take[order], symbols[order]
        m = len(places)
        first = np.concatenate([[True], symbols[1:] != symbols[:-1]]) if len(at) else np.zeros(0, bool)
        new = np.zeros(len(at), np.uint8)
        if self.lcp:
            levels = [shared]
            while 1 << len(levels) <= m:
                p, w = levels[-1], 1 << (len(levels) - 1)
                q = p.copy()
                np.minimum(p[: m - w], p[w:], out=q[: m - w])
                levels.append(q)
            table = np.concatenate(levels)

            def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
                k = _LOG[hi - lo + 1]
                return np.minimum(table[k * m + lo], table[k * m + hi + 1 - (1 << k)])

            if len(at):
                new = least(np.where(first, 0, np.concatenate([[0], at[:-1] + 1])), at)
                new[first] = np.minimum(new[first], self.since[symbols[first]])
                new = np.minimum(new, self.depth - 1) + np.uint8(1)
            np.minimum(self.since, shared.min(), out=self.since)
            if len(at):
                last = np.concatenate([first[1:], [True]])
                tail = at[last]
                inner = tail < m - 1
                rest = np.full(len(tail), self.depth, np.uint8)
                rest[inner] = least(tail[inner] + 1, np.full(int(inner.sum()), m - 1))
                self.since[symbols[last]] = rest
        if len(at):
            cuts = np.flatnonzero(first)
            put = left[at]
            for s, i, j in zip(symbols[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
                self.queue.push(s, put[i:j], new[i:j])


def rises_of(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is not (S and L types)."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    up = np.concatenate([text[:-1][differs] < text[1:][differs], [False]])
    return np.repeat(up, np.diff(np.concatenate([[-1], differs, [n - 1]])))


def _refine(rank: np.ndarray, rows: np.ndarray, key: np.ndarray) -> None:
    """Order rows of equal rank by ``key``. A rank is the number of rows of lower rank; ``rows`` holds whole ranks."""
    old = rank[rows]
    low = int(key.min(initial=0))
    bits = int(key.max(initial=0) - low).bit_length()
    if bits + len(rank).bit_length() < 63:  # one number for both
        order = np.argsort((old << bits) + (key - low))
    else:
        order = np.lexsort((key, old))
    rows, old, key = rows[order], old[order], key[order]
    at = np.arange(len(rows))
    new_rank = np.concatenate([[True], old[1:] != old[:-1]])
    new_key = new_rank | np.concatenate([[True], key[1:] != key[:-1]])
    start = np.maximum.accumulate(np.where(new_rank, at, 0))
    sub = np.maximum.accumulate(np.where(new_key, at, 0))
    rank[rows] = old + sub - start


def _ties(rank: np.ndarray) -> np.ndarray:
    """Rows whose rank is not theirs alone."""
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def doubling(names: np.ndarray, depth: int, places: np.ndarray | None = None, reach: int = 0) -> np.ndarray:
    """Order of the suffixes of a text in memory, by its first ``depth`` symbols at least, or as many as span ``reach`` in ``places``."""
    n = len(names)
    rank = np.zeros(n, np.int64)
    if n:
        _refine(rank, np.arange(n), names)
    k = 1
    while k < min(depth, n):
        rows = _ties(rank)
        if places is not None:  # what agrees so far spans enough where the next name after it starts that far on
            rows = rows[(rows + k >= n) | (places[np.minimum(rows + k, n - 1)] - places[rows] < reach)]
        if not len(rows):
            break
        key = np.full(len(rows), -1, np.int64)
        inside = rows + k < n
        key[inside] = rank[rows[inside] + k]
        _refine(rank, rows, key)
        k *= 2
    return np.argsort(rank, kind="stable")


def _name_stars(text: np.ndarray, rises: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Ranks of the stretches from each star to the next, by symbol and type."""
    n = len(text)
    lengths = np.diff(np.concatenate([stars, [n - 1]])) + 1
    rank = np.zeros(len(stars), np.int64)
    bits = (2 * int(text.max(initial=0)) + 3).bit_length()
    codes = text.astype(np.uint16 if bits <= 16 else np.int64)
    codes *= 2
    codes += rises
    codes += 1
    rows, step = np.arange(len(stars)), 0
    while len(rows):
        if step:
            alone = np.bincount(rank, minlength=len(rank))[rank[rows]] == 1
            rows = rows[~alone]
            if not len(rows):
                break
        # As many symbols as fit a number beside the rank.
        take = max(1, (62 - (len(rank).bit_length() if step else 0)) // bits)
        key = np.zeros(len(rows), np.int64)
        begin, left = stars[rows] + step, lengths[rows] - step
        for t in range(take):
            key <<= bits
            key += codes[np.minimum(begin + t, n - 1)] * (t < left)
        step += take
        _refine(rank, rows, key)
        rows = rows[left > take]
    return rank


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` share, at most ``depth``."""
    out = np.full(len(a), depth, np.uint8)
    rows, n = np.arange(len(a)), len(text)
    if text.dtype == np.uint16 and n >= 4 and text.flags.c_contiguous:  # four symbols at a time
        four = np.ndarray((n - 3,), "<u8", buffer=text, strides=(2,))
        for k in range(0, depth, 4):
            x, y = a[rows] + k, b[rows] + k
            inside = np.maximum(x, y) <= n - 4
            diff = np.ones(len(rows), np.uint64)
            diff[inside] = four[x[inside]] ^ four[y[inside]]
            same = diff == 0
            ends = ~same & inside
            d = diff[ends]
            out[rows[ends]] = np.minimum(depth, k + (np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)) >> 4))
            near = rows[~inside]  # at the text's end, one at a time
            if len(near):
                out[near] = np.minimum(depth, k + _one_by_one(text, a[near] + k, b[near] + k, depth))
            rows = rows[same]
            if not len(rows):
                break
        return out
    return _one_by_one(text, a, b, depth)


def _one_by_one(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    out = np.full(len(a), depth, np.uint8)
    rows, n = np.arange(len(a)), len(text)
    for k in range(depth):
        inside = np.maximum(a[rows], b[rows]) + k < n
        same = np.zeros(len(rows), bool)
        same[inside] = text[a[rows[inside]] + k] == text[b[rows[inside]] + k]
        out[rows[~same]] = k
        rows = rows[same]
        if not len(rows):
            break
    return out


def suffixes_descending(text: np.ndarray, depth: int, memory: int = 64 << 20, in_memory: int = 4 << 20, folder: str | None = None, lcp: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of ``text`` from the largest: chunks of positions and of what each shares with the one before it in this order.

    ``depth`` is at most 255. ``memory`` bounds each queue; ``in_memory`` is the
    length from which a shorter text of names is sorted by induction too.
    """
    with tempfile.TemporaryDirectory(dir=folder) as own:
        yield from _induced(text, depth, memory, in_memory, own, lcp)


def _induced(text, depth, memory, in_memory, folder, lcp) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = len(text)
    if not n:
        return
    symbols = int(text.max()) + 1
    rises = rises_of(text)
    stars = np.flatnonzero(rises[1:] & ~rises[:-1]) + 1
    rank = _name_stars(text, rises, stars)
    if len(_ties(rank)):
        # Each name but the last covers two symbols at least, besides the one it shares with the next.
        below = depth // 2 + 1
        if len(rank) > in_memory:
            names = np.unique(rank, return_inverse=True)[1]
            inner = tempfile.mkdtemp(dir=folder)
            order = np.concatenate([p for p, _ in _induced(names, below, memory, in_memory, inner, False)])[::-1]
        else:
            order = doubling(rank, below, stars, depth)
    else:
        order = np.argsort(rank)
    kind = np.int32 if n < 1 << 31 else np.int64
    stars = stars[order].astype(kind)
    star_shared = np.zeros(len(stars), np.uint8)
    if lcp and len(stars) > 1:
        for i in range(1, len(stars), CHUNK):
            star_shared[i : i + CHUNK] = _shared(text, stars[i - 1 : i - 1 + CHUNK][: len(stars[i : i + CHUNK])], stars[i : i + CHUNK], depth)
    star_symbols = text[stars]
    begins = np.searchsorted(star_symbols, np.arange(symbols + 1))

    falling = BucketQueue(symbols, memory, folder, "l")
    induce = _Inducer(text, rises, falling, False, depth, symbols, lcp)
    falling.push(int(text[n - 1]), np.array([n - 1], kind), np.zeros(1, np.uint8))
    for c in range(symbols):
        last = None
        for places, shared in falling.chunks(c):
            if last is None:
                shared = shared.copy()
                shared[:1] = 0
            induce.feed(places, shared)
            last = places[-1:]
        for i in range(begins[c], begins[c + 1], CHUNK):
            j = min(begins[c + 1], i + CHUNK)
            places, shared = stars[i:j], star_shared[i:j].copy()
            if i == begins[c]:
                shared[:1] = _shared(text, last, places[:1], depth) if lcp and last is not None else 0
            induce.feed(places, shared)

    rising = BucketQueue(symbols, memory, folder, "s")
    induce = _Inducer(text, rises, rising, True, depth, symbols, lcp)
    for c in range(symbols - 1, -1, -1):
        last = None
        for places, shared in rising.chunks(c):
            if last is None:
                shared = shared.copy()
                shared[:1] = 0
            induce.feed(places, shared)
            yield places, shared
            last = places[-1:]
        top = True
        for places, shared in falling.backwards(c):
            if top:
                shared = shared.copy()
                shared[:1] = _shared(text, last, places[:1], depth) if lcp and last is not None else 0
                top = False
            induce.feed(places, shared)
            yield places, shared
        rising.drop(c)
        falling.drop(c)


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A text of symbols (bytes plus one) with 0 after each string, and where each string starts."""
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16)
    data += 1
    lengths = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    data[ends] = 0
    return data, ends - lengths


def least_owner(strings: list[bytes], owners: np.ndarray, width: int, **sizes) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``width`` bytes of each string, the least owner of a string that holds the same bytes.

    Returns the values of all windows, string by string, and where each string's begin.
    """
    text, starts = joined(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    counts = np.maximum(lengths - width + 1, 0)
    first = np.cumsum(counts) - counts
    # Of each position: the window that starts there, or -1, and its owner.
    window = np.full(len(text), -1, np.int32 if len(text) < 1 << 31 else np.int64)
    flat = np.repeat(starts - first, counts) + np.arange(int(counts.sum()))
    window[flat] = np.arange(len(flat))
    owner = np.repeat(owners, counts)
    out = np.zeros(len(flat), np.int64)
    held: list[np.ndarray] = []
    low = width

    def close(rows: np.ndarray, fresh: np.ndarray) -> None:
        begins = np.flatnonzero(fresh)
        least = np.minimum.reduceat(owner[rows], begins)
        out[rows] = np.repeat(least, np.diff([*begins, len(rows)]))

    for places, shared in suffixes_descending(text, width, **sizes):
        # The least shared prefix since the last window decides whether a window's bytes are the same.
        real = window[places] >= 0
        at = np.flatnonzero(real)
        if not len(at):
            low = min(low, int(shared.min()))
            continue
        between = np.minimum.reduceat(shared[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
        between[0] = min(int(between[0]), low)
        rows, fresh = window[places[at]], between < width
        low = int(shared[at[-1] + 1 :].min(initial=width))
        begins = np.flatnonzero(fresh)
        if not len(begins):
            held.append(rows)
            continue
        before = np.concatenate([*held, rows[: begins[0]]])
        if len(before):
            close(before, np.arange(len(before)) == 0)
        if begins[-1] > begins[0]:
            part = rows[begins[0] : begins[-1]]
            close(part, fresh[begins[0] : begins[-1]])
        held = [rows[begins[-1] :]]
    rest = np.concatenate(held) if held else np.zeros(0, np.int64)
    if len(rest):
        close(rest, np.arange(len(rest)) == 0)
    return out, first
