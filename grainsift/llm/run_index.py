"""A run-length compressed Burrows-Wheeler index of short texts, and matching statistics streamed through it.

The index keeps the runs of the transform: symbol, first rank, where the run's first rank maps to, and the text
positions at its two ends. A text is streamed from its end: while the transform holds the next symbol the match grows
by one LF step; otherwise it goes on at the end of the nearest run of that symbol above or below, whichever shares
more with the match so far. No match of a streamed position is longer than the one found.
"""

from __future__ import annotations

import numpy as np

FIRST = 7  # symbols of nine bits that the first sort of suffixes compares
NEAR = 16  # matches up to this length are compared on as many symbols
STEPS = 4  # symbols after which texts are given up


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts (byte + 1, and 0 behind each text) and the start of each text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size + 1) - size - 1
    out = np.zeros(int(size.sum()) + len(texts), np.uint16)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(texts)), size)] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    return out, start


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by prefix doubling; every 0 differs from all others and goes by its place."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(FIRST, symbols.dtype)]).astype(np.uint64)
    key, open_ = np.zeros(n, np.uint64), np.ones(n, bool)
    for d in range(FIRST):
        part = padded[d : d + n]
        key = (key << np.uint64(9)) | np.where(open_, part, np.uint64(0))
        open_ &= part != 0
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    rank[n] = 0
    unclear = at[~(new & np.append(new[1:], True))]

    def settle(some: np.ndarray, then: np.ndarray) -> np.ndarray:
        """Order the suffixes at these ranks by what comes then; the ranks that stay unclear."""
        if not len(some):
            return some
        place = order[some]
        both = (rank[place].astype(np.uint64) << np.uint64(32)) | then.astype(np.uint64)
        by = np.argsort(both)
        place, both = place[by], both[by]
        order[some] = place
        new = np.concatenate([[True], both[1:] != both[:-1]])
        rank[place] = np.maximum.accumulate(np.where(new, some, 0))
        return some[~(new & np.append(new[1:], True))]

    ended = ~open_[order[unclear]]  # suffixes that end within the first sort go by their place
    settle(unclear[ended], order[unclear[ended]])
    unclear, step = unclear[~ended], FIRST
    while len(unclear):
        unclear = settle(unclear, rank[order[unclear] + step])
        step *= 2
    return order


class RunIndex:
    """Index of some texts; `length` is the match that counts."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.symbols, self.start = joined(texts)
        n = len(self.symbols)
        order = suffix_order(self.symbols)
        before = self.symbols[order - 1]
        self.first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.symbol = before[self.first]
        last = np.append(self.first[1:], n) - 1
        self.place = np.stack([order[last], order[self.first]])  # of the suffixes at the run's last and first rank
        by = np.argsort(self.symbol, kind="stable")
        size = (last - self.first + 1)[by]
        self.maps = np.empty(len(by), np.int64)  # LF of a run's first rank
        self.maps[by] = np.cumsum(size) - size
        self.ends = np.stack([self.maps + last - self.first, self.maps])  # LF of its last and first rank
        self.by, self.sorted = by, self.symbol[by].astype(np.int64) * (n + 1) + self.first[by]
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.symbols, np.zeros(length, np.uint16)]), length)
        self.order = order

    def first_places(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, least place) of every string of `length` symbols inside one text, by place in the joined texts."""
        end = np.repeat(np.append(self.start[1:], len(self.symbols)), np.diff(np.append(self.start, len(self.symbols)))) - 1
        order = self.order[self.order + self.length <= end[self.order]]
        same = np.zeros(len(order), bool)
        for i in range(1, len(order), 1 << 16):
            part = order[i - 1 : i + (1 << 16)]
            same[i : i + len(part) - 1] = (self.windows[part[1:]] == self.windows[part[:-1]]).all(axis=1)
        group = np.flatnonzero(~same)
        least = np.minimum.reduceat(order, group) if len(order) else order
        return order, np.repeat(least, np.diff(np.append(group, len(order))))

    def forget_order(self) -> None:
        """From here on only runs, samples and texts are kept."""
        self.order = None

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b share, up to `most`; few are read where `most` is small."""
        out = np.empty(len(a), np.int64)
        for lanes, wide in ((np.flatnonzero(most <= NEAR), min(NEAR, self.length)), (np.flatnonzero(most > NEAR), self.length)):
            view = self.windows[:, :wide]
            for i in range(0, len(lanes), 1 << 14):
                some = lanes[i : i + (1 << 14)]
                differs = view[a[some]] != view[b[some]]
                at = differs.argmax(axis=1)
                out[some] = np.where(differs[np.arange(len(at)), at], at, wide)
        return np.minimum(out, most)

    def long_matches(self, texts: list[bytes]) -> np.ndarray:
        """At which places of joined(texts) a match of `length` symbols with an indexed text starts.

        All texts advance together; one that can't reach such a match any more is given up.
        """
        symbols, start = joined(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        left = size.copy()  # symbols of each text that are still to come
        rank, place, match = np.zeros(len(texts), np.int64), np.full(len(texts), self.place[1, 0], np.int64), np.zeros(len(texts), np.int64)
        found = np.zeros(len(symbols), bool)
        scale = len(self.symbols) + 1
        while True:
            live = (left > 0) & (match + left >= self.length)
            if not live.all():
                start, left, rank, place, match = start[live], left[live], rank[live], place[live], match[live]
            if not len(left):
                return found
            for _ in range(min(STEPS, int(left.min()))):
                left -= 1
                at = start + left
                c = symbols[at]
                run = np.searchsorted(self.first, rank, "right") - 1
                rank += self.maps[run] - self.first[run]
                miss = np.flatnonzero(self.symbol[run] != c)
                if len(miss):
                    was = rank[miss] - self.maps[run[miss]] + self.first[run[miss]]
                    below = np.searchsorted(self.sorted, c[miss].astype(np.int64) * scale + was)  # the first run of the symbol from here on
                    best, to_rank, to_place = np.full(len(miss), -1, np.int64), np.zeros(len(miss), np.int64), np.full(len(miss), self.place[1, 0] + 1)
                    for side, spot in ((0, below - 1), (1, below)):
                        ok = (spot >= 0) & (spot < len(self.sorted))
                        ok[ok] = self.symbol[self.by[spot[ok]]] == c[miss[ok]]
                        near = self.by[spot[ok]]
                        shared = self._common(place[miss[ok]], self.place[side, near], match[miss[ok]])
                        better = shared > best[ok]
                        lane = np.flatnonzero(ok)[better]
                        best[lane], to_rank[lane], to_place[lane] = shared[better], self.ends[side, near[better]], self.place[side, near[better]]
                    rank[miss], match[miss], place[miss] = to_rank, best, to_place
                place -= 1
                match += 1
                found[at] = match >= self.length
