"""Numbers for distinct runs of code points (words, units of a lattice), by hash tables in arrays: no string for any of them."""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... first + size - 1 of each, one after another."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


#: Characters in a stretch of a long text, and the mark that piece models take for a blank.
STRETCH, MARK = 1 << 19, "▁"


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """The text in parts of about `size` characters, cut before a blank between two characters other than white space."""
    out, at = [], 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut - 1] == MARK or text[cut + 1].isspace() or text[cut + 1] == MARK):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Grown:
    """An array that grows by doubling; its first n values count."""

    def __init__(self, kind, size: int = 1 << 12):
        self.of, self.n = np.zeros(size, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.of):
            self.of = np.concatenate([self.of, np.zeros(max(len(self.of), len(values)), self.of.dtype)])
        self.of[self.n : self.n + len(values)] = values
        self.n += len(values)


class Runs:
    """Distinct runs, numbered as they come. Equal hashes are told from equal runs by their code points."""

    def __init__(self):
        self.salt = 0
        self.forget()

    def __len__(self) -> int:
        return self.hash.n

    def forget(self) -> None:
        self.hash, self.size, self.spot, self.chars = Grown(np.uint64), Grown(np.int64), Grown(np.int64), Grown(np.uint32)
        self._table(1 << 14)

    def cut(self, n: int) -> None:
        """Forgets all but the first n runs."""
        self.chars.n = int(self.spot.of[n]) if n < len(self) else self.chars.n
        self.hash.n = self.size.n = self.spot.n = n
        self._table(len(self.slots))

    def _table(self, size: int) -> None:
        while size < 3 * len(self):
            size *= 2
        self.slots, self.shift = np.full(size, -1, np.int32), np.uint64(64 - (size - 1).bit_length())
        self._enter(np.arange(len(self), dtype=np.int32))

    def _enter(self, runs: np.ndarray) -> None:
        at = (self.hash.of[runs] >> self.shift).astype(np.int64)
        while len(runs):
            free = self.slots[at] < 0
            self.slots[at[free]] = runs[free]
            open_ = self.slots[at] != runs
            runs, at = runs[open_], (at[open_] + 1) & (len(self.slots) - 1)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> self.shift).astype(np.int64)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.hash.of[out] != hashes))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            out[open_] = now = self.slots[at[open_]]
            open_ = open_[(now >= 0) & (self.hash.of[now] != hashes[open_])]
        return out

    def _hashes(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of runs that follow one another without a gap."""
        offset = (np.arange(len(points)) - np.repeat(start, size)).astype(np.uint64)
        return np.add.reduceat(mix((offset << np.uint64(21)) + points + np.uint64((self.salt & 255) << 56)), start)

    def number(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these runs, which make up points without a gap, and which of the runs were the first of a new number."""
        before = len(self)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            hashes = self._hashes(points, start, size)
            found, fresh = self._find(hashes), np.zeros(0, np.int64)
            missing = np.flatnonzero(found < 0)
            if len(missing):
                _, at, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
                fresh = missing[at]
                found[missing] = before + back
                self.hash.add(hashes[fresh])
                self.spot.add(self.chars.n + np.cumsum(size[fresh]) - size[fresh])
                self.size.add(size[fresh])
                self.chars.add(points[ranges(start[fresh], size[fresh])])
                if 3 * len(self) > len(self.slots):
                    self._table(len(self.slots))
                else:
                    self._enter(np.arange(before, len(self), dtype=np.int32))
            if (self.size.of[found] == size).all() and (self.chars.of[ranges(self.spot.of[found], size)] == points).all():
                return found.astype(np.int64), fresh
            # two runs of one hash: other hashes tell them apart
            self.cut(before)
            self.salt += 1
            if before:
                n = self.chars.n
                self.hash.of[:before] = self._hashes(self.chars.of[:n], self.spot.of[:before], self.size.of[:before])
                self._table(len(self.slots))
