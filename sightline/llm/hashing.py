"""Words, word hashes and hashes of word runs, one text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MULTIPLIER = 0x9E3779B97F4A7C15  # fixed value: an odd 64-bit constant
U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n successive words, by doubling."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    out, have, power, step = None, 0, hashes, 1
    with np.errstate(over="ignore"):
        while step <= n:
            if n & step:
                if out is None:
                    out, have = power, step
                else:
                    left, right = power, out[step:]
                    m = min(len(left), len(right))
                    out, have = left[:m] * U(pow(MULTIPLIER, have, 1 << 64)) + right[:m], have + step
            if 2 * step <= n:
                power = power[:-step] * U(pow(MULTIPLIER, step, 1 << 64)) + power[step:]
            step *= 2
        return mixed(out[: len(hashes) - n + 1])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _table(fold: bool) -> np.ndarray:
    """A random-looking 64-bit value for every byte; with fold, A-Z have the values of a-z."""
    with np.errstate(over="ignore"):
        out = mixed(np.arange(1, 257, dtype=np.uint64) * U(MULTIPLIER))
    if fold:
        out[65:91] = out[97:123]
    return out


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def pieces(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """raw in pieces of about size bytes that end at white space, so that no word is cut; a longer word is a piece by itself."""
    a = 0
    while len(raw) - a > size:
        b = a + size
        while (at := _last_space(raw[a:b])) < 0 and b < len(raw):  # no space yet: a word longer than size
            b = min(len(raw), b + size)
        b = a + at + 1 if at >= 0 else b
        yield raw[a:b]
        a = b
    yield raw[a:]


def _last_space(raw: bytes) -> int:
    return max(raw.rfind(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))


class TextHasher:
    """Hashes of all words of many texts at once, straight from a column's bytes.

    A word's hash is a polynomial over its UTF-8 bytes, mixed at the end. Texts are taken in groups of about
    group bytes and longer ones in pieces of that size, cut between words, so memory doesn't follow the batch or the text, but for
    8 bytes a word.
    """

    BLOCK = 1 << 12  # bytes of a word for which there is a table of powers; longer words are put together from such blocks

    def __init__(self, fold: bool = False, group: int = 1 << 20):
        self.values, self.group = _table(fold), group
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.BLOCK - 1, MULTIPLIER, dtype=np.uint64)]))

    def _weights(self, place: np.ndarray) -> np.ndarray:
        """MULTIPLIER to the power of each place in its word."""
        if not len(place) or place.max() < self.BLOCK:
            return self.powers[place]
        blocks = [pow(MULTIPLIER, self.BLOCK * k, 1 << 64) for k in range(int(place.max()) // self.BLOCK + 1)]
        return self.powers[place % self.BLOCK] * np.array(blocks, dtype=np.uint64)[place // self.BLOCK]

    def words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the words of successive texts, how many each text has); ends: where each text ends in data."""
        inside = ~IS_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        bounds = np.concatenate([[0], ends[:-1]])
        bounds = bounds[bounds < len(data)]
        first[bounds] = inside[bounds]
        starts = np.flatnonzero(first)
        n = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
        if not len(starts):
            return np.empty(0, dtype=np.uint64), n
        at = np.flatnonzero(inside)
        number = np.cumsum(first)[at] - 1
        place = at - starts[number]
        with np.errstate(over="ignore"):
            return mixed(np.add.reduceat(self.values[data[at]] * self._weights(place), np.flatnonzero(first[at]))), n

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """words() of one text, piece by piece."""
        found, a = [], 0
        while a < len(data):
            b = min(len(data), a + self.group)
            while b < len(data) and not len(space := np.flatnonzero(IS_SPACE[data[a:b]])):
                b = min(len(data), b + self.group)
            b = a + int(space[-1]) + 1 if b < len(data) else b
            found.append(self.words(data[a:b], np.array([b - a]))[0])
            a = b
        every = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
        return every, np.array([len(every)])

    def __call__(self, column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, word hashes, words per text) of groups of texts; a null text has no words."""
        column = column.cast(pa.large_binary()) if column.null_count == 0 else column.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + self.group, "right")) - 1)
            b = min(b, len(column))
            if b == a + 1 and offsets[b] - offsets[a] > self.group:
                yield a, *self._long(data[offsets[a] : offsets[b]])
            else:
                yield a, *self.words(data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a])
            a = b


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
