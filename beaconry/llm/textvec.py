"""Word and n-gram hashes of whole texts, a few numpy passes over the bytes of many texts at once.

A word is a run of ASCII letters, digits and non-ASCII characters. Hashes are
64-bit, depend on nothing but the word, and are equal on every machine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SLICE = 1 << 17
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _P)
    word = np.zeros(256, bool)
    word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return values, word


_power: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = SLICE + 1
    while size < n:
        size *= 2
    if size not in _power:
        up = np.full(size, _P)
        down = np.full(size, _PINV)
        up[0] = down[0] = 1
        _power.clear()
        _power[size] = np.cumprod(up), np.cumprod(down)
    return _power[size]


def _slices(data: np.ndarray, word: np.ndarray):
    """Borders of pieces of about SLICE bytes that cut no word."""
    a = 0
    while a < len(data):
        b = min(len(data), a + SLICE)
        while b < len(data) and word[data[b]] and word[data[b - 1]]:
            b += 1
        yield a, b
        a = b


class Words:
    """hash, start, end (bytes) of every word of some texts; first[i]:first[i+1] are those of text i.

    word: for each byte, whether it is part of a word (not so for 0, which parts the texts).
    """

    def __init__(self, texts: list[str], word: np.ndarray | None = None):
        values, usual = _tables()
        word = usual if word is None else word
        parts = [t.encode("utf-8", "replace") for t in texts]
        self.at = np.cumsum([0] + [len(p) + 1 for p in parts])
        self.data = data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        hashes, starts, ends = [], [], []
        for a, b in _slices(data, word):
            piece = data[a:b]
            is_word = np.zeros(b - a + 2, np.int8)
            is_word[1:-1] = word[piece]
            edge = np.diff(is_word)
            s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            up, down = _powers(b - a)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(values[piece] * up[: b - a], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * down[s]))
            starts.append(s + a)
            ends.append(e + a)
        none = np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.start = np.concatenate(starts) if starts else none
        self.end = np.concatenate(ends) if ends else none
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))


def shingles(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, 64-bit hash) of every run of `size` words, lower-cased; a text with fewer words is one shingle, one without words has none."""
    w = Words([t.lower() for t in texts])
    h, n = w.hash, len(w.hash)
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    docs, out = [], []
    if n >= size:
        total = h[: n - size + 1].copy()
        for k in range(1, size):
            total = total * _P + h[k : n - size + 1 + k]
        ok = w.doc[: n - size + 1] == w.doc[size - 1 :]
        docs.append(w.doc[: n - size + 1][ok])
        out.append(mix(total[ok]))
    for d in short:
        x = np.uint64(size)
        with np.errstate(over="ignore"):
            for v in h[w.first[d] : w.first[d + 1]]:
                x = x * _P + v
        docs.append(np.array([d]))
        out.append(mix(np.array([x], np.uint64)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(out)
