"""Vectorised hashes of words, word windows and byte windows, for Python workers. All are the same on every machine and run."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit symbol for each byte, and the bytes that part words.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@lru_cache(maxsize=2)
def _powers(base: int, log2: int) -> tuple[np.ndarray, np.ndarray]:
    one = lambda r: np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full((1 << log2) - 1, r, dtype=np.uint64)]))
    return one(base), one(pow(base, -1, 1 << 64))


class Rolling:
    """Hashes of any run of symbols from prefix sums of a polynomial, modulo 2^64."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        n = len(symbols) + 1
        up, self.down = _powers(_BASES[which], max(20, (n - 1).bit_length()))
        if which:
            symbols = mix(symbols)
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(symbols * up[: n - 1], out=self.sums[1:])

    def runs(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[: len(self.sums)][start])

    def every(self, width: int, mixed: bool = True) -> np.ndarray:
        """Of every run of so many symbols. Unmixed ones are as good in their high bits, and for telling runs apart."""
        n = len(self.sums) - width
        if n <= 0:
            return self.sums[:0]
        out = self.sums[width:] - self.sums[:-width]
        out *= self.down[:n]
        return mix(out) if mixed else out


def word_hashes(texts: list[str] | list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts end to end, and how many each text has: bytes at a time, no word is made a Python object."""
    raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b" ".join([*raw, b""])
    data = np.frombuffer(joined.lower() if fold else joined, dtype=np.uint8)
    gap = np.ones(len(data) + 1, dtype=bool)
    gap[1:] = SPACES[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[0::2], edge[1::2]
    begins = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1)
    sizes = np.diff(np.searchsorted(start, begins), prepend=0)
    return mix(Rolling(BYTES[data]).runs(start, end) ^ (end - start).astype(np.uint64)), sizes


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of many texts of bytes, end to end, begin and end, and how many each text has. offsets: where each text begins, and the last ends."""
    inside = ~SPACES[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # A text's first word does not go on from the text before.
    at = offsets[(offsets > 0) & (offsets < len(data))]
    first[at], last[at - 1] = inside[at], inside[at - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.diff(np.searchsorted(start, offsets))


def spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that word_bounds() found with one space behind each, and where each begins."""
    ends = np.cumsum(end - start + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
    word = np.ones(len(out), dtype=bool)
    word[ends - 1] = False
    out[word] = data[~SPACES[data]]
    return out, ends - (end - start + 1)


def hashes_between(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes word_hashes() has for these words."""
    return mix(Rolling(BYTES[data]).runs(start, end) ^ (end - start).astype(np.uint64))


def split_words(text: str, fold: bool = False) -> list[bytes]:
    """Runs of bytes other than the six ASCII white-space characters; fold lower-cases A-Z only."""
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if fold else raw).split()


def window_hashes(symbols: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of `width` symbols (fewer than width symbols: none)."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    own, factor = mix(symbols + np.uint64(seed)), np.uint64(2 * seed + 0x9E3779B97F4A7C15)
    total = own[:n].copy()
    for i in range(1, width):
        total *= factor
        total += own[i : i + n]
    return mix(total)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    reach, out = 1, x
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[:n], out[rest : rest + n]) if rest else out[:n]


def shingle_sets(texts: list[str], width: int, fold: bool = True) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; with fewer words, of the whole sequence; without words, none."""
    words, sizes = word_hashes(texts, fold)
    every = window_hashes(words, width, width)
    out, at = [], 0
    for n in sizes.tolist():
        own = every[at : at + n - width + 1] if n >= width else window_hashes(words[at : at + n], n, n) if n else words[:0]
        out.append(np.unique(own))
        at += n
    return out


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed 64-bit numbers."""
    raw = xxhash.xxh3_128_digest(values.tobytes())
    a, b = np.frombuffer(raw, dtype=np.int64)
    return int(a), int(b)
