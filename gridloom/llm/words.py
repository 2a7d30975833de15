"""Rolling 64-bit hashes over the words of a document, on numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class WordHashes:
    """Hashes of words, with those of the last ``most`` distinct words kept."""

    def __init__(self, seed: int = 0, most: int = 150_000):
        self.seed, self.most, self.known = seed, most, {}

    def __call__(self, words: list) -> np.ndarray:
        known, seed = self.known, self.seed
        if len(known) > self.most:
            known.clear()
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w, seed)
            return np.array([known[w] for w in words], dtype=np.uint64)


#: Whether ``bytes.split()`` splits at a byte, the least 0 to 8 bytes of a number, and the length from which words are hashed one by one.
_WHITE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8))
_LEAST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_LONG = 256


def word_hashes(texts: list[bytes], *seeds: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of words of each text, and for each seed the hashes of all words, text after text.

    The texts lie side by side in one buffer; all words take their first eight bytes at
    once, then those that are longer take their next ones. No word is an object.
    """
    data = b" ".join((b"", *texts, b" " * 8))
    raw = np.frombuffer(data, dtype=np.uint8)
    white = _WHITE[raw]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    first, size = edges[::2], edges[1::2] - edges[::2]
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(first, begins))
    eight = np.ndarray(len(raw) - 7, dtype="<u8", buffer=data, strides=(1,))  # the eight bytes from each place on
    out = [mix(size.astype(np.uint64) + np.uint64((s + 1) * BASE & _MASK)) for s in seeds]
    rest, done = np.flatnonzero(size < _LONG), 0
    while len(rest):
        part = eight[first[rest] + done] & _LEAST[np.minimum(size[rest] - done, 8)]
        for h in out:
            h[rest] = mix(h[rest] * np.uint64(BASE) + part)
        done += 8
        rest = rest[size[rest] > done]
    for i in np.flatnonzero(size >= _LONG).tolist():
        for s, h in zip(seeds, out):
            h[i] = xxhash.xxh64_intdigest(data[first[i] : first[i] + size[i]], s)
    return counts, out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words, in log(size) passes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done = None, 0
    power, width = h, 1
    while True:
        if size & width:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(BASE, width, 1 << 64)) + part
            done += width
        if width * 2 > size:
            return mix(out)
        power = power[: len(power) - width] * np.uint64(pow(BASE, width, 1 << 64)) + power[width:]
        width *= 2


def window_argmin(s: np.ndarray, size: int) -> np.ndarray:
    """Of every ``size`` consecutive values, the place of the leftmost least one."""
    at = np.arange(len(s))
    value, width = s, 1
    while width < size:
        step = min(width, size - width)
        a, b = value[:-step], value[step:]
        right = b < a
        value = np.where(right, b, a)
        at = np.where(right, at[step:], at[:-step])
        width += step
    return at
