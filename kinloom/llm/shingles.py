"""Word and shingle hashes of whole texts with numpy, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_POWER = np.ones(64, np.uint64)


def _powers(n: int) -> np.ndarray:
    """Odd multipliers for the positions of a word."""
    global _POWER
    if n > len(_POWER):
        n = max(n, 2 * len(_POWER))
    if n > len(_POWER) or _POWER[1] == 1:
        _POWER = mix(np.arange(1, max(n, 64) + 1, dtype=np.uint64) * _M2) | np.uint64(1)
    return _POWER


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per white-space separated word."""
    return byte_word_hashes((text or "").encode("utf-8", "replace"))


def byte_word_hashes(data: bytes) -> np.ndarray:
    """word_hashes of UTF-8 bytes; data of any length is read a chunk at a time."""
    out = []
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        raw = np.frombuffer(data, np.uint8, end - at, at)
        if end < len(data):  # stop behind the last white space, or go on to the next one
            gaps = np.flatnonzero(_SPACE[raw])
            if len(gaps):
                raw = raw[: gaps[-1] + 1]
            else:
                more = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, len(data) - at, at)])
                raw = np.frombuffer(data, np.uint8, int(more[0]) if len(more) else len(data) - at, at)
        at += len(raw)
        solid = ~_SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if len(starts) == 0:
            continue
        lengths = ends - starts
        where = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        terms = _BYTE[raw[solid]] * _powers(int(lengths.max()))[where]
        out.append(mix(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of size words, in order; one of all words where there are fewer; none without words."""
    n = len(words)
    if n == 0:
        return words
    run = min(size, n)
    out = words[: n - run + 1].copy()
    for k in range(1, run):
        out = mix(out + _STEP) ^ words[k : n - run + 1 + k]
    return mix(out + np.uint64(run))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), size))


def set_key(tokens: np.ndarray) -> str:
    """128 bits that name a set: equal sets have equal keys."""
    if len(tokens) == 0:
        return ""
    a, b = mix(tokens + _STEP), mix(tokens ^ _M1)
    return f"{int(np.add.reduce(a)):016x}{int(np.bitwise_xor.reduce(b) + np.uint64(len(tokens))) & (2**64 - 1):016x}"


SKETCH = 128


def sketch(tokens: np.ndarray) -> bytes:
    """One-permutation minhash of sorted tokens: 8 bits of the least token in each of 128 ranges; 0 stands for none."""
    bins = (tokens >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(SKETCH, np.uint8)
    out[bins[first]] = (tokens[first] % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def stream_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by keys, one at a time, also where they cross batches."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if len(batch) == 0:
            continue
        columns = [batch[k].to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        at = 0
        for end in [*change, len(batch)]:
            part = batch.iloc[at:end]
            key = tuple(c[at] for c in columns)
            if held and key != last:
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(part)
            last, at = key, end
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))])
