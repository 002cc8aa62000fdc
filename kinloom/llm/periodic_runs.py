"""Operator 11: runs (maximal repetitions) of words by Lyndon roots.

A run is a maximal stretch of words of least period q that holds two periods or more.  By the runs theorem every run has a Lyndon
root: a stretch of q words that is the longest Lyndon word at its start, under an order of the words or under the reversed order.
Phase one of Baier's suffix sorter, which groups suffixes by their longest Lyndon prefix, gives these stretches (the Lyndon array)
for either order; each is extended to both sides by longest common extensions, and those that reach two periods are the runs.

Only stretches of words that can hold a run are grouped: every word of a run of 12 words or more lies in a window of six words that
stands in its stretch twice, so words outside such windows, found by hashes for all texts of a batch at once, end stretches.
Texts never leave their rows: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, packed, unpacked
from .shingles import mix

#: Words of the shortest run that counts.
MIN_LENGTH = 12
#: Words that are searched together; texts stay whole, so a longer one is searched alone.
BATCH_WORDS = 1 << 19

#: Runs of one text: rows of (start, length, period), sorted by start, then period.
Runs = list[tuple[int, int, int]]


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at every place of a sequence of ranks, by grouping (phase one of Baier's suffix sorter).

    Suffixes stand in groups, at first by their first symbol.  A group is named by the number of suffixes in lower groups, so that
    names compare like groups.  Groups are taken from the highest down.  From each suffix of the taken group the nearest one before
    it that stands in a lower group is found over the links of suffixes taken earlier.  One that is found k times goes on with
    k copies of the taken group's word: it moves to a new group right above its own, with a word longer by that, and those with
    most copies stand highest.  When a group is taken, its word is the longest Lyndon word at its suffixes.
    """
    n = len(ranks)
    length, back, group = [0] * n, [-1] * n, [0] * n
    held: dict[int, list[int]] = {}  # may name suffixes that have moved on
    size: dict[int, int] = {}
    word: dict[int, int] = {}
    below: dict[int, int] = {}  # the group that ends where its name plus its size says
    order = sorted(range(n), key=ranks.__getitem__)
    first = 0
    for k in range(1, n + 1):
        if k == n or ranks[order[k]] != ranks[order[first]]:
            held[first], size[first], word[first], below[k] = order[first:k], k - first, 1, first
            for i in held[first]:
                group[i] = first
            first = k
    top = n
    while top:
        g = below.pop(top)
        m = word.pop(g)
        top = g
        taken = [i for i in held.pop(g) if group[i] == g]
        if len(taken) > 1:
            taken.sort()
        found: dict[int, int] = {}
        for s in taken:
            length[s] = m
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = back[p]
            back[s] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        if not found:
            continue
        times: dict[int, dict[int, list[int]]] = {}
        for p, k in found.items():
            times.setdefault(k, {}).setdefault(group[p], []).append(p)
        for k in sorted(times, reverse=True):
            for old, moved in times[k].items():
                if len(moved) == size[old]:
                    word[old] += k * m
                    continue
                end = old + size[old]
                new = end - len(moved)
                size[old] -= len(moved)
                held[new], size[new], word[new] = moved, len(moved), word[old] + k * m
                below[end], below[new] = new, old
                for p in moved:
                    group[p] = new
    return length


def names_by_length(symbols: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each power of two up to longest: a number per place, equal for equal stretches of so many symbols, exactly."""
    out, k = [symbols], 1
    while 2 * k <= longest:
        last = out[-1]
        follow = np.full(len(last), -1, np.int64)
        follow[:-k] = last[k:]
        out.append(np.unique(last * (len(last) + 2) + follow + 1, return_inverse=True)[1])
        k *= 2
    return out


def common_extension(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols agree from places a and b on, or before them; a symbol that stands once ends every match."""
    got = np.zeros(len(a), np.int64)
    size = len(names[0])
    for k in range(len(names) - 1, -1, -1):
        step = 1 << k
        x, y = (a - got - step, b - got - step) if back else (a + got, b + got)
        fits = (x >= 0) & (np.maximum(x, y) + step <= size)
        same = fits.copy()
        same[fits] = names[k][x[fits]] == names[k][y[fits]]
        # a longer match than the longest names: the same step again
        while k == len(names) - 1 and same.any():
            got[same] += step
            x, y = (a - got - step, b - got - step) if back else (a + got, b + got)
            fits = same & (x >= 0) & (np.maximum(x, y) + step <= size)
            same = fits.copy()
            same[fits] = names[k][x[fits]] == names[k][y[fits]]
        got[same] += step
    return got


def stretches(hashes: np.ndarray, owner: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of words, all of one owner, that can hold a run of so many words.

    A word stays while a window of words around it stands twice in its stretch; stretches shrink until nothing changes.
    """
    window = (min_length + 1) // 2
    kept, owner = np.arange(len(hashes)), owner.astype(np.uint64)
    while True:
        h = hashes[kept]
        if len(h) < min_length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = h[: len(h) - window + 1].copy()
        for k in range(1, window):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - window + 1 + k]
        whole = owner[: len(key)] == owner[window - 1 :]
        key = mix(key ^ mix(owner[: len(key)]))
        order = np.argsort(key)
        s = key[order]
        twice = np.zeros(len(key), bool)
        equal = s[1:] == s[:-1]
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        edge = np.zeros(len(h) + 1, np.int64)
        at = np.flatnonzero(twice & whole)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        covered = np.cumsum(edge[:-1]) > 0
        cut = np.flatnonzero(covered & ~(np.concatenate([[False], covered[:-1]]) & np.concatenate([[False], owner[1:] == owner[:-1]])))
        stop = np.flatnonzero(covered & ~(np.concatenate([covered[1:], [False]]) & np.concatenate([owner[1:] == owner[:-1], [False]]))) + 1
        long = stop - cut >= min_length
        cut, stop = cut[long], stop[long]
        sizes = stop - cut
        if sizes.sum() == len(h):
            starts = kept[cut]
            return starts, starts + sizes
        inside = np.repeat(cut - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        kept, owner = kept[inside], np.repeat(np.arange(len(cut), dtype=np.uint64), sizes)


def runs_of(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[Runs]:
    """The runs of min_length words or more of each text, given as its words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    head = np.cumsum(sizes) - sizes
    hashes = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, int(sizes.sum())).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts, ends = stretches(hashes, owner, min_length)
    out: list[Runs] = [[] for _ in texts]
    if len(starts) == 0:
        return out
    # stretches side by side, with a symbol that stands once around each
    known: dict[bytes, int] = {}
    symbols, roots, text_of_stretch = [np.array([0])], [], owner[starts]
    for s, e, t in zip(starts.tolist(), ends.tolist(), text_of_stretch.tolist(), strict=True):
        held = [known.setdefault(w, len(known)) for w in texts[t][s - head[t] : e - head[t]]]
        roots.append((np.array(lyndon_array(held)), np.array(lyndon_array([-x for x in held]))))
        symbols += [np.array(held), np.array([0])]
    single = np.cumsum([0, *(ends - starts + 1).tolist()])
    all_ = np.concatenate(symbols)
    all_[single] = len(known) + np.arange(len(single))
    all_ = np.unique(all_, return_inverse=True)[1]
    first = single[:-1] + 1
    at = np.concatenate([np.repeat(first, ends - starts) + np.arange((ends - starts).sum()) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)] * 2)
    period = np.concatenate([r[0] for r in roots] + [r[1] for r in roots])
    names = names_by_length(all_, int((ends - starts).max()))
    left = common_extension(names, at, at + period, back=True)
    right = common_extension(names, at, at + period)
    length = left + period + right
    good = length >= np.maximum(min_length, 2 * period)
    found = np.unique(np.stack([(at - left)[good], period[good], length[good]]), axis=1)
    stretch = np.searchsorted(first, found[0], "right") - 1
    begin = found[0] - first[stretch] + (starts - head[text_of_stretch])[stretch]
    for t, b, q, n in zip(text_of_stretch[stretch].tolist(), begin.tolist(), found[1].tolist(), found[2].tolist(), strict=True):
        out[t].append((b, n, q))
    return out


def kept_words(words: list[bytes], runs: Runs) -> list[bytes]:
    """The words that no run holds beyond its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if g == 0]


def _searched(batch: pa.RecordBatch, min_length: int, rewrite: Callable | None = None) -> Iterator[tuple[int, list[list[bytes]], list[Runs]]]:
    """(number of the first row, words, runs) of neighbouring rows of a batch with columns id and text (binary)."""
    start, size, held = 0, 0, []
    for i in range(batch.num_rows):
        words = (batch.column("text")[i].as_py() or b"").split()
        held.append(rewrite(batch.column("id")[i].as_py(), words) if rewrite else words)
        size += len(held[-1])
        if size >= BATCH_WORDS or i + 1 == batch.num_rows:
            yield start, held, runs_of(held, min_length)
            start, size, held = i + 1, 0, []


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, start, length, period) of all runs of min_length words or more, one row each.

    Words are numbered from 0 in each text.  Every row is a text of its own, so rows that are equal tell the same runs twice.  Null,
    empty and blank texts have none; ids may be null; the table may be empty.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def search(batches):
        for b in batches:
            for first, _, found in _searched(b, min_length):
                rows = [(first + k, *r) for k, runs in enumerate(found) for r in runs]
                at, *numbers = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *[pa.array(v, pa.int64()) for v in numbers]], ["doc_id", "start", "length", "period"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(search, f"doc_id {kind}, start long, length long, period long")


def collapse_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """docs with every run cut down to its first period; words of changed texts are joined by one space, others stay as they are.

    The columns stay as they are, whatever their names; null texts stay null.
    """

    @F.pandas_udf("string")
    def cut(texts):
        out = list(texts)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int64()), pa.array([None if t is None else t.encode() for t in out], pa.binary())], ["id", "text"])
        for first, words, found in _searched(batch, min_length):
            for k, runs in enumerate(found):
                if runs:
                    out[first + k] = b" ".join(kept_words(words[k], runs)).decode()
        return texts.__class__(out, dtype="object")

    d = packed(docs, text=F.col(text_col).cast("string"))
    return unpacked(d, docs.columns, **{text_col: cut(F.col("text"))}).select(*[f"`{c}`" for c in docs.columns])


def planted_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query's contract: a tenth of the ids have a periodic tail."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return (words[:a] + tail * ((n - a) // len(tail) + 1))[:n]


def op11_baier_runs(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ("n_runs", "start", "length", "period", "exponent_milli")

    def digest(batches):
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for b in batches:
            rows = []
            for _, words, found in _searched(b, MIN_LENGTH, planted_tail):
                for w, runs in zip(words, found, strict=True):
                    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                    rows.append((len(runs), start, length, period, None if period is None else 1000 * length // period, sha(told), sha(b" ".join(kept_words(w, runs)))))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(v, k) for v, k in zip(columns, kinds, strict=True)]], ["doc_id", *numbers, "runs_sha256", "collapsed_sha256"])

    d = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    return d.mapInArrow(digest, f"doc_id {kind}, {', '.join(f'{n} long' for n in numbers)}, runs_sha256 string, collapsed_sha256 string")
