"""Operator 5: substring dedup by MinHash banding of paragraphs.

Texts are cut into short pieces at words whose hash is the least among its neighbours, so that a passage is cut alike
wherever it stands, in the middle of a line too.  Paragraphs are these pieces, the lines and blocks of lines between blank lines,
and windows of neighbouring pieces, which stay similar where a changed word breaks a piece.  Paragraphs meet in bands of minhashes of their five-word shingles (bands
tuned to a target recall), distinct paragraphs of a band are verified by exact Jaccard similarity, and components of verified
paragraphs of a kind are the units of removal: all occurrences but the first go, where enough neighbouring words repeat.

A first pass over the texts counts bands; a fixed-size bit filter of the bands that occur twice lets the second pass
ship only paragraphs that can have a partner.  False positives of the filter cost work and change nothing.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .common import FILTER_BITS, FILTER_CHUNK, bit_filter, byte_batches, connected_components, drop_shuffles, in_filter, load, materialize, maybe_among, packed, release, scratch, small_batches, unpacked
from .shingles import byte_word_hashes, mix, shingle_hashes

THRESHOLD = 0.8
#: A cut stands before a word whose hash is less than those of so many words on either side; paragraphs take 11 words on average.
REACH = 5
LONGEST = 64
RECALL = 0.95
#: Repeating neighbours must hold this many words: a passage of 50 words keeps that many when its ends belong to other paragraphs.
MIN_RUN = 24
#: Words of a window of neighbouring pieces; with REACH more on either side, one changed word leaves such windows similar enough.
WIDE = 40


def bands_for(recall: float = RECALL, threshold: float = THRESHOLD, rows: int = 1) -> int:
    """Bands of so many rows that a pair at the threshold shares one with the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class Paragraphs(NamedTuple):
    """Paragraphs of several texts, one array entry each; level 0 are pieces, 1 lines and blocks of lines, 2 windows of pieces."""

    text: np.ndarray  # number of the text
    level: np.ndarray
    at: np.ndarray  # first word in the text
    words: np.ndarray
    keys: np.ndarray  # alike for paragraphs of the same shingles
    hashes: np.ndarray  # paragraphs x bands
    bits: np.ndarray | None  # a set bit for every shingle, at one of 64 places; where they are asked for
    first: np.ndarray  # place of the first shingle in every, and behind the last one
    stop: np.ndarray
    every: np.ndarray


def line_spans(counts: list[int]) -> list[tuple[int, int]]:
    """(start, end), in words, of the lines and of the blocks of lines between blank lines that hold MIN_RUN words, from the
    numbers of words of the lines of a text."""
    out, at, block, lines = [], 0, 0, 0
    for n in [*counts, 0]:
        if n >= MIN_RUN:
            out.append((at, at + n))
        if n == 0:
            if lines > 1 and at - block >= MIN_RUN:
                out.append((block, at))
            block, lines = at, 0
        else:
            lines += 1
        at += n
    return out


def pieces_of(words: np.ndarray, real: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces of texts that stand at head..tail in words, with REACH places or more between them.

    A cut stands at the first word and before local minima of the word hashes; no piece is longer than LONGEST words.
    """
    h = np.full(len(words), np.iinfo(np.uint64).max)
    h[real] = mix(words[real] ^ np.uint64(0x5851F42D4C957F2D))
    cut = np.zeros(len(words), bool)
    cut[real] = True
    for k in range(1, REACH + 1):
        cut[k:] &= h[k:] < h[:-k]
        cut[:-k] &= h[:-k] <= h[k:]
    for k in range(REACH):
        cut[head + k] = k == 0
    starts = np.flatnonzero(cut)
    end_of = lambda s: np.minimum(np.append(s[1:], len(words)), tail[np.searchsorted(head, s, "right") - 1])
    parts = -((starts - end_of(starts)) // LONGEST)
    starts = np.repeat(starts, parts) + LONGEST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return starts, end_of(starts)


def windows_of(starts: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the least runs of neighbouring pieces of a text that hold WIDE words; no run holds another one."""
    edges = np.sort(np.concatenate([starts, tail]))
    last = np.searchsorted(edges, starts + WIDE)
    ends = np.append(edges, np.iinfo(np.int64).max)[last]
    fits = np.flatnonzero(ends <= tail[np.searchsorted(head, starts, "right") - 1])
    fits = fits[np.append(last[fits][1:], len(edges)) > last[fits]]  # of runs with the same end the shortest
    return starts[fits], ends[fits]


def paragraphs(texts: list[str | None], bands: int, with_bits: bool = False) -> Paragraphs | None:
    """All paragraphs of the texts, or None where they have no words.

    The words that decide where a cut stands are alike in both copies, so a window is compared with REACH more words on either
    side; its own first and last shingles must be shared, so that it does not reach beyond what is alike.  Bands of windows
    hold the first or the last of them besides a minhash: neighbouring windows of a text are much alike, but no repeats.
    """
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    counts = [[len(line.split()) for line in d.split(b"\n")] for d in data]
    n = np.array([sum(c) for c in counts], np.int64)
    held = np.flatnonzero(n)
    if len(held) == 0:
        return None
    n = n[held]
    head = np.cumsum(n + REACH) - n - REACH  # REACH empty places behind each text
    tail = head + n
    real = np.arange(n.sum()) + REACH * np.repeat(np.arange(len(n)), n)
    words = np.zeros(tail[-1] + REACH, np.uint64)
    words[real] = byte_word_hashes(b"\n".join(data))
    pieces, piece_ends = pieces_of(words, real, head, tail)
    wide, wide_ends = windows_of(pieces, head, tail)
    spans = [(h + s, h + e) for h, i in zip(head.tolist(), held.tolist(), strict=True) for s, e in line_spans(counts[i])]
    lines, line_ends = np.array(spans, np.int64).reshape(-1, 2).T
    level = np.repeat(np.arange(3), [len(pieces), len(lines), len(wide)])
    starts, ends = np.concatenate([pieces, lines, wide]), np.concatenate([piece_ends, line_ends, wide_ends])
    own = np.searchsorted(head, starts, "right") - 1
    margin = np.where(level == 2, REACH, 0)
    left, right = np.maximum(starts - margin, head[own]), np.minimum(ends + margin, tail[own])
    # shingles of five words, then those of the pieces of fewer words, then one that no reduction reads
    every = shingle_hashes(words)
    first, stop = left.copy(), right - 4
    short = np.flatnonzero(right - left < 5)
    first[short] = len(every) + np.arange(len(short))
    stop[short] = first[short] + 1
    few = np.zeros(len(short), np.uint64)
    for m in range(1, 5):
        some = (right - left)[short] == m
        few[some] = shingle_hashes(words[left[short][some][:, None] + np.arange(m)].T, m)[0] if some.any() else few[some]
    every = np.concatenate([every, few, np.zeros(1, np.uint64)])
    long = np.flatnonzero(right - left >= 5)
    pairs = np.stack([first[long], stop[long]], axis=1).ravel()

    def reduce(f, values):
        out = np.empty(len(starts), values.dtype)
        out[short] = values[first[short]]
        if len(long):
            out[long] = f.reduceat(values, pairs)[::2]
        return out

    sizes, salt = ends - starts, mix(level.astype(np.uint64) + np.uint64(11))
    mixed = [mix(every ^ mix(np.array([b + 1], np.uint64))) for b in range(bands)]
    keys = mix(reduce(np.add, mixed[0]) ^ mix(reduce(np.bitwise_xor, mixed[-1]) + sizes.astype(np.uint64)) ^ salt)
    ends_of = own_ends(every, level, first, stop)
    hashes = mix(np.stack([reduce(np.minimum, m) + np.uint64(b) ^ salt ^ mix(ends_of[b % 2]) for b, m in enumerate(mixed)], axis=1))
    bits = reduce(np.bitwise_or, np.uint64(1) << (every >> np.uint64(58))) if with_bits else None
    return Paragraphs(held[own], level, starts - head[own], sizes, keys, hashes, bits, first, stop, every)


def own_ends(every: np.ndarray, level: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last shingle of windows without their margins; 0 for other paragraphs."""
    wide = level == 2
    return tuple(np.where(wide, every[at], np.uint64(0)) for at in (np.minimum(first + REACH, stop - 1), np.maximum(stop - 1 - REACH, first)))


def slices(texts: pd.Series, most: int = 1 << 20):
    """(number of the first text, texts): neighbouring texts of so many characters together, or a longer one alone."""
    start, size, every = 0, 0, texts.tolist()
    for i, t in enumerate(every):
        size += len(t or "")
        if size > most and i > start:
            yield start, every[start:i]
            start, size = i, len(t or "")
    if start < len(every):
        yield start, every[start:]


_CHUNK = 1 << FILTER_CHUNK


def band_filters(docs: DataFrame, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit filters of the bands that paragraphs of the corpus hold twice, and of those that different paragraphs hold.

    A band goes out as its place in the filter, 16 more of its bits and 32 bits of the paragraph's key, so that different bands
    that fall on one place set no bit; a task holds the bands of one chunk of the filter at a time.
    """

    def packed_places(held: list[tuple[np.ndarray, np.ndarray]]):
        chunk, value = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(value)
        order = order[np.argsort(chunk[order], kind="stable")]
        chunk, value = chunk[order], value[order]
        some = np.ones(len(value), bool)  # two of a kind tell what more would tell
        some[2:] = (value[2:] != value[:-2]) | (chunk[2:] != chunk[:-2])
        chunk, value = chunk[some], value[some]
        edges = [*np.flatnonzero(np.diff(chunk.astype(np.int32), prepend=-1)), len(chunk)]
        rows = [(int(chunk[a]), value[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
        return pd.DataFrame(rows, columns=["chunk", "places"])

    def places(batches):
        held, n = [], 0
        for p in batches:
            for _, texts in slices(p["text"]):
                if (found := paragraphs(texts, bands)) is None:
                    continue
                band, fold = found.hashes, (found.keys >> np.uint64(32))[:, None]
                spot, more = band & np.uint64(_CHUNK - 1), (band >> np.uint64(FILTER_BITS)) & np.uint64(0xFFFF)
                chunk = ((band & np.uint64((1 << FILTER_BITS) - 1)) >> np.uint64(FILTER_CHUNK)).astype(np.uint16)
                held.append((chunk.ravel(), ((spot << np.uint64(48)) | (more << np.uint64(32)) | fold).ravel()))
                n += chunk.size
                if n >= 1 << 21:
                    yield packed_places(held)
                    held, n = [], 0
        if held:
            yield packed_places(held)

    def closed(chunk: int, held: list[bytes]) -> pd.DataFrame:
        value = np.sort(np.frombuffer(b"".join(held), np.uint64))
        band = value >> np.uint64(32)
        first = np.flatnonzero(np.diff(band, prepend=~band[:1]))
        last = np.append(first[1:], len(band)) - 1
        spot, bits = (band[first] >> np.uint64(16)).astype(np.int64), np.zeros((2, _CHUNK), bool)
        bits[0, spot[last > first]] = True
        bits[1, spot[value[last] != value[first]]] = True
        return pd.DataFrame([(chunk, *(np.packbits(b).tobytes() for b in bits))], columns=["chunk", "twice", "differ"])

    def chunks(batches):
        last, held = None, []
        for p in batches:
            for chunk, data in zip(p["chunk"].tolist(), p["places"].tolist(), strict=True):
                if chunk != last:
                    if held:
                        yield closed(last, held)
                    last, held = chunk, []
                held.append(data)
        if held:
            yield closed(last, held)

    sent = docs.select("text").mapInPandas(places, "chunk int, places binary").repartition("chunk").sortWithinPartitions("chunk")
    twice, differ = np.zeros(1 << (FILTER_BITS - 3), np.uint8), np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    width = _CHUNK // 8
    for chunk, two, other in sent.mapInPandas(chunks, "chunk int, twice binary, differ binary").collect():
        twice[chunk * width : (chunk + 1) * width] = np.frombuffer(two, np.uint8)
        differ[chunk * width : (chunk + 1) * width] = np.frombuffer(other, np.uint8)
    return twice, differ


def shared_paragraphs(docs: DataFrame, bands: int) -> DataFrame:
    """(doc_id, level, at, words, key, shingles, bits, band0, band1, ...) of the paragraphs that pass the filters.

    A window that has only exact copies tells nothing that its pieces do not tell, so windows pass only where a band holds
    different paragraphs.  Bands that hold one paragraph alone, and those of a paragraph told just before, are 0; bits too where all bands are.
    """
    tables = docs.sparkSession.sparkContext.broadcast(band_filters(docs, bands))
    names = [f"band{b}" for b in range(bands)]

    def keep(batches):
        twice, differ = tables.value
        for p in batches:
            for start, texts in slices(p["text"]):
                if (found := paragraphs(texts, bands, True)) is None:
                    continue
                other = in_filter(differ, found.hashes)
                hit = np.flatnonzero(np.where(found.level == 2, other.any(axis=1), in_filter(twice, found.hashes).any(axis=1)))
                keys = found.keys[hit].view(np.int64)
                told = np.ones(len(keys), bool)
                told[np.unique(keys, return_index=True)[1]] = False
                band = np.where(other[hit] & ~told[:, None], found.hashes[hit].view(np.int64), 0)
                rest = {"level": found.level[hit], "at": found.at[hit], "words": found.words[hit], "key": keys}
                rest |= {"shingles": (found.stop - found.first)[hit], "bits": np.where(band.any(axis=1), found.bits[hit].view(np.int64), 0)}
                ids = p["doc_id"].iloc[start + found.text[hit]].reset_index(drop=True)
                yield pd.DataFrame({"doc_id": ids} | rest | {name: band[:, b] for b, name in enumerate(names)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(keep, f"doc_id {kind}, level int, at long, words long, key long, shingles long, bits long, " + ", ".join(f"{n} long" for n in names))


def shingles_of(docs: DataFrame, bands: int, met: DataFrame) -> DataFrame:
    """(band, key, shingles) of the rows of met (band, key), and maybe a few more: two shingles that a partner must hold, 0 for any, and
    then all, in 32 bits.  Texts are read again, so that only shingles that are compared travel, straight to their band; equal
    paragraphs of several tasks come several times."""
    table = docs.sparkSession.sparkContext.broadcast(bit_filter(met.select(F.col("band").bitwiseXOR(F.col("key")).alias("h")), "h"))

    def pick(batches):
        out: dict[tuple[int, int], bytes] = {}
        frame = lambda: pd.DataFrame([(b, k, v) for (b, k), v in out.items()], columns=["band", "key", "shingles"]).astype({"band": "int64", "key": "int64"})
        size = 0
        for p in batches:
            for _, texts in slices(p["text"]):
                if (found := paragraphs(texts, bands)) is None:
                    continue
                named, at = np.unique(found.keys, return_index=True)
                hit = in_filter(table.value, found.hashes[at] ^ named[:, None])
                some, of = at[hit.any(axis=1)], np.flatnonzero(hit.any(axis=1))
                head, tail = own_ends(found.every, found.level[some], found.first[some], found.stop[some])
                every = (found.every >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                ends = np.stack([head, tail], axis=1) >> np.uint64(32)
                ends = np.where(np.stack([head, tail], axis=1) == 0, 0, ends | np.uint64(1)).astype(np.uint32)
                names, held = found.hashes[some].view(np.int64).tolist(), named[of].view(np.int64).tolist()
                for k, own, wanted, a, b, e in zip(held, names, hit[of].tolist(), found.first[some].tolist(), found.stop[some].tolist(), ends, strict=True):
                    new = [n for n, w in zip(own, wanted, strict=True) if w and (n, k) not in out]
                    if new:
                        data = e.tobytes() + np.unique(every[a:b]).tobytes()
                        size += len(data) * len(new)
                        for n in new:
                            out[(n, k)] = data
            if size > 1 << 22:
                yield frame()
                out.clear()
                size = 0
        yield frame()

    return docs.select("text").mapInPandas(pick, "band long, key long, shingles binary")


def groups_of(batches, limit: int, *columns: str):
    """Bands, parts, keys and the values of the columns, a tuple each, of the parts of bands that hold two keys or more, from rows
    sorted by band, part and key.  A part of more keys than the limit comes in pieces: more than the limit, then the rest with a
    part of -1."""
    last, held, cut = None, [], False
    end = lambda: list(zip(*[(r[0], -1, *r[2:]) for r in held] if cut else held, strict=True))
    for p in batches:
        for row in zip(*[p[c].tolist() for c in ("band", "part", *columns)], strict=True):
            if row[:2] != last[:2] if last else True:
                if len(held) > 1 or cut and held:
                    yield end()
                held, cut = [], False
            elif row[2] == last[2]:
                continue
            last = row[:3]
            held.append(row)
            if len(held) > limit:
                yield end()
                held, cut = [], True
    if len(held) > 1 or cut and held:
        yield end()


#: Similar sets lack at most this share of the smaller one's members, in both together.
LACK = 1 / THRESHOLD - 1
#: Paragraphs of a band beyond which sets of WIDE_BITS bits are made of them, 256 bytes each.
FEW, WIDE_BITS = 32, 2048


def may_match(sizes: list[int], bits: list[int], rows: int = 512) -> np.ndarray:
    """For each paragraph whether the bits of another one leave a similarity of THRESHOLD possible, so many rows at a time.

    Every bit that differs is a shingle that one of the two lacks, and similar sets lack few: no similar pair is lost.
    """
    if len(sizes) == 2:
        return np.repeat(((bits[0] ^ bits[1]) & (2**64 - 1)).bit_count() <= LACK * min(sizes) + 1e-9, 2)
    n, b = np.array(sizes), np.array(bits, np.int64).view(np.uint64)
    others = [(np.bitwise_count(b[i : i + rows, None] ^ b) <= LACK * np.minimum(n[i : i + rows, None], n) + 1e-9).sum(axis=1) for i in range(0, len(n), rows)]
    return np.concatenate(others) > 1


def similar_pair(a: bytes, b: bytes) -> bool:
    """What similar_groups tells of two paragraphs alone, whose bits have been compared before."""
    low, high = sorted((len(a) // 4 - 2, len(b) // 4 - 2))
    if low < THRESHOLD * high - 1e-9:
        return False
    one, two = memoryview(a).cast("I").tolist(), memoryview(b).cast("I").tolist()
    first, second = set(one[2:]), set(two[2:])
    both = len(first & second)
    return both >= THRESHOLD * (low + high - both) - 1e-9 and {e for e in one[:2] if e} <= second and {e for e in two[:2] if e} <= first


def similar_groups(held: list[bytes]) -> np.ndarray:
    """For each paragraph of a band (its two ends and its shingles, 32 bits each) the number of the first one of its component.

    Sizes and 64 bits a set tell for a whole row which earlier sets can be similar, and where they leave many, WIDE_BITS bits, which
    long paragraphs do not fill.  Only those of other components are compared.
    """
    if len(held) == 2:
        return np.array([0, 0 if similar_pair(*held) else 1])
    every = [np.frombuffer(x, np.uint32) for x in held]
    sets: list[frozenset | None] = [None] * len(every)
    sizes = np.array([len(x) - 2 for x in every])
    bits = np.array([np.bitwise_or.reduce(np.uint64(1) << (x[2:] >> np.uint32(26)).astype(np.uint64)) for x in every], np.uint64)
    ends = [{e for e in x[:2].tolist() if e} for x in every]
    label, wide = np.arange(len(every)), None
    if len(every) > FEW:
        own = np.repeat(np.arange(len(every)), sizes)
        wide = np.zeros((len(every), WIDE_BITS), bool)
        wide[own, np.concatenate([x[2:] for x in every]) >> np.uint32(32 - WIDE_BITS.bit_length() + 1)] = True
        wide = np.packbits(wide, axis=1).view(np.uint64)

    def similar(i: int, j: int) -> bool:
        for k in (i, j):
            if sets[k] is None:
                sets[k] = frozenset(every[k][2:].tolist())
        if not (ends[i] <= sets[j] and ends[j] <= sets[i]):
            return False
        both = len(sets[i] & sets[j])
        return both >= THRESHOLD * (sizes[i] + sizes[j] - both) - 1e-9

    for i in range(1, len(every)):
        low, high = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
        left = np.flatnonzero((np.bitwise_count(bits[:i] ^ bits[i]) <= LACK * low + 1e-9) & (low >= THRESHOLD * high - 1e-9))
        if wide is not None and len(left) > FEW // 4:
            left = left[np.bitwise_count(wide[left] ^ wide[i]).sum(axis=1, dtype=np.int64) <= LACK * low[left] + 1e-9]
        while len(left):
            j, left = left[0], left[1:]
            if similar(i, j):
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
                left = left[label[left] != a]
    return label


def verified_edges(docs: DataFrame, found: DataFrame, bands: int, block: int = 2048) -> DataFrame:
    """(a, b) stars of distinct paragraphs that share a band and are similar enough; a band of many becomes pairs of blocks."""
    told = found.select(F.explode(F.array(*[f"band{b}" for b in range(bands)])).alias("band"), F.lit(0).cast("long").alias("part"), "key", "shingles", "bits").filter("band <> 0")
    columns = ["band", "part", "key", "shingles", "bits"]

    def likely(limit):
        def rows(batches):
            out: list[tuple] = []
            for group in groups_of(batches, limit, "key", "shingles", "bits"):
                whole = len(group[0]) > limit or group[1][0] < 0
                out += list(zip(group[0], [-1] * len(group[0]), *group[2:], strict=True)) if whole else [(group[0][0], group[1][0], group[2][i], 0, 0) for i in np.flatnonzero(may_match(*group[3:]))]
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns).astype("int64")

        return lambda df: df.repartition("band", "part").sortWithinPartitions("band", "part", "key").mapInPandas(rows, "band long, part long, key long, shingles long, bits long")

    near = materialize(told.transform(likely(block)), "likely")
    hot = near.filter("part < 0")
    sizes = hot.groupBy("band").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    hot = hot.drop("part").join(sizes, "band").withColumn("own", F.pmod(F.hash("key"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hot = hot.select("band", (F.least("own", "other") * 1_000_000 + F.greatest("own", "other") + 1).cast("long").alias("part"), "key", "shingles", "bits")
    drop_shuffles(docs.sparkSession)
    some = materialize(near.filter("part >= 0").union(hot.transform(likely(1 << 62))).select("band", "part", "key"), "met")
    release(near)
    drop_shuffles(docs.sparkSession)

    def check(batches):
        out: list[tuple[int, int]] = []
        for _, _, keys, held in groups_of(batches, 1 << 62, "key", "shingles"):
            out += [(keys[i], keys[r]) for i, r in enumerate(similar_groups(held).tolist()) if r != i]
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    def checked(d: DataFrame) -> DataFrame:
        return d.repartition("band", "part").sortWithinPartitions("band", "part", "key").mapInPandas(check, "a long, b long")

    cold, parts = some.filter("part = 0").select("band", "key"), some.filter("part > 0")
    edges = checked(shingles_of(docs, bands, cold).withColumn("part", F.lit(0).cast("long")))
    if not parts.isEmpty():  # bands of many paragraphs go to several groups
        named = parts.select("band", "key").distinct()
        # one text that holds a paragraph tells it, so other texts are not cut again
        held = found.filter(" or ".join(f"band{b} <> 0" for b in range(bands))).select("doc_id", "key").join(named.select("key").distinct(), "key").groupBy("key").agg(F.min("doc_id").alias("one"))
        holds = maybe_among(docs.sparkSession, held.select("one").distinct(), "one")
        sets = shingles_of(docs.filter(holds(F.col("doc_id"))), bands, named).groupBy("band", "key").agg(F.first("shingles").alias("shingles"))
        edges = edges.unionByName(checked(parts.join(sets, ["band", "key"])))
    return edges.distinct()


def in_runs(spans: DataFrame) -> DataFrame:
    """spans with end, run (a number per stretch of spans of a document that touch or overlap) and fresh: the words of an extra
    span that no extra span before it holds."""
    order = Window.partitionBy("doc_id").orderBy("at", "end", "level", "cluster")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = spans.withColumn("end", F.col("at") + F.col("words"))
    s = s.withColumn("start", F.when(F.col("at") > F.coalesce(F.max("end").over(before), F.lit(-1)), 1).otherwise(0))
    held = F.coalesce(F.max(F.when(F.col("extra"), F.col("end"))).over(before), F.lit(0))
    fresh = F.when(F.col("extra"), F.greatest(F.lit(0), F.col("end") - F.greatest("at", held))).otherwise(0)
    return s.withColumns({"run": F.sum("start").over(order), "fresh": fresh}).drop("start")


def repeated_paragraphs(docs: DataFrame, id_col: str, text_col: str, recall: float, inside: bool = True) -> DataFrame:
    """(doc_id, level, at, words, cluster, extra, end, run, fresh): paragraphs that stand elsewhere too, in another document or
    (inside) in the same one.  extra marks all but the first occurrence of a cluster and what overlaps it."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bands = bands_for(recall)
    with byte_batches(docs.sparkSession):
        found = materialize(shared_paragraphs(texts, bands), "paragraphs")
        drop_shuffles(docs.sparkSession)
        edges = materialize(verified_edges(texts, found, bands), "paragraph-edges")
        drop_shuffles(docs.sparkSession)
        near = connected_components(edges).select("node", "component")
        place = found.select("doc_id", "level", "at", "words", "key")
        may = maybe_among(docs.sparkSession, near, "node")(F.col("key"))
        # most paragraphs have exact copies only: they are clusters by their key, without a join
        moved = place.filter(may).join(near, F.col("key") == F.col("node"), "left").select("doc_id", "level", "at", "words", F.coalesce("component", "key").alias("cluster"))
        owned = materialize(place.filter(~may).withColumnRenamed("key", "cluster").unionByName(moved), "owned")
    release(found)
    drop_shuffles(docs.sparkSession)
    seen = owned.groupBy("cluster").agg(F.min(F.struct("doc_id", "at", "words")).alias("first"), F.max("doc_id").alias("last"), F.max("at").alias("far"))
    elsewhere = ~F.col("first.doc_id").eqNullSafe(F.col("last"))
    # windows of one document that are alike only because they overlap are no repeats
    apart = F.col("far") >= F.col("first.at") + F.col("first.words")
    seen = seen.filter(elsewhere | apart if inside else elsewhere).select("cluster", "first")
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    repeats = owned.join(seen, "cluster").withColumn("extra", ~here | (F.col("at") >= F.col("first.at") + F.col("first.words")))
    return in_runs(repeats.select("doc_id", "level", "at", "words", "cluster", "extra"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, min_run: int = MIN_RUN, inside: bool = True) -> DataFrame:
    """One row per passage that repeats elsewhere, in another document or (inside) in its own: doc_id, start_word, end_word
    (exclusive), n_words, n_removed (words that are no first occurrence), cluster (component of its first paragraph) and removed.

    Rows that share an id count as one document.  Null, empty and blank texts have no passages, nor have documents whose
    words repeat nowhere.  Tables may be empty.
    """
    with scratch() as keep:
        runs = repeated_paragraphs(docs, id_col, text_col, recall, inside).groupBy("doc_id", "run").agg(
            F.min("at").alias("start_word"), F.max("end").alias("end_word"), (F.max("end") - F.min("at")).alias("n_words"),
            F.sum("fresh").alias("n_removed"), F.min_by("cluster", F.struct("at", "level")).alias("cluster"),
        )
        kept = runs.filter(F.col("n_words") >= min_run).drop("run").withColumn("removed", F.col("n_removed") > 0)
        return keep(materialize(kept, "passages"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, min_run: int = MIN_RUN) -> DataFrame:
    """docs with all but the first occurrence of repeated passages cut from the text; other texts stay as they are.

    The columns stay as they are, whatever their names.  Texts of an id that has several different texts stay whole, since
    passages name places by id alone.
    """
    with scratch() as keep:
        all_ = materialize(repeated_paragraphs(docs, id_col, text_col, recall), "repeats")
        long = all_.groupBy("doc_id", "run").agg((F.max("end") - F.min("at")).alias("n")).filter(F.col("n") >= min_run).select(F.col("doc_id").alias("_d"), F.col("run").alias("_r"))
        gone = all_.filter("fresh > 0").join(long, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("run") == F.col("_r")))
        total = docs.groupBy(F.col(id_col).alias("one")).agg(F.min(F.xxhash64(text_col)).alias("low"), F.max(F.xxhash64(text_col)).alias("high")).filter("low = high")
        gone = gone.join(total.select("one"), F.col("doc_id").eqNullSafe(F.col("one")), "left_semi")
        spans = keep(materialize(gone.groupBy(F.col("doc_id").alias("span_id")).agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("fresh")).alias("at"), "end"))).alias("spans")), "spans"))

    @F.pandas_udf(StringType())
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if a is None else without_words(t, a, e) for t, a, e in zip(texts, starts, ends, strict=True)], dtype="object")

    d = packed(docs, id=F.col(id_col), text=F.col(text_col)).join(spans, F.col("id").eqNullSafe(F.col("span_id")), "left")
    return unpacked(d, docs.columns, **{text_col: cut(F.col("text"), F.col("spans")["at"], F.col("spans")["end"])}).select(*[f"`{c}`" for c in docs.columns])


def without_words(text: str, starts, ends) -> str:
    """The text without the words starts[i]..ends[i] and the white space behind them."""
    edges = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    out, at = [], 0
    for a, e in zip(starts, ends, strict=True):
        out.append(text[at : edges[a]])
        at = edges[e]
    return "".join(out) + text[at:]


def op5_passage_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(load(spark, sf_dir, "documents").select("doc_id", "text"))
