"""Operator 9: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Every passage of the whole text is encoded (hashed byte trigrams and a few shape
ratios through a learned layer); gated attention, learned from document labels alone, weighs the passages; the weighted
mean of their encodings gives the score.  The model is fitted on a bounded sample of labelled documents and applied to all
documents in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, packed, small_batches, text_of, unpacked, words_of

PASSAGE_WORDS = 64
TRIGRAMS = 256
SHAPES = 7
#: Trigrams, shares of character classes, and: distinct words to words, words to a full passage, bytes to a word.
WIDTH = TRIGRAMS + SHAPES + 3
HIDDEN, GATE = 32, 16
#: Bounds of the training sample: documents, and passages of them (whole documents in the order of a hash of their id).
SAMPLE_DOCS = 2_500
SAMPLE_PASSAGES = 20_000
#: Bytes that are encoded at a time.
BLOCK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.full(256, 6, np.uint8)  # other ASCII marks
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 3
_CLASS[128:] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
_CODE = np.arange(1, 257, dtype=np.uint64) ** np.uint64(7) * np.uint64(0x9E3779B97F4A7C15)
_CODE[[9, 10, 11, 12, 13, 32]] = 0


def encode(text: str | None):
    """Yields (passages, WIDTH) float32 features, in blocks, of the whole text; a text without words is one zero passage."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    space = _SPACE[raw]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(raw) else raw
    if len(begins) == 0:
        yield np.zeros((1, WIDTH), np.float32)
        return
    cuts = np.append(begins[::PASSAGE_WORDS], len(raw))
    cuts[0] = 0
    first = 0
    while first < len(cuts) - 1:
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + BLOCK, "right")) - 1)
        yield _block(raw[cuts[first] : cuts[last]], np.diff(cuts[first : last + 1]), space[cuts[first] : cuts[last]])
        first = last


def _block(raw: np.ndarray, lengths: np.ndarray, space: np.ndarray) -> np.ndarray:
    n = len(lengths)
    passage = np.repeat(np.arange(n, dtype=np.int64), lengths)
    out = np.zeros((n, WIDTH), np.float32)
    if len(raw) >= 3:
        b = raw.astype(np.uint32)
        h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        code = passage[:-2] * TRIGRAMS + (h >> np.uint32(24))
        out[:, :TRIGRAMS] = np.sqrt(np.bincount(code, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS))
        out[:, :TRIGRAMS] /= np.maximum(1e-6, np.linalg.norm(out[:, :TRIGRAMS], axis=1, keepdims=True))
    kinds = np.bincount(passage * SHAPES + _CLASS[raw], minlength=n * SHAPES).reshape(n, SHAPES)
    out[:, TRIGRAMS : TRIGRAMS + SHAPES] = kinds / np.maximum(1, lengths)[:, None]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    within = np.arange(len(raw) - begins[0]) - np.repeat(begins - begins[0], np.diff(np.append(begins, len(raw))))
    terms = _CODE[raw[begins[0] :]] * (2 * within + 1).astype(np.uint64)  # white space has code 0, so it adds nothing
    names = np.add.reduceat(terms, begins - begins[0])
    owner = passage[begins]
    order = np.lexsort((names, owner))
    names, owner = names[order], owner[order]
    fresh = np.concatenate(([True], (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])))
    total = np.bincount(owner, minlength=n)
    out[:, -3] = np.bincount(owner[fresh], minlength=n) / np.maximum(1, total)
    out[:, -2] = total / PASSAGE_WORDS
    out[:, -1] = np.minimum(1, lengths / np.maximum(1, total) / 16)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _attend(m: dict, x: np.ndarray):
    hidden = np.maximum(x @ m["w1"] + m["b1"], 0)
    tan, gate = np.tanh(hidden @ m["v"]), _sigmoid(hidden @ m["u"])
    return hidden, tan, gate, np.exp(np.clip((tan * gate) @ m["a"], -30, 30))


def train(x: np.ndarray, starts: np.ndarray, y: np.ndarray, steps: int = 80, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> dict:
    """Adam on the log loss of bags: rows starts[i]..starts[i+1] of x are the passages of document i."""
    r = np.random.default_rng(seed)
    m = {
        "w1": r.normal(0, (2 / WIDTH) ** 0.5, (WIDTH, HIDDEN)), "b1": np.zeros(HIDDEN), "v": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "u": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "a": r.normal(0, GATE**-0.5, GATE), "w": r.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1),
    }
    m = {k: v.astype(np.float32) for k, v in m.items()}
    share = min(0.99, max(0.01, float(y.mean())))
    m["b"][:] = np.log(share / (1 - share))
    if y.min() == y.max():
        return m | {"w": m["w"] * 0}  # one class only: its smoothed share for every document
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    bag = np.repeat(np.arange(len(y)), np.diff(np.append(starts, len(x))))
    for t in range(1, steps + 1):
        hidden, tan, gate, e = _attend(m, x)
        part = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(part[:, None] * hidden, starts)
        d = (_sigmoid(z @ m["w"] + m["b"]) - y).astype(np.float32) / len(y)
        dz = (d[:, None] * m["w"])[bag]
        da = part * ((hidden - z[bag]) * dz).sum(1)
        mix = da[:, None] * m["a"]
        dt, dg = mix * gate * (1 - tan**2), mix * tan * gate * (1 - gate)
        dh = (part[:, None] * dz + dt @ m["v"].T + dg @ m["u"].T) * (hidden > 0)
        grads = {"w1": x.T @ dh, "b1": dh.sum(0), "v": hidden.T @ dt, "u": hidden.T @ dg, "a": (tan * gate).T @ da, "w": z.T @ d, "b": np.array([d.sum()])}
        for k, g in grads.items():
            g = g + decay * m[k] * (m[k].ndim > 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            m[k] = (m[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return m


def score_text(m: dict, text: str | None) -> float:
    total, weight = np.zeros(HIDDEN), 0.0
    for x in encode(text):
        hidden, _, _, e = _attend(m, x)
        total += e @ hidden
        weight += float(e.sum())
    return float(_sigmoid(np.array(total / weight @ m["w"] + m["b"][0])))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample_docs: int = SAMPLE_DOCS, sample_passages: int = SAMPLE_PASSAGES) -> dict:
    """The model, from at most sample_docs labelled documents with at most sample_passages passages, in the order of a hash.

    Null labels are left out; several labels of one id count by their mean, several rows of one id by their shortest text;
    without any label every score is 0.5.  The sample is encoded on the executors; its features, 532 bytes a passage, come to the driver.
    """
    means = labels.filter(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("label_id")).agg(F.avg(label_col).alias("y"))
    chosen = means.orderBy(F.xxhash64("label_id"), "label_id").limit(sample_docs)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    found = texts.join(F.broadcast(chosen), F.col("id") == F.col("label_id"))  # sample_docs rows at most
    # one text per id; sizes come first, so that only the features of passages within the bound are gathered
    passages = F.greatest(F.lit(1), F.ceil(F.size(words_of(F.col("t"))) / PASSAGE_WORDS))
    sizes = found.groupBy("id", "y").agg(F.min(F.struct(passages.alias("n"), F.xxhash64("t").alias("sum"))).alias("x")).select("id", "y", "x.n", "x.sum").collect()
    used, fit_ids = 0, []
    for r in sorted(sizes, key=lambda r: (hash_of(str(r["id"])), str(r["id"]))):
        if used + r["n"] <= sample_passages:
            used += r["n"]
            fit_ids.append((r["id"], r["sum"], r["y"]))

    def bags(batches):
        for p in batches:
            yield pd.DataFrame({"id": p["id"].astype(str), "y": p["y"], "x": [np.concatenate(list(encode(t))).astype(np.float16).tobytes() for t in p["t"]]})

    taken = []
    if fit_ids:
        some = docs.sparkSession.createDataFrame(fit_ids, f"fit_id {docs.schema[id_col].dataType.simpleString()}, fit_sum long, y double")
        some = texts.join(F.broadcast(some), (F.col("id") == F.col("fit_id")) & (F.xxhash64("t") == F.col("fit_sum"))).dropDuplicates(["id"])
        taken = sorted(some.mapInPandas(bags, "id string, y double, x binary").collect(), key=lambda r: (hash_of(r["id"]), r["id"]))
    if not taken:
        return train(np.zeros((1, WIDTH), np.float32), np.array([0]), np.array([0.5]))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in taken), np.float16).reshape(-1, WIDTH).astype(np.float32)
    starts = np.concatenate(([0], np.cumsum([len(r["x"]) // (2 * WIDTH) for r in taken])[:-1]))
    return train(x, starts, np.array([float(r["y"] >= 0.5) for r in taken]))


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def score_documents(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs plus the score of every document, 0 to 1, in a column that replaces one of its name.

    Null and blank texts get the score of an empty passage; repeated rows get equal scores; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(model, t) for t in texts], dtype="float64")

    return docs.withColumn(out, score(F.col(text_col)))


def passage_weights(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, passage, weight, score): how much attention each passage of 64 words gets, and how it scores by itself."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def explain(batches):
        for p in batches:
            for i, t in zip(p["doc_id"], p["text"], strict=True):
                parts = [_attend(model, x) for x in encode(t)]
                weight = np.concatenate([e for *_, e in parts]).astype(float)
                alone = np.concatenate([_sigmoid(h @ model["w"] + model["b"]) for h, *_ in parts]).astype(float)
                yield pd.DataFrame({"doc_id": [i] * len(weight), "passage": np.arange(len(weight)), "weight": weight / weight.sum(), "score": alone})

    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return some.mapInPandas(explain, f"doc_id {kind}, passage long, weight double, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text_col: str = "text", **kw) -> DataFrame:
    """The documents whose score reaches the threshold; the columns stay as they are, whatever their names.

    Null and blank texts are judged as an empty passage, repeated rows alike; tables may be empty.
    """
    model = fit(docs, labels, text_col=text_col, **kw)
    scored = score_documents(packed(docs, text=F.col(text_col).cast("string")), model, "text")
    return unpacked(scored.filter(F.col("score") >= threshold), docs.columns)


def op9_attention_mil(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
