"""Operator 3: quality rules with a hashed n-gram log-likelihood ratio.

Unigrams and bigrams of word and punctuation runs are hashed into buckets.  The buckets of the raw corpus (all documents) and of
the trusted target (all documents labelled as good) are counted; the mean log ratio of the two smoothed multinomials over the n-grams
of a document is its score, and every document at or above a fixed threshold is kept unless a base rule fails it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, load, maybe_among_ids, number_table, packed, text_of, unpacked, words_of

#: Runs of word characters (all beyond ASCII included) or of ASCII punctuation; classes that Java looks up in a table.
TOKEN = r"[^\p{Punct}\s]+|\p{Punct}+"
BUCKETS = 8192
THRESHOLD = -0.3
#: Good ids that go to every task (some 20 bytes each); beyond it texts that pass a filter of fixed size meet them in a shuffle.
BROADCAST_IDS = 1_000_000


def rest(values: str | Column, skip: int = 1) -> Column:
    """An array without its first items.  Neighbours meet by zip_with of shifted arrays and not by index inside a lambda: where
    the optimizer inlines the array expression, an index would compute it once per item."""
    return F.slice(values, skip + 1, 2_000_000_000)


def ngram_buckets(docs: DataFrame, text: Column, buckets: int = BUCKETS) -> DataFrame:
    """docs (of own column names) plus _grams, the buckets of all unigrams and bigrams of the text."""
    hashed = docs.withColumn("_hashes", F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.hash(t)))
    one = F.transform("_hashes", lambda h: F.pmod(h, F.lit(buckets)))
    pair = F.zip_with(F.col("_hashes"), rest("_hashes"), lambda a, b: F.when(b.isNotNull(), F.pmod(F.hash(a, b), F.lit(buckets))))
    two = F.slice(pair, F.lit(1), F.greatest(F.size("_hashes") - 1, F.lit(0)))
    return hashed.withColumn("_grams", F.concat(one, two)).drop("_hashes")


def fit_ratio(
    docs: DataFrame, good_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = 1.0, broadcast_ids: int = BROADCAST_IDS
) -> list[float]:
    """Log ratio of target to corpus per bucket; only one count per bucket comes back.

    The corpus counts cover all documents and the target counts all good ones, at any size.  Up to broadcast_ids good ids go to
    every task, and one pass counts both; beyond it the texts of good documents are shuffled once and counted beside the corpus.
    """
    marks = good_ids.select(F.col(id_col).alias("good_id")).filter("good_id is not null").distinct()
    d = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    one = F.lit(1).cast("long")
    if marks.limit(broadcast_ids + 1).count() <= broadcast_ids:
        both = d.join(F.broadcast(marks), F.col("id") == F.col("good_id"), "left").select("t", one.alias("raw"), F.col("good_id").isNotNull().cast("long").alias("good"))
    else:
        hits = maybe_among_ids(d, "id", marks, "good_id").filter("maybe").join(marks, F.col("id") == F.col("good_id"), "left_semi")
        both = d.select("t", one.alias("raw"), (one - 1).alias("good")).union(hits.select("t", one - 1, one))
    grams = ngram_buckets(both, F.col("t"), buckets).select("raw", "good", F.explode_outer("_grams").alias("g")).filter("g is not null")
    counts = grams.groupBy("g").agg(F.sum("raw").alias("n"), F.sum("good").alias("n_good")).collect()
    raw, good = [smoothing] * buckets, [smoothing] * buckets
    for g, n, n_good in counts:
        raw[g] += n
        good[g] += n_good
    if not any(n_good for _, _, n_good in counts):
        return [0.0] * buckets  # no trusted text: no evidence either way
    return [math.log(a / sum_a) - math.log(b / sum_b) for sum_a, sum_b in [(sum(good), sum(raw))] for a, b in zip(good, raw, strict=True)]


def base_rules(docs: DataFrame, text: Column) -> DataFrame:
    """docs (of own column names) plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A word counts as repeated when a window of three words that covers it is found twice or more in the text.  Windows are
    compared by 64-bit hashes; only texts with an equal pair of windows sort them.
    """
    n = F.col("n_words")
    d = docs.withColumns({"_w": words_of(text), "_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    d = d.withColumns({
        "n_words": F.size("_w"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_h": F.transform("_w", lambda w: F.xxhash64(w)),
    }).drop("_w", "_lines")
    two = F.zip_with(F.col("_h"), rest("_h"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    three = F.zip_with(two, rest("_h", 2), lambda ab, c: F.xxhash64(ab["a"], ab["b"], c))
    d = d.withColumn("_win", F.slice(three, F.lit(1), F.greatest(n - 2, F.lit(0)))).drop("_h")
    twice = F.size("_win") != F.size(F.array_distinct("_win"))
    d = d.withColumn("_s", F.when(twice, F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_win")
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    after = F.zip_with(F.col("_s"), rest("_s"), lambda a, b: F.struct(a.alias("w"), same(a, b).alias("near")))
    before = F.zip_with(after, F.concat(F.slice("_s", 1, 1), F.col("_s")), lambda a, b: F.when(a["near"] | (same(a["w"], b) & (a["w"]["i"] != b["i"])), a["w"]["i"]))
    d = d.withColumn("_p", F.array_sort(F.array_compact(before))).drop("_s")
    gaps = F.zip_with(F.col("_p"), rest("_p"), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, v: a + v)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")
    return d.withColumn("n_words", n.cast("long")).withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def quality_rules(
    docs: DataFrame, good_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS
) -> DataFrame:
    """docs plus the base rules, score (mean log ratio; 0 for texts without n-grams) and kept, for every document.

    Null texts have no words and fail the base rule; good_ids may be empty (all scores 0), repeat ids or name unknown ones.
    Repeated rows are judged alike.  Columns of docs that have the names of results (RESULTS) are replaced, all others stay.
    """
    weights = number_table(fit_ratio(docs, good_ids, id_col, text_col, buckets))
    scored = ngram_buckets(packed(docs, text=text_of(text_col)), F.col("text"), buckets)
    total = F.aggregate("_grams", F.lit(0.0), lambda a, g: a + F.get(weights, g))
    scored = scored.withColumn("score", F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(F.lit(0.0))).drop("_grams")
    judged = base_rules(scored, F.col("text")).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
    return unpacked(judged, docs.columns, **{c: F.col(c) for c in RESULTS})


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    good = load(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return quality_rules(docs, good).select("doc_id", *names)
