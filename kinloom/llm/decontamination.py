"""Operator 10: benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; hashes of windows of eight canonical words of every document meet those
of the benchmark in one hash join, and so do hashes of the plain words in lower case, since names show by their capitals.  Where
a document shares enough of an item's windows, the values in all matched placeholders must map one to one from item to document:
verbatim copies map each value to itself, a re-parameterised question maps it to one other value, and different values to
different ones.  Items of fewer than four words leak in documents of just these words.

Documents are read once for all windows, and what hits a window of the benchmark is written.  A leak needs a share of an item's
windows, so it hits one of the item's rarest: only pairs that do are counted, and a phrase that many items share makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, materialize, scratch, text_of, without_ids, words_of
from .quality_rules import rest

WINDOW = 8
MIN_LITERALS = 4
MIN_COVERAGE = 0.4
MIN_AGREE = 0.75
#: Windows of the benchmark that may be broadcast (24 bytes each); beyond it the windows of the documents are shuffled.
BROADCAST_WINDOWS = 1_000_000
#: Unit words (fixed values).
UNITS = (
    "mm", "cm", "dm", "m", "km", "meter", "meters", "metre", "metres", "kilometers", "kilometres", "inch", "inches", "feet", "foot", "ft", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ton", "tons", "lb", "lbs", "pound", "pounds", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres",
    "s", "sec", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees", "mph", "kmh", "hz", "khz", "watt", "watts", "volt", "volts",
)
UNIT_RE = "|".join(sorted(UNITS, key=len, reverse=True))
MARKS = ".,;:!?\"'()[]"


def canonical_words(text: Column) -> Column:
    """Words with typed placeholders; white space is untouched, so word i of the result stands for word i of the text."""
    t = F.regexp_replace(text, r"[+-]?[0-9][0-9.,:/]*%?", "{num}")
    t = F.regexp_replace(t, r"\{num\}(?:" + UNIT_RE + r")(?![A-Za-z{])", "{num}{unit}")
    t = F.regexp_replace(t, r"(?<!\p{L})\p{Lu}\p{Ll}+(?!\p{L})", "{name}")
    # two steps, or the lambda would strip each word twice
    return F.transform(F.transform(words_of(F.lower(t)), lambda w: F.translate(w, MARKS, "")), _unit)


def _unit(w: Column) -> Column:
    return F.when(w.isin(*UNITS), F.lit("{unit}")).otherwise(w)


def plain_words(text: Column) -> Column:
    return F.transform(words_of(F.lower(text)), lambda w: F.translate(w, MARKS, ""))


def solid_words(text: Column) -> Column:
    return F.filter(plain_words(text), lambda w: F.length(w) > 0)


def windows(df: DataFrame, words: str, sizes: list[int], salt: str = "", cut: bool = True) -> DataFrame:
    """df plus words4, words5, ... (by the column's name) for sizes of four to eight: the hashes of all windows of so many words; other
    salts, other hashes.  Pairs, fours and eights come by doubling, the sizes between from those; none is hashed word by word again.
    Without cut there is a hash for each word: the last ones are of what is left of the text, and equal no whole window's."""
    h = lambda k: f"{words}_h{k}"
    d = df.withColumn(h(1), F.transform(words, lambda w: F.xxhash64(w, F.lit(salt)) if salt else F.xxhash64(w)))
    join = lambda a, k, b: F.zip_with(F.col(h(a)), rest(h(b), k), lambda x, y: F.xxhash64(x, y))
    steps = {2: (1, 1, 1), 4: (2, 2, 2), 5: (4, 4, 1), 6: (4, 4, 2), 7: (6, 6, 1), 8: (4, 4, 4)}
    for k in (2, 4, 5, 6, 7, 8):
        if k <= 4 or k in sizes or k == 6 and 7 in sizes:
            d = d.withColumn(h(k), join(*steps[k]))
    for k in sizes:
        d = d.withColumn(f"{words}{k}", F.slice(h(k), F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0))) if cut else F.col(h(k)))
    return d.drop(*[h(k) for k in range(1, 9)])


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, list[int]]:
    """(item_id, item_at, window, n_windows) and the window sizes under eight that short items need.

    A position counts where enough words of its window are no placeholders, or, in items without such a window, where enough are
    more than marks; n_windows counts positions.  It has the hash of its plain words and, in the first case, of its canonical ones.
    """
    text = text_of(text_col)
    b = benchmark.select(F.col(item_col).alias("item_id"), canonical_words(text).alias("c"), plain_words(text).alias("p"))
    n = F.size("p")
    short = sorted(r["n"] for r in b.select(n.alias("n")).filter((F.col("n") >= MIN_LITERALS) & (F.col("n") < WINDOW)).distinct().collect())

    def positions(items: DataFrame, size: int) -> DataFrame:
        d = windows(windows(items, "c", [size]), "p", [size], "plain").withColumnsRenamed({f"c{size}": "w", f"p{size}": "v"})
        d = d.select("item_id", "c", "p", F.posexplode_outer(F.arrays_zip("w", "v")).alias("item_at", "x")).filter("x is not null")
        count = lambda a, test: F.size(F.filter(F.slice(a, F.col("item_at") + 1, size), test))
        literal, solid = count("c", lambda x: ~x.contains("{") & (F.length(x) > 0)), count("p", lambda x: F.length(x) > 0)
        return d.filter(solid >= MIN_LITERALS).select("item_id", "item_at", "x.w", "x.v", (literal >= MIN_LITERALS).alias("typed"))

    all_ = positions(b, WINDOW)
    for size in short:
        all_ = all_.unionByName(positions(b.filter(n == size), size))
    good = all_.join(all_.groupBy("item_id").agg(F.max("typed").alias("any")), "item_id").filter("typed or not any")
    good = good.join(good.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_windows")), "item_id")
    forms = F.when(F.col("typed"), F.array("w", "v")).otherwise(F.array("v"))
    return good.select("item_id", "item_at", F.explode(forms).alias("window"), "n_windows"), short


def window_hits(d: DataFrame, sizes: list[int], known: DataFrame, few: bool, tiny_items: bool) -> DataFrame:
    """(doc_id, text_sum, doc_at, window) of d (doc_id, text_sum, text) for the windows that are known (window): windows of canonical and
    of plain words of all sizes, and, where there are items of few words, one of all words of documents of few words.

    Each text is cut up once, and all hashes of a text are one array; where a hit stood is told from its place in it.
    """
    d = d.select("doc_id", "text_sum", canonical_words(F.col("text")).alias("c"), plain_words(F.col("text")).alias("p"))
    d = windows(windows(d, "c", sizes, cut=False), "p", sizes, "plain", cut=False)
    parts = [F.col(f"{w}{k}") for k in sizes for w in "cp"]
    if tiny_items:
        d = d.withColumn("solid", _solid(F.col("p")))
        parts.append(F.when(_is_tiny(F.col("solid")), F.array(_whole(F.col("solid")))).otherwise(F.array().cast("array<bigint>")))
    every = F.concat(*parts)
    hits = d.select("doc_id", "text_sum", F.size("p").alias("n"), F.posexplode(every).alias("pos", "window"))
    hits = hits.join(F.broadcast(known), "window", "left_semi") if few else hits.join(known, "window")
    at = F.when(F.col("pos") < 2 * len(sizes) * F.col("n"), F.pmod("pos", "n")).otherwise(0)
    return hits.select("doc_id", "text_sum", at.cast("int").alias("doc_at"), "window")


def _solid(plain: Column) -> Column:
    return F.filter(plain, lambda w: F.length(w) > 0)


def _is_tiny(solid: Column) -> Column:
    return (F.size(solid) > 0) & (F.size(solid) < MIN_LITERALS)


def _whole(solid: Column) -> Column:
    return F.xxhash64(F.array_join(solid, " "), F.lit("whole"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_coverage: float = MIN_COVERAGE, min_agree: float = MIN_AGREE,
) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, coverage, n_slots, agree, verbatim) for each document that leaks an item.

    coverage: share of the item's windows found in the document.  n_slots: placeholders in them, along the best alignment; agree:
    of these, where the item value or the document value stands more than once, the share that follows the main mapping of both,
    so that neither several values for one nor one for several count; 1 where no value stands twice.  verbatim: the mapping is the identity.  Null and empty texts leak
    nothing; items of fewer than eight words are one window; items of fewer than four words that are more than marks
    are found in documents that hold these words and no others (one window, no placeholders).  Rows that share an id (or have none)
    are checked text by text, and the text that leaks most of an item is told; of equal items one id each is reported.  Either table may be empty.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_sum", F.xxhash64("text"))
    with scratch() as keep:
        pairs = _matched_pairs(rows, benchmark, item_col, item_text_col, min_coverage)
        checked = slot_check(pairs.filter(~F.col("whole")), rows, benchmark, item_col, item_text_col).filter(F.col("agree") >= min_agree)
        one = F.lit(1).cast("long")
        tiny = pairs.filter("whole").select("doc_id", "item_id", one.alias("n_matched"), one.alias("n_windows"), F.lit(1.0).alias("coverage"), (one - 1).alias("n_slots"), F.lit(1.0).alias("agree"), F.lit(True).alias("verbatim"))
        every = checked.unionByName(tiny)
        rest = [c for c in every.columns if c not in ("doc_id", "item_id")]
        most = F.max(F.struct("coverage", "agree", *[c for c in rest if c not in ("coverage", "agree")])).alias("m")
        every = every.groupBy("doc_id", "item_id").agg(most).select("doc_id", "item_id", *[F.col("m")[c].alias(c) for c in rest])
        return keep(materialize(every, "found"))


def _matched_pairs(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, min_coverage: float) -> DataFrame:
    """(doc_id, text_sum, item_id, n_matched, n_windows, best, coverage, whole) of texts that hold enough windows of an item."""
    items, short = benchmark_windows(benchmark, item_col, item_text_col)
    solid = benchmark.select(F.col(item_col).alias("item_id"), solid_words(text_of(item_text_col)).alias("w")).filter(_is_tiny(F.col("w")))
    whole = solid.select("item_id", F.lit(0).alias("item_at"), _whole(F.col("w")).alias("window"), F.lit(1).cast("long").alias("n_windows"), F.lit(True).alias("whole")).distinct()
    items = materialize(items.withColumn("whole", F.lit(False)).unionByName(whole), "windows")
    few, tiny_items = items.count() <= BROADCAST_WINDOWS, not items.filter("whole").isEmpty()
    small = F.broadcast if few else lambda d: d
    hits = materialize(window_hits(rows, [WINDOW, *short], items.select("window").distinct(), few, tiny_items), "hits")
    # of n positions a leak matches ceil(min_coverage * n) at least, so one of the n + 1 - that rarest ones
    often = items.groupBy("window").agg(F.count_distinct("item_id").alias("items"))
    places = items.join(often, "window").groupBy("item_id", "item_at", "whole", "n_windows").agg(F.max("items").alias("items"))
    rank = F.row_number().over(Window.partitionBy("item_id", "whole").orderBy("items", "item_at"))
    needed = F.greatest(F.lit(1), F.ceil(F.lit(min_coverage) * F.col("n_windows") - 1e-9))
    rare = places.withColumn("rank", rank).filter(F.col("rank") <= F.col("n_windows") - needed + 1).select("item_id", "item_at", "whole")
    probes = items.join(rare, ["item_id", "item_at", "whole"]).select("window", "item_id", "whole").distinct()
    candidates = hits.select("doc_id", "text_sum", "window").distinct().join(small(probes), "window").select("doc_id", "text_sum", "item_id", "whole").distinct()
    c = candidates.select(F.col("doc_id").alias("_d"), F.col("text_sum").alias("_s"), "item_id", "whole").join(small(items), ["item_id", "whole"])
    same = hits["doc_id"].eqNullSafe(c["_d"]) & (hits["text_sum"] == c["_s"]) & (hits["window"] == c["window"])
    met = hits.join(c, same).select("doc_id", "text_sum", "item_id", "whole", "doc_at", "item_at", "n_windows")
    lined = met.groupBy("doc_id", "text_sum", "item_id", "whole", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set("item_at").alias("ats"), F.first("n_windows").alias("n_windows")
    )
    pairs = lined.groupBy("doc_id", "text_sum", "item_id", "whole").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("ats")))).alias("n_matched"), F.first("n_windows").alias("n_windows"),
        F.max(F.struct(F.size("ats").alias("n"), (-F.col("shift")).alias("back"), F.array_sort("ats").alias("ats"))).alias("best"),
    )
    pairs = pairs.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).filter(F.col("coverage") >= min_coverage)
    return materialize(pairs, "pairs")


def slot_check(pairs: DataFrame, rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """pairs with n_slots, agree and verbatim, from the values at the placeholder positions of the best alignment.

    A slot fits if its document value is the most frequent one of its item value, and the other way round."""
    text = text_of(item_text_col)
    item = benchmark.select(F.col(item_col).alias("item_id"), canonical_words(text).alias("ic"), plain_words(text).alias("iw")).dropDuplicates(["item_id"])
    wanted = pairs.select(F.col("doc_id").alias("_k"), F.col("text_sum").alias("_s")).distinct()
    words = rows.select(F.col("doc_id").alias("_id"), F.col("text_sum").alias("_sum"), F.col("text").alias("_t"))
    words = words.join(wanted, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_sum") == F.col("_s")), "left_semi")
    words = words.groupBy("_id", "_sum").agg(F.max("_t").alias("_t")).select("_id", "_sum", plain_words(F.col("_t")).alias("dw"))
    p = pairs.join(words, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sum") == F.col("_sum"))).join(item, "item_id").drop("_id", "_sum")
    covered = F.array_distinct(F.flatten(F.transform(F.col("best")["ats"], lambda a: F.sequence(a, a + (WINDOW - 1)))))
    value = F.transform(covered, lambda a: F.struct(F.get(F.col("ic"), a).contains("{").alias("slot"), F.get(F.col("iw"), a).alias("i"), F.get(F.col("dw"), a - F.col("best")["back"].cast("int")).alias("d")))
    pair = ["doc_id", "text_sum", "item_id"]
    p = p.select(*pair, "n_matched", "n_windows", "coverage", F.explode_outer(F.filter(value, lambda v: v["slot"] & v["d"].isNotNull())).alias("v"))
    p = p.groupBy(*pair, "n_matched", "n_windows", "coverage", "v.i", "v.d").agg(F.count("v").alias("n"))
    best = lambda side, other: F.max(F.struct("n", other)).over(Window.partitionBy(*pair, side))[other]
    often = lambda side: F.sum("n").over(Window.partitionBy(*pair, side)) > 1
    p = p.withColumns({"to": best("i", "d"), "of": best("d", "i"), "tied": often("i") | often("d")}).withColumn("fits", F.when((F.col("to") == F.col("d")) & (F.col("of") == F.col("i")), F.col("n")).otherwise(0))
    p = p.groupBy(*pair).agg(*[F.first(c).cast("long" if c != "coverage" else "double").alias(c) for c in ("n_matched", "n_windows", "coverage")], F.sum("n").alias("n_slots"), F.sum(F.when(F.col("tied"), F.col("n"))).alias("tied"), F.sum(F.when(F.col("tied"), F.col("fits"))).alias("fits"), F.min(F.coalesce(F.col("i") == F.col("d"), F.lit(True))).alias("verbatim"))
    agree = F.when(F.col("tied") > 0, F.col("fits") / F.col("tied")).otherwise(F.lit(1.0))
    return p.select("doc_id", "item_id", "n_matched", "n_windows", "coverage", "n_slots", agree.alias("agree"), "verbatim")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """docs without the documents that leak a benchmark item; the columns stay as they are, whatever their names.

    Rows that share an id with a leaking one go with it; null texts stay; tables may be empty.
    """
    with scratch() as keep:
        bad = keep(materialize(find_leaks(docs, benchmark, id_col=id_col, **kw).select("doc_id").distinct(), "leaks"))
    return without_ids(docs, bad, id_col, "doc_id")


def op10_template_leaks(spark, sf_dir: str) -> DataFrame:
    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
