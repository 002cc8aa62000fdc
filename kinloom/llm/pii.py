"""Operator 2: personal data by candidate gradient boosting.

High-recall patterns propose spans that may overlap.  The exact base kinds pass their checks and always stay.  What is known of a
candidate comes from a view that the model does not see: its check, a checked span of another kind around it, or a cue word
before it.  Boosted trees of depth 2 over format and context features learn from these positive marks among unmarked candidates;
since marks are found on a share of the true spans only, scores are divided by the mean score of marked candidates in texts that
were not fitted (learning from positive and unlabelled examples).  A threshold per kind, set on those other texts where the
estimated precision reaches its aim, selects further spans, with or without a cue.  All statistics come from every
candidate of the corpus: feature vectors have few values each, so their counts form a table of bounded size for the trees.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, materialize, packed, running_totals, scratch, text_of, unpacked

#: (kind, pattern, cheap test that a text can hold it).  The first four are the fixed base kinds, in their fixed order.
#: "\G" lets a match begin where the last one ended; else it begins where its run of characters begins, which is where the
#: leftmost match begins anyway and keeps the search linear in runs of any length.
GENERATORS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "[0-9]\\.[0-9]"),
    ("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", "[0-9][\\x20-]?[0-9]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]"),
    ("secret", r"(?:\G|(?<![A-Za-z0-9_]))(?=[A-Za-z_-]{0,40}[0-9])[A-Za-z0-9_-]{20,}+", "[0-9]"),
    ("number", r"(?:\G|(?<![0-9(]))\(?[0-9](?:[\x20().-]{0,2}[0-9])++", "[0-9][\\x20().-]{0,2}[0-9]"),
    ("ip6", r"(?:\G|(?<![0-9A-Fa-f:]))[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){4,7}", "[0-9A-Fa-f]:[0-9A-Fa-f:]"),
)
KINDS = [k for k, _, _ in GENERATORS]
BASE = 4
#: Words before a span that mark it as one of its kind.  Trees do not see them.
CUES = {4: "secret|token|passw|api|key|bearer", 5: "phone|tel|call|fax|mobile|contact|card|visa|account|credit|iban", 6: r"\b(?:ip|ipv6|addr|address|host)\b"}
#: Feature -> number of values; their product bounds the table that comes to the driver.
FEATURES = {"kind": 7, "digits": 7, "joins": 3, "letters": 4, "edge": 4, "after": 4, "length": 4, "company": 3}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    unit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    term = lambda i: F.when(i % 2 == 1, unit(i)).otherwise(unit(i) * 2 - F.when(unit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def base_valid(kind: Column, value: Column) -> Column:
    """The fixed checks of the base kinds; other kinds never pass them."""
    digits = _digits(value)
    n = F.length(digits)
    small = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255)
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, F.forall(F.split(value, r"\."), small))
        .when(kind == 2, F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == 3, (n >= 10) & (n <= 15))
        .otherwise(F.lit(False))
    )


def _bucket(value: Column, bounds: list[int]) -> Column:
    out = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        out = F.when(value < b, i).otherwise(out)
    return out


def _side(char: Column) -> Column:
    return F.when(F.length(char) == 0, 0).when(char.rlike(r"\s"), 0).when(char.rlike("[\"'=:]"), 1).when(char.rlike("[A-Za-z0-9]"), 2).otherwise(3)


def _refuted(c: Column) -> Column:
    """An address or a number of a card's length that fails its check."""
    n = F.length(_digits(c["value"]))
    return ((c["kind"] == 1) | ((c["kind"] == 2) & (n >= 14) & (n <= 19))) & ~base_valid(c["kind"], c["value"])


def _checked(c: Column) -> Column:
    """A proposal with its check and cue."""
    cue = F.lit(False)
    for kind, pattern in CUES.items():
        cue = cue | ((c["kind"] == kind) & c["before"].rlike(pattern))
    return F.struct(*[c[x].alias(x) for x in ("start", "end", "kind", "value", "before", "after")], base_valid(c["kind"], c["value"]).alias("valid"), _refuted(c).alias("refuted"), cue.alias("cue"))


def _features(base: Column) -> Callable:
    """The features of a checked proposal, and marked: what is known of it from outside of them."""

    def of(c: Column) -> Column:
        value = c["value"]
        around = F.exists(base, lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"]) & (10 * (c["end"] - c["start"]) >= 6 * (b["end"] - b["start"])))
        other = F.size(F.filter(base, lambda b: (b["end"] <= c["start"]) | (c["end"] <= b["start"])))
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"),
            _bucket(F.length(_digits(value)), [7, 10, 12, 14, 17, 20]).alias("digits"),
            F.when(value.rlike("[().-]"), 2).when(value.contains(" "), 1).otherwise(0).alias("joins"),
            F.when(value.rlike("[g-zG-Z]"), F.when(value.rlike("[A-Z]"), 3).otherwise(2)).when(value.rlike("[A-Fa-f]"), 1).otherwise(0).alias("letters"),
            _side(F.right(c["before"], F.lit(1))).alias("edge"), _side(c["after"]).alias("after"),
            _bucket(F.length(value), [12, 20, 32]).alias("length"), F.least(other, F.lit(2)).alias("company"),
            F.when(c["refuted"], -1).otherwise(c["valid"].cast("int")).alias("valid"),
            F.when(c["kind"] < BASE, c["valid"]).otherwise(c["cue"] | ((c["kind"] == 5) & around)).cast("int").alias("marked"),
        )

    return of


def _proposal(kind: int) -> Callable:
    return lambda m, t: F.struct((t["end"] - F.length(m)).alias("start"), t["end"].alias("end"), F.lit(kind).alias("kind"), m.alias("value"), t["before"].alias("before"), t["after"].alias("after"))


def candidates(docs: DataFrame, text: Column) -> DataFrame:
    """docs (whose columns must not begin with _) plus _cands: all proposals with offsets in code points (end exclusive) and their features."""
    none = F.array().cast("array<string>")
    d = docs
    for name, pattern, quick in GENERATORS:
        may = text.contains(quick) if name == "email" else text.rlike(quick)
        d = d.withColumns({f"_f_{name}": F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)})
    for name, pattern, _ in GENERATORS:
        d = d.withColumn(f"_g_{name}", F.when(F.size(f"_f_{name}") > 0, F.split(text, pattern, -1)).otherwise(none))
    ends = {}
    for name in KINDS:
        f, g = f"_f_{name}", f"_g_{name}"
        both = F.zip_with(F.col(f), F.slice(g, 1, F.size(f)), lambda m, gap: F.length(m) + F.length(gap))
        ends[f"_e_{name}"] = F.when(F.size(f) > 0, running_totals(both)).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumns(ends)
    made = []
    for k, name in enumerate(KINDS):
        gaps = F.zip_with(F.slice(f"_g_{name}", 1, F.size(f"_f_{name}")), F.slice(f"_g_{name}", 2, F.size(f"_f_{name}")), lambda x, y: F.struct(F.lower(F.right(x, F.lit(24))).alias("before"), F.left(y, F.lit(1)).alias("after")))
        tail = F.zip_with(gaps, F.col(f"_e_{name}"), lambda gap, end: F.struct(gap["before"].alias("before"), gap["after"].alias("after"), end.alias("end")))
        made.append(F.zip_with(F.col(f"_f_{name}"), tail, _proposal(k)))
    d = d.withColumn("_raw", F.concat(*made)).drop(*[f"_{x}_{n}" for x in "fge" for n in KINDS])
    d = d.withColumn("_raw", F.transform("_raw", _checked))
    d = d.withColumn("_base", F.transform(F.filter("_raw", lambda c: c["valid"]), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    return d.withColumn("_cands", F.transform("_raw", _features(F.col("_base")))).drop("_raw", "_base")


def grow_trees(cells: np.ndarray, n: np.ndarray, pos: np.ndarray, rounds: int = 24, rate: float = 0.4) -> tuple[float, list]:
    """Logistic boosting with trees of depth 2 over (features, n, positives) cells: bias and [(split, (left, right))...].

    A tree is (feature, bound, left, right), with a number for a leaf; rows with feature < bound go left.
    """
    bias = math.log((pos.sum() + 1) / (n.sum() - pos.sum() + 1))
    margin, trees = np.full(len(n), bias), []

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        found = (1e-9, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f, top in enumerate(FEATURES.values()):
            for b in range(1, top):
                left = rows & (cells[:, f] < b)
                right = rows & ~left
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - whole
                if gain > found[0] + 1e-9:
                    found = (gain, (f, b))
        return found[1]

    def build(rows: np.ndarray, depth: int, g: np.ndarray, h: np.ndarray):
        split = best(rows, g, h) if depth else None
        if split is None:
            return round(float(rate * g[rows].sum() / (h[rows].sum() + 1)), 6)
        f, b = split
        left = rows & (cells[:, f] < b)
        return (f, b, build(left, depth - 1, g, h), build(rows & ~left, depth - 1, g, h))

    def apply(tree, rows: np.ndarray) -> None:
        if isinstance(tree, float):
            margin[rows] += tree
        else:
            f, b, left, right = tree
            apply(left, rows & (cells[:, f] < b))
            apply(right, rows & (cells[:, f] >= b))

    every = np.ones(len(n), bool)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = build(every, 2, pos - n * p, n * p * (1 - p))
        trees.append(tree)
        apply(tree, every)
    return bias, trees


def margin_of(bias: float, trees: list, feature: Callable):
    """Sum of the trees over a candidate, for a Column or for plain numbers."""

    def walk(tree):
        if isinstance(tree, float):
            return F.lit(tree)
        f, b, left, right = tree
        return F.when(feature(f) < b, walk(left)).otherwise(walk(right))

    out = F.lit(bias)
    for t in trees:
        out = out + walk(t)
    return out


@dataclass
class Model:
    """Trees, and per kind the threshold of the margin and what the texts that were not fitted say of it."""

    bias: float
    trees: list
    thresholds: list[float]
    #: kind -> (candidates, marked, selected, estimated precision, recall of marked ones), on the texts that were not fitted.
    report: dict[str, tuple]


def fit(found: DataFrame, precision: float = 0.9) -> Model:
    """Fitted on one half of the texts and calibrated on the other, from the counts of all candidate feature vectors.

    found: _cands and half (0 or 1; equal texts in one half).  A kind without marked candidates in either half, or whose
    scores never reach the precision, gets an infinite threshold; so do the base kinds, which are settled by their checks.
    """
    names = list(FEATURES)
    rows = found.select("half", F.explode("_cands").alias("c")).select("half", *[F.col("c")[x].alias(x) for x in names], "c.marked").groupBy("half", *names)
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("marked").alias("pos")).orderBy("half", *names).collect()
    none = [math.inf] * len(KINDS)
    if not rows:
        return Model(0.0, [], none, {})
    half = np.array([r["half"] for r in rows])
    cells = np.array([[r[x] for x in names] for r in rows])
    n, pos = np.array([r["n"] for r in rows], float), np.array([r["pos"] for r in rows], float)
    if not (half == 0).any() or not (half == 1).any():
        return Model(0.0, [], none, {})
    bias, trees = grow_trees(cells[half == 0], n[half == 0], pos[half == 0])

    def value(row) -> float:
        total = bias
        for t in trees:
            while not isinstance(t, float):
                t = t[2] if row[t[0]] < t[1] else t[3]
            total += t
        return total

    margins = np.array([value(r) for r in cells])
    score = 1 / (1 + np.exp(-margins))
    thresholds, report = list(none), {}
    for k in range(BASE, len(KINDS)):
        mine = np.flatnonzero((cells[:, 0] == k) & (half == 1))
        marked = pos[mine].sum()
        if not marked or not pos[(cells[:, 0] == k) & (half == 0)].sum():
            report[KINDS[k]] = (int(n[mine].sum()), int(marked), 0, 0.0, 0.0)
            continue
        share = max(1e-6, float((score[mine] * pos[mine]).sum() / marked))  # of true spans that are marked
        right = seen = held = 0.0
        best = (0.0, 0.0, 0.0)
        for m in sorted(set(margins[mine]), reverse=True):
            level = mine[margins[mine] == m]
            held, seen = held + pos[level].sum(), seen + n[level].sum()
            right += (n[level] * np.minimum(1, score[level] / share)).sum()
            # both what the model expects and what the marks of these texts say must reach the aim
            says = min(right / seen, min(1.0, held / seen / share))
            if says >= precision:
                thresholds[k], best = float(m) - 1e-6, (seen, says, held / marked)
        report[KINDS[k]] = (int(n[mine].sum()), int(marked), int(best[0]), float(best[1]), float(best[2]))
    return Model(bias, trees, thresholds, report)


def find_pii(docs: DataFrame, text_col: str = "text", precision: float = 0.9, keep: tuple = ()) -> DataFrame:
    """keep columns plus _spans, sorted (start, kind, end, base) structs: the base spans and those the trees add.

    Null and empty texts have no spans; repeated rows are treated alike; tables may be empty and their columns have any names
    (a column _spans in keep is replaced).  A span that the trees add overlaps neither a base one nor an address or card
    number that failed its check.
    """
    with scratch() as hold:
        names = [c for c in keep if c != "_spans"]
        row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None).cast("string")
        text = text_of(text_col)
        d = docs.select(row.alias("row"), text.alias("text"), F.xxhash64(text).bitwiseAND(F.lit(1)).alias("half"))
        found = materialize(candidates(d, F.col("text")).drop("text"), "candidates")
        model = fit(found, precision)
        found = found.withColumn("_base", F.filter("_cands", lambda c: c["valid"] == 1))

        def chosen(c: Column) -> Column:
            limit = F.get(F.array(*[F.lit(min(t, 1e9)) for t in model.thresholds]), c["kind"])
            free = ~F.exists(F.col("_cands"), lambda b: (b["valid"] != 0) & (b["start"] < c["end"]) & (c["start"] < b["end"]))
            return (c["kind"] >= BASE) & (margin_of(model.bias, model.trees, lambda f: c[list(FEATURES)[f]]) >= limit) & free

        extra = F.filter("_cands", chosen)
        shape = lambda is_base: lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), F.lit(is_base).alias("base"))
        spans = F.array_sort(F.concat(F.transform("_base", shape(True)), F.transform(extra, shape(False))))
        return hold(materialize(unpacked(found, names, _spans=spans), "spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; where spans overlap the first one names the gap."""
    name = lambda s: F.get(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind"])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    piece = lambda a, s: F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], piece(a, s), name(s)).alias("out"))).otherwise(
        F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
    )
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))


def redact_documents(docs: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """docs with the found spans of the text replaced; null texts stay null, equal rows are changed alike."""
    d = packed(docs, text=F.col(text_col))
    found = find_pii(d, "text", keep=("row", "text"), **kw)
    clean = F.when(F.size("_spans") > 0, redact(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    return unpacked(found, docs.columns, **{text_col: clean}).select(*[f"`{c}`" for c in docs.columns])


def _is_base(kind: int) -> Callable:
    return lambda s: s["base"] & (s["kind"] == kind)


def op2_pii_boosting(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, keep=("doc_id",))
    label = lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    listed = lambda spans: F.array_join(F.transform(spans, label), ",")
    only = F.filter("_spans", lambda s: s["base"])
    counts = {f"n_{KINDS[k]}": F.size(F.filter("_spans", _is_base(k))).cast("long") for k in range(BASE)}
    out = found.withColumns(counts | {"base_sha256": F.sha2(listed(only), 256), "spans": listed(F.col("_spans")), "n_added": (F.size("_spans") - F.size(only)).cast("long")})
    return out.drop("_spans")
