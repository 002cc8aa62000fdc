"""Operator 13: how filters interact, from sorted posting lists.

Every filter keeps, per part of the corpus and range of ids, the sorted list of documents that fail it.  What a filter removes after
others is the difference of its list and the union of theirs, so all orders of the filters follow from the unions of the 32 sets of
filters and 80 differences.  A task takes ranges of ids in order and merges their lists: the shorter list is searched in the longer
one, which skips the stretches between its ids.  Sizes are summed over the ranges; no list leaves its range.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, load, materialize, scratch, text_of

FILTERS = "ABCDE"
#: Ids of a range, which keeps a large part from one task, and entries whose lists a task holds at a time.
RANGE, HELD = 1 << 12, 1 << 18


def failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that looks at the text alone; words are separated by white space.

    A: under 50 words; B: distinct words under 65 % of the words; C: capitals A to Z over 5 % of the code points; D: holds one of #$%&*|.
    """
    words = F.array_remove(F.split(text, SPACE), "")
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 50, "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]"),
    }


def failing_entries(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, range, id, fails, good, toxic, n): documents of equal id and verdicts, with the bits of the filters they fail."""
    text = text_of(text_col)
    bits = [F.when(test, 1 << k).otherwise(0) for k, test in enumerate(failures(text).values())]
    d = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), sum(bits[1:], bits[0]).alias("fails"),
        F.unhex(F.sha2(text, 256)).alias("sum"),
    )
    d = materialize(d, "verdicts")
    first = d.groupBy("sum").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("sum", "low")
    d = d.join(first, "sum", "left").withColumn("fails", F.when(F.col("id") > F.col("low"), F.col("fails") + 16).otherwise(F.col("fails")))
    known = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    d = d.join(known, F.col("id") == F.col("label_id"), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    return d.groupBy("part", F.floor(F.col("id") / RANGE).alias("range"), "id", "fails", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def among(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Places in the sorted list many of those ids of the sorted list few that it holds, by searching each from the list's middle on."""
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    return at[many[at] == few] if len(many) else at[:0]


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sorted list a without the ids of the sorted list b; the shorter one is searched in the longer one."""
    gone = np.zeros(len(a), bool)
    if len(b) <= len(a):
        gone[among(b, a)] = True
    elif len(a):
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        gone = b[at] == a
    return a[~gone]


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sorted list of the ids of both sorted lists."""
    new = difference(b, a)
    return np.insert(a, np.searchsorted(a, new), new)


def interactions(entries: DataFrame) -> DataFrame:
    """(part, filter, earlier, total, fails, gone, removed, good, toxic): for each filter and set of earlier filters (bits), documents
    of the part, that fail the filter, that fail it or an earlier one, and that it alone removes then; of these good and toxic ones."""
    lists = len(FILTERS)

    def merge(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        part, code = np.unique(t.column("part").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        fails, good, toxic, n = (t.column(c).to_numpy() for c in ("fails", "good", "toxic", "n"))
        size = lambda ids, w: np.bincount(code[ids], weights=w[ids], minlength=len(part)).astype(np.int64)
        posting = [np.flatnonzero(fails >> k & 1) for k in range(lists)]
        unions = [np.zeros(0, np.int64)]
        for s in range(1, 1 << lists):
            top = s.bit_length() - 1
            unions.append(union(unions[s ^ (1 << top)], posting[top]))
        gone, total = [size(u, n) for u in unions], size(np.arange(len(n)), n)
        for k in range(lists):
            own = size(posting[k], n)
            for s in range(1 << lists):
                if not s >> k & 1:
                    left = difference(posting[k], unions[s])
                    numbers = (total, own, gone[s | 1 << k], size(left, n), size(left, n * good), size(left, n * toxic))
                    yield pa.RecordBatch.from_arrays([pa.array(part.tolist()), pa.array([k] * len(part), pa.int32()), pa.array([s] * len(part), pa.int32()), *map(pa.array, numbers)], names)

    names = ["part", "filter", "earlier", "total", "fails", "gone", "removed", "good", "toxic"]

    def ranges(batches):
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= HELD:
                yield from merge(held)
                held, rows = [], 0
        if held:
            yield from merge(held)

    d = entries.repartition("part", "range").sortWithinPartitions("part", "range", "id", "fails", "good", "toxic")
    found = d.mapInArrow(ranges, "part string, filter int, earlier int, " + ", ".join(f"{c} long" for c in names[3:]))
    return found.groupBy("part", "filter", "earlier").agg(*[F.sum(c).alias(c) for c in names[3:]])


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters (filter_order) and step (1 to 5): the documents of the part that are kept after the step, removed in
    it, redundant (fail its filter but went before), fail only its filter (unique_fails), removed and good or toxic by the labels (good_lost,
    toxic_lost), and the filter's removals summed over all orders (shapley).  Zeros are included.

    E: a smaller id has the same text.  Null texts are empty, null parts are the part ''; rows without an id fail E never, and have no
    labels.  Rows that share an id are documents of their own; a document is good or toxic if any of its label rows says so.  labels: doc_id,
    quality and toxic.  Columns of other names do not matter.  Without documents there are no parts; without labels nothing is good or toxic.
    """
    orders = [("".join(FILTERS[k] for k in p), i + 1, p[i], sum(1 << k for k in p[:i])) for p in permutations(range(len(FILTERS))) for i in range(len(FILTERS))]
    steps = docs.sparkSession.createDataFrame(orders, "filter_order string, step int, filter int, earlier int")  # 600 rows, whatever the input
    with scratch() as keep:
        sums = keep(materialize(interactions(failing_entries(docs, labels, id_col, text_col, part_col)), "interactions"))
    before = F.bit_count("earlier")
    ways = F.lit(0)
    for k in range(len(FILTERS)):
        ways = F.when(before == k, factorial(k) * factorial(len(FILTERS) - 1 - k)).otherwise(ways)
    alone = F.max(F.when(before == len(FILTERS) - 1, F.col("removed")))
    each = sums.groupBy("part", "filter").agg(F.sum(ways * F.col("removed")).alias("shapley"), alone.alias("unique_fails"))
    d = sums.join(each, ["part", "filter"]).join(F.broadcast(steps), ["filter", "earlier"])
    return d.select(
        "part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit_filters(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


#: The same counts from each document's verdicts alone, without lists.
OP13_SQL = r"""
with t as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), f as (
  select doc_id, part, case when len(w) < 50 then 1 else 0 end
    + case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) then 4 else 0 end
    + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
    + case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end as fails from t
), l as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), c as (
  select part, fails, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join l on f.doc_id = l.doc_id group by part, fails
), o as (
  select a.c || b.c || d.c || e.c || g.c as filter_order, [a.b, b.b, d.b, e.b, g.b] as bits
  from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) a(c, b), (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) b(c, b),
    (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) d(c, b), (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) e(c, b),
    (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) g(c, b)
  where a.b | b.b | d.b | e.b | g.b = 31
), s as (
  select filter_order, cast(unnest(range(1, 6)) as integer) as step, bits from o
), x as (
  select filter_order, step, bits[step] as own, cast(coalesce(list_sum(bits[1:step - 1]), 0) as bigint) as earlier from s
), r as (
  select part, filter_order, step, own,
    sum(case when fails & (own | earlier) = 0 then n else 0 end) as kept,
    sum(case when fails & own > 0 and fails & earlier = 0 then n else 0 end) as removed,
    sum(case when fails & own > 0 and fails & earlier > 0 then n else 0 end) as redundant,
    sum(case when fails = own then n else 0 end) as unique_fails,
    sum(case when fails & own > 0 and fails & earlier = 0 then good else 0 end) as good_lost,
    sum(case when fails & own > 0 and fails & earlier = 0 then toxic else 0 end) as toxic_lost
  from c, x group by part, filter_order, step, own
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, own) as bigint) as shapley
from r
"""
