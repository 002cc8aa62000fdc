"""Operator 1: mixing sources to target weights by entropy balancing.

Every source gets a share of all tokens.  Among all rates of documents that meet the token constraints, entropy balancing takes
those nearest to the corpus as it stands (relative entropy, every document weighing one): the rate of a document of size z is
the exponential tilt exp(lambda_source * z / mean size), at most the copies allowed.  The dual is convex and has no closed form;
safeguarded Newton steps solve it, whose gradient and curvature are distributed sums over all sizes.  Rates become whole copies
by carrying the rounding error from the smallest to the largest document of a source; what is left, less than one large document,
goes to the smallest documents, so that a source misses its target by about one small document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, materialize, packed, release, scratch, text_of, unpacked, words_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3.0


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from one (source, source_size) row per source.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes; no target passes
    max_repeat times its source's size, and what that frees is shared again by weight.  In order of the ratio cap/weight the
    sources that end at their cap come first, so the final level is found by running sums instead of repeated rounds.
    The single-partition windows here read one row per source.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    s = s.withColumn("left_mass", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left_mass") / F.col("left_weight"))
    # the first source whose cap is not reached fixes the level of all that follow
    s = s.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def tilted(lam: Column, size: Column, scale: Column, max_repeat: float) -> Column:
    """The rate of a document of that size."""
    return F.exp(F.least(lam * size / scale, F.lit(math.log(max_repeat))))


def balance(cells: DataFrame, targets: DataFrame, max_repeat: float = MAX_REPEAT, tolerance: float = 1e-9, max_steps: int = 200) -> DataFrame:
    """(source, scale, lam): Newton's method on sum(n * size * rate(lam, size)) = target for every source, over (source, size, n) cells.

    A source without tokens keeps lam = 0 (rate 1), one that ends at the most copies allowed takes them all.  A step that leaves
    the interval known to hold the root halves it instead, or doubles where one side is open.  Each step sums mass and
    slope over the cells and reports one number; lam is rounded, so that the order of sums does not show.
    """
    n = cells.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("docs"))
    at_most = F.col("target") >= F.col("source_size") * (max_repeat * (1 - 1e-12))
    start = targets.join(n, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "target", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)).alias("scale"), ((F.col("source_size") > 0) & ~at_most).alias("free"),
        F.when(F.col("source_size") <= 0, 0.0).when(at_most, 1e12).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("lam"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
    )
    state = materialize(start, "dual")
    for _ in range(max_steps):
        known = F.broadcast(state.withColumnRenamed("source", "s"))  # one row per source
        rate = tilted(F.col("lam"), F.col("size"), F.col("scale"), max_repeat)
        part = F.col("n") * F.col("size") * rate
        sums = cells.join(known, F.col("source").eqNullSafe(F.col("s"))).filter("free").groupBy("s").agg(
            F.sum(part).alias("mass"), F.sum(F.when(rate < max_repeat * (1 - 1e-12), part * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope")
        )
        d = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        over = F.col("mass") > F.col("target")
        d = d.withColumns({"miss": F.coalesce(F.abs(F.col("mass") / F.col("target") - 1), F.lit(0.0)), "lo": F.when(over, F.col("lo")).otherwise(F.col("lam")), "hi": F.when(over, F.col("lam")).otherwise(F.col("hi"))})
        step = F.col("lam") - (F.col("mass") - F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (F.col("lo").isNull() | (step > F.col("lo"))) & (F.col("hi").isNull() | (step < F.col("hi")))
        else_ = F.when(F.col("lo").isNull(), F.least("hi", F.lit(0.0)) * 2 - 1).when(F.col("hi").isNull(), F.greatest("lo", F.lit(0.0)) * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        new = d.select("source", "target", "scale", "free", F.when(F.col("miss") <= tolerance, F.col("lam")).when(inside, step).otherwise(else_).alias("lam"), "lo", "hi", "miss")
        new = materialize(new, "dual")
        release(state)
        miss, state = new.agg(F.max("miss")).first()[0], new.drop("miss")
        if miss is None or miss <= tolerance:
            return new.select("source", "scale", F.round("lam", 9).alias("lam"))
    raise RuntimeError(f"a source still misses its target by {miss} after {max_steps} steps")


#: Cells (distinct pairs of source and size, about 60 bytes each) up to which the plan is broadcast; beyond it the join shuffles.
BROADCAST_CELLS = 200_000
DRAW_BITS = 53


def _draw(id_col) -> Column:
    """A number from 0 to 2**53 that depends on the id alone."""
    return F.shiftrightunsigned(F.xxhash64(id_col, F.lit("mix")), 64 - DRAW_BITS)


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, rows): one unit per distinct id, source and number of words."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words_of(text_of(text_col))).cast("long").alias("size")
    )
    return materialize(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "units")


def _settle(cells: DataFrame) -> DataFrame:
    """cells with total copies moved within low..high, the smallest documents first, by what their source misses its target by."""
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    c = cells.withColumn("miss", F.col("target") - F.sum(F.col("per") * F.col("total")).over(Window.partitionBy("source")))
    free = F.when(F.col("per") <= 0, 0).when(F.col("miss") < 0, F.col("total") - F.col("low")).otherwise(F.col("high") - F.col("total"))
    c = c.withColumn("free", free).withColumn("used", F.sum(F.col("free") * F.col("per")).over(by_size) - F.col("free") * F.col("per"))
    moved = F.when(F.col("free") > 0, F.greatest(F.lit(0), F.least(F.col("free"), F.round((F.abs("miss") - F.col("used")) / F.col("per"))))).otherwise(0)
    return c.withColumn("total", (F.col("total") + F.signum("miss") * moved).cast("long")).drop("miss", "free", "used")


def mixing_plan(units: DataFrame, weights: tuple = WEIGHTS, max_repeat: float = MAX_REPEAT, rank_block: int = 20_000) -> DataFrame:
    """(s, z, source_size, target, whole, bound) per source and size: a document takes whole copies, and one more if its draw is
    at most bound.

    Null and blank texts have size 0; null sources form one source; rows that repeat an id with the same source and size are
    one unit and get the same number of copies.  An empty table gives no rows.  Draws are hashes of ids: reruns agree.
    Documents of one cell are ranked in hash blocks of about rank_block, so no cell is sorted in a single task.
    """
    cells = materialize(units.groupBy("source", "size").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("units")), "cells")
    targets = materialize(source_targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, max_repeat), "targets")
    lam = balance(cells, targets, max_repeat)
    rates = targets.join(lam.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "source_size", "target", "scale", "lam")
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.join(rates, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cells = cells.withColumn("rate", F.least(F.round(tilted(F.col("lam"), F.col("size"), F.col("scale"), max_repeat), 9), F.lit(float(max_repeat))))
    whole = F.floor("rate") * F.col("units")
    cells = cells.withColumn("upto", F.sum((F.col("rate") - F.floor("rate")) * F.col("units")).over(by_size))
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy("size")), F.lit(0.0))
    even = F.floor(F.col("upto") + 0.5) - F.floor(before + 0.5)
    cells = cells.withColumn("even", F.greatest(F.lit(0), F.least(even, F.col("units"))))
    even = F.col("even")
    cells = cells.withColumns({"per": F.col("size") * F.col("n") / F.col("units"), "low": whole, "high": whole + F.when(F.col("rate") < max_repeat, F.col("units")).otherwise(0), "total": whole + even})
    # what whole copies miss by (less than a large document) goes to the smallest documents, first to those that can take or give
    # one copy, then, in sources of a few documents, to any that stay between none and the most copies
    cells = _settle(cells)
    cells = _settle(cells.withColumns({"low": F.lit(0), "high": F.col("units") * int(max_repeat)}))
    taken = cells.select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("units").alias("cell_units"), "source_size", "target",
        F.floor(F.col("total") / F.col("units")).alias("whole"), F.pmod(F.col("total"), F.col("units")).cast("long").alias("extra"),
    )
    cells = materialize(taken, "cells")
    here = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    some = units.join(cells.filter("extra > 0 and extra < cell_units"), here).withColumn("draw", _draw(F.col("doc_id")))
    some = some.withColumn("block", F.floor(F.col("draw") / F.lit(float(1 << DRAW_BITS)) * F.ceil(F.col("cell_units") / F.lit(rank_block))))
    key = ["s", "z", "block"]
    blocks = some.groupBy(*key).agg(F.count(F.lit(1)).alias("in_block"))
    ahead = F.sum("in_block").over(Window.partitionBy("s", "z").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_block")
    blocks = blocks.select(F.col("s").alias("bs"), F.col("z").alias("bz"), F.col("block").alias("bb"), ahead.alias("ahead"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("draw", "doc_id"))
    same = F.col("s").eqNullSafe(F.col("bs")) & (F.col("z") == F.col("bz")) & (F.col("block") == F.col("bb"))
    taken = some.withColumn("rank", rank).join(blocks, same).filter(F.col("rank") + F.col("ahead") <= F.col("extra"))
    last = taken.groupBy(F.col("s").alias("ls"), F.col("z").alias("lz")).agg(F.max("draw").alias("last"))
    bound = F.when(F.col("extra") >= F.col("cell_units"), F.lit(1 << DRAW_BITS)).otherwise(F.coalesce("last", F.lit(-1)))
    plan = cells.join(last, F.col("s").eqNullSafe(F.col("ls")) & (F.col("z") == F.col("lz")), "left")
    return materialize(plan.select("s", "z", "source_size", "target", F.col("whole").cast("long").alias("whole"), bound.cast("long").alias("bound")), "plan")


def with_copies(sized: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size") -> DataFrame:
    """sized with the plan's columns and copies.  A plan of few cells goes to every task, so that no text moves."""
    few = plan.count() <= BROADCAST_CELLS
    on = F.col(source_col).eqNullSafe(F.col("s")) & (F.col(size_col) == F.col("z"))
    both = sized.join(F.broadcast(plan) if few else plan, on)
    return both.withColumn("copies", F.col("whole") + F.when(_draw(F.col(id_col)) <= F.col("bound"), 1).otherwise(0)).drop("s", "z", "whole", "bound")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """docs with each row repeated as often as the plan says (not at all where it takes none); the columns stay as they are,
    whatever their names.

    Documents of no words (null texts among them) carry no tokens of any source and stay once.  Null sources are one source;
    rows that repeat an id, a source and a size get equal copies; an empty table gives no rows.
    """
    with scratch() as keep:
        plan = keep(mixing_plan(document_sizes(docs, id_col, text_col, source_col), **kw))
    d = packed(docs, doc_id=F.col(id_col), source=F.col(source_col), size=F.size(words_of(text_of(text_col))).cast("long"))
    taken = with_copies(d, plan)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int")
    taken = taken.withColumn("times", times).filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return unpacked(taken, docs.columns)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    units = document_sizes(load(spark, sf_dir, "documents"))
    with scratch() as keep:
        plan = keep(mixing_plan(units))
    rows = with_copies(units, plan).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rows.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies")
