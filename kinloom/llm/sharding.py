"""Operator 6: sharding by histogram sort.

Rows are ordered by a 62-bit key: 38 bits of a hash of the text, then 24 bits of a hash of the id, so equal texts stand
together and yet a group of copies of any size can be cut.  Candidate boundaries are refined in rounds: each round counts
the exact bytes below a set of probes in one map-side combined aggregation, and the driver sees only those counts.  A splitter
that falls into one key, which rows of equal id and text share, cuts the rows of that key by their number.  When every splitter is
within the tolerance the rows move once, to their part of a cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import binary_case, load, materialize, packed, scratch, text_of, unpacked

KEY_END = 1 << 62
#: Bytes that a task sorts at a time, as far as keys are spread evenly, and parts of a cell at most.
PART_BYTES, MOST_PARTS = 64 << 20, 4096
#: Rows of one key that a task numbers at a time.
RANK_BLOCK = 20_000


def shard_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text_of(text_col)), 26), 24)
    return high.bitwiseOR(F.xxhash64(F.col(id_col)).bitwiseAND(F.lit((1 << 24) - 1)))


def find_splitters(
    keys: DataFrame, parts: int, tolerance_bytes: float | None = None, tolerance: float = 0.001, probes: int = 4096, max_rounds: int = 32
) -> list[tuple[int, int]]:
    """parts - 1 ascending (key, rows) that cut the (k, size) rows of keys into parts of near equal bytes: lower keys, and so
    many rows of that key, stand below.

    A splitter is final when the bytes below it are within the tolerance of its share; where one key alone remains, its rows,
    of equal size, are cut by number.  At most about 2 * probes counts reach the driver in a round, whatever the input.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [(KEY_END, 0)] * (parts - 1)
    allowed = tolerance_bytes if tolerance_bytes is not None else tolerance * total / parts
    aims = [total * i / parts for i in range(1, parts)]
    open_: dict[int, tuple[int, int, int]] = {i: (0, KEY_END, 0) for i in range(parts - 1)}  # lo, hi, bytes below lo
    final: dict[int, tuple[int, int]] = {}
    for _ in range(max_rounds):
        spans = sorted({(lo, hi) for lo, hi, _ in open_.values()})
        per = max(2, probes // len(spans))
        steps = [max(1, -(-(hi - lo) // per)) for lo, hi in spans]
        at = binary_case(F.col("k"), [lo for lo, _ in spans[1:]])
        of = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("at"))
        counted = (
            keys.select("k", "size", at.alias("at"))
            .select("k", "size", "at", of([lo for lo, _ in spans]).alias("lo"), of([hi for _, hi in spans]).alias("hi"), of(steps).alias("step"))
            .filter((F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")))
            .groupBy("at", F.expr("(k - lo) div step").alias("bin"))
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("k").alias("low"), F.max("k").alias("high"))
            .collect()
        )
        bins: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r["at"], r["bin"])):
            bins.setdefault(r["at"], []).append(r)
        for i, (lo, hi, below) in list(open_.items()):
            held = bins.get(spans.index((lo, hi)), [])
            for r in held:
                if below + r["bytes"] >= aims[i] or r is held[-1]:
                    miss_low, miss_high = aims[i] - below, abs(below + r["bytes"] - aims[i])
                    if min(miss_low, miss_high) <= allowed:
                        final[i] = (r["low"], 0) if miss_low <= miss_high else (r["high"] + 1, 0)
                    elif r["low"] == r["high"]:
                        left = round(miss_low * r["rows"] / r["bytes"])
                        final[i] = (r["low"], left) if left < r["rows"] else (r["high"] + 1, 0)
                    else:
                        open_[i] = (r["low"], r["high"] + 1, below)
                        break
                    del open_[i]
                    break
                below += r["bytes"]
        if not open_:
            return sorted(final.values())
    raise RuntimeError(f"{len(open_)} boundaries did not settle in {max_rounds} rounds")


def shard_documents(
    docs: DataFrame, n_shards: int = 16, cells_per_shard: int = 8, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs plus shard_bytes (UTF-8 bytes of the text + 1), text_crc32, shard and slot, which replace columns of these names.

    Shards hold near equal bytes; slots number the rows of a shard from 0 without gaps.  Every shard is made of
    cells_per_shard cells of near equal bytes, a cell of parts of about PART_BYTES, and rows are sorted and numbered by part, so
    that no task holds a shard.  Null texts count as empty.  Rows that agree in text and id can be exchanged: a large group of
    them is cut by number.  Tables with fewer rows than shards leave shards empty; an empty table gives no rows.
    """
    text = text_of(text_col)
    n_cells = n_shards * cells_per_shard
    d = packed(docs, id=F.col(id_col), k=shard_key(id_col, text_col), size=(F.octet_length(text) + 1).cast("long"), crc=F.crc32(text))
    with scratch() as keep:
        keys = materialize(d.select("k", "size"), "keys")
        cuts = find_splitters(keys, n_cells, tolerance=tolerance * cells_per_shard)
        total = keys.agg(F.sum("size")).first()[0] or 0
        parts = max(1, min(MOST_PARTS, math.ceil(total / n_cells / PART_BYTES)))
        cut_keys = sorted({k for k, rows in cuts if rows})
        lows, highs = [0, *[k for k, _ in cuts]], [*[k for k, _ in cuts], KEY_END]
        of = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("cell"))
        within = F.floor((F.col("k") - of(lows)) / F.greatest(of(highs) - of(lows), F.lit(1)) * parts).cast("long")

        def placed(some: DataFrame) -> DataFrame:
            return some.withColumn("cell", binary_case(F.col("k"), [k for k, _ in cuts])).withColumn("part", within if parts > 1 else F.lit(0).cast("long"))

        plain = ~F.col("k").isin(cut_keys) if cut_keys else F.lit(True)
        rows, counts = placed(d.filter(plain)), placed(keys.filter(plain)).groupBy("cell", "part").count()
        if cut_keys:
            hot = keep(materialize(_numbered(d.filter(F.col("k").isin(cut_keys)), keys.filter(F.col("k").isin(cut_keys))), "cut-rows"))
            cell = F.lit(None).cast("int")
            for k in cut_keys:
                at = F.lit(sum(other < k or (other == k and not rows_) for other, rows_ in cuts))
                for own, rows_ in cuts:
                    if own == k and rows_:
                        at = at + (F.col("rank") >= rows_).cast("int")
                cell = F.when(F.col("k") == k, at).otherwise(cell)
            # behind the other rows of their cell
            hot = hot.withColumn("cell", cell).withColumn("part", parts + F.floor(F.col("rank") / RANK_BLOCK)).drop("rank")
            rows, counts = rows.unionByName(hot), counts.unionByName(hot.groupBy("cell", "part").count())
        ahead = Window.partitionBy(F.floor(F.col("cell") / cells_per_shard)).orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, 0)
        offsets = counts.groupBy("cell", "part").agg(F.sum("count").alias("n")).select("cell", "part", (F.sum("n").over(ahead) - F.col("n")).alias("ahead"))
        offsets = keep(materialize(offsets, "offsets"))
    order = Window.partitionBy("cell", "part").orderBy("k", F.col("id").asc_nulls_first())
    numbered = rows.withColumn("in_part", F.row_number().over(order) - 1)
    # one row per part: n_cells * MOST_PARTS at most, besides one per RANK_BLOCK cut rows
    numbered = numbered.join(F.broadcast(offsets) if offsets.count() <= 1_000_000 else offsets, ["cell", "part"])
    return unpacked(
        numbered, docs.columns, shard_bytes=F.col("size"), text_crc32=F.col("crc"), shard=F.floor(F.col("cell") / cells_per_shard).cast("int"),
        slot=(F.col("in_part") + F.col("ahead")).cast("long"),
    )


def _numbered(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with rank, a number from 0 among those of their key, counted in blocks so that no task ranks all rows of a key."""
    blocks = max(1, math.ceil(keys.count() / RANK_BLOCK))
    held = materialize(rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))), "rows-of-cut-keys")
    sizes = held.groupBy("k", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.select("k", "block", (F.sum("n").over(before) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("k", "block").orderBy("size")) - 1
    return held.withColumn("rank", rank).join(sizes, ["k", "block"]).withColumn("rank", F.col("rank") + F.col("before")).drop("block", "before")


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, **kw) -> None:
    """Parquet under path/shard=<k>, each shard as the files of its parts."""
    shard_documents(docs, n_shards, **kw).write.partitionBy("shard").parquet(path)


def op6_histogram_shards(spark, sf_dir: str) -> DataFrame:
    rows = shard_documents(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", F.col("shard_bytes").alias("size"), F.col("text_crc32").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
