"""Shared helpers: word rules, table access, durable intermediate tables and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words (a fixed value of the query contracts).
SPACE = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: str | Column = "text") -> Column:
    """The text, or the empty string where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: str | Column = "text") -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(text_of(text), SPACE), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every node sees: spark.checkpoint.dir.  Where it is unset, a session on this machine alone (as in
    tests) gets a temporary folder; on a cluster that would be a folder that other nodes do not see, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark, "_kinloom_dir", None) or f"file://{tempfile.mkdtemp(prefix='kinloom-')}"
        spark._kinloom_dir = found
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and a lost executor costs no recomputation.

    The table goes with the scratch() it was made in, else with release(), and at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinloom-{label}-{uuid.uuid4().hex}"
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinloom_path = path
    for held in _scope.get():
        held.append(out)
        break
    return out


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


#: The lists of tables of the scratch() blocks around the running code, innermost first; every thread has its own.
_scope: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scope", default=())


@contextmanager
def scratch():
    """Deletes the tables that materialize() writes inside it, but for those given to the function it yields."""
    kept: list[DataFrame] = []
    made: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    outer = _scope.set((made, *_scope.get()))
    try:
        yield keep
    finally:
        _scope.reset(outer)
        for df in made:
            if any(df is k for k in kept):
                for held in _scope.get()[:1]:
                    held.append(df)
            else:
                release(df)


def release(df: DataFrame | None) -> None:
    """Delete a table of materialize() that no later step reads."""
    path = getattr(df, "_kinloom_path", None)
    if path:
        where, files = _file_system(df.sparkSession, path)
        files.delete(where, True)
        files.cancelDeleteOnExit(where)


def drop_shuffles(spark: SparkSession) -> None:
    """Free the disks of executors from the shuffle files of steps whose tables are written: Spark removes them once the
    driver's JVM has collected the plans that made them, which by itself may come half an hour later."""
    spark._jvm.System.gc()


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows of docs as one struct, row, beside the given columns: no name of docs can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def unpacked(d: DataFrame, columns: list[str], **results: Column) -> DataFrame:
    """The packed rows again with results, which replace columns of their names."""
    return d.select(*[F.col("row")[c].alias(c) for c in columns if c not in results], *[c.alias(name) for name, c in results.items()])


def binary_case(value: Column, bounds: list, first: int = 0) -> Column:
    """Number of sorted bounds that are <= value, as a balanced tree of comparisons (log2 of them run per row)."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(value < F.lit(bounds[mid]), binary_case(value, bounds[:mid], first)).otherwise(
        binary_case(value, bounds[mid + 1 :], first + mid + 1)
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the least node id in it.

    Minimum labels travel along the edges and then jump to the label of their label, so that a star ends after two rounds
    and a path of n nodes after about log n.  Each round is a join and two map-side combined aggregations on tables in the
    shared folder; only one counter per round reaches the driver.  Self edges give single nodes; an empty input, no rows.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = both.union(both.select(F.col("v"), F.col("u"))).distinct()
    both = materialize(both, "edges")
    labels = materialize(
        both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("label")), "labels"
    )
    for _ in range(max_rounds):
        heard = (
            both.join(labels.withColumnsRenamed({"node": "v", "label": "seen"}), "v")
            .select(F.col("u").alias("node"), F.col("seen").alias("label"))
            .union(labels)
            # a node also tells its label's owner, which hooks whole trees onto lower ones
            .union(
                both.join(labels.withColumnsRenamed({"node": "v", "label": "seen"}), "v")
                .join(labels.withColumnsRenamed({"node": "u", "label": "owner"}), "u")
                .select(F.col("owner").alias("node"), F.col("seen").alias("label"))
            )
            .groupBy("node")
            .agg(F.min("label").alias("label"))
        )
        jumped = heard.join(heard.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select(
            "node", F.least("label", F.coalesce("next", "label")).alias("label")
        )
        new = materialize(jumped, "labels")
        changed = (
            new.join(labels.withColumnRenamed("label", "old"), "node").filter(F.col("label") != F.col("old")).limit(1).count()
        )
        release(labels)
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels.withColumnRenamed("label", "component")


def running_totals(values: Column, block: int = 512) -> Column:
    """Inclusive running sums of an array of numbers, block by block, so that work grows with its length and not its square."""

    def sums(a: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("out"))
        grow = lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.array_append(acc["out"], acc["s"] + v).alias("out"))
        return F.aggregate(a, zero, grow, lambda acc: acc["out"])

    long = values.cast("array<bigint>")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda c: F.slice(long, c * block + 1, block))
    held = F.transform(chunks, sums)
    before = F.transform(held, lambda h: F.element_at(h, -1))
    shifted = F.zip_with(sums(before), before, lambda upto, own: upto - own)
    many = F.flatten(F.zip_with(held, shifted, lambda h, o: F.transform(h, lambda v: v + o)))
    return F.when(F.size(values) <= block, sums(long)).otherwise(many)


def number_table(values: list[float], digits: int = 5) -> Column:
    """A list as one array literal: built from a string that the optimizer folds, instead of one expression per number."""
    return F.split(F.lit(",".join(f"{v:.{digits}g}" for v in values)), ",").cast("array<double>")


def small_batches(spark: SparkSession, rows: int = 200) -> None:
    """Arrow batches of whole texts stay small: at most so many rows go to a Python worker at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, str(rows))


@contextmanager
def byte_batches(spark: SparkSession, size: int = 1 << 19, rows: int = 10_000):
    """For the jobs that run inside it, Arrow batches end by their bytes: those of short rows may be many rows long, those of texts stay small."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


FILTER_BITS, FILTER_CHUNK = 27, 16


def bit_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A filter of 2**27 bits (16 MB, whatever the input) with a bit set for every 64-bit hash in the column.

    A clear bit proves that a value is not there; a set bit proves nothing, so an exact join must follow.
    """
    bit = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    placed = hashes.select(F.shiftright(bit, FILTER_CHUNK).alias("chunk"), bit.bitwiseAND(F.lit((1 << FILTER_CHUNK) - 1)).cast("int").alias("bit")).distinct()

    def pack(batches):
        held: dict[int, np.ndarray] = {}
        for p in batches:
            for chunk, bits in p.groupby("chunk")["bit"]:
                held.setdefault(int(chunk), np.zeros(1 << FILTER_CHUNK, bool))[bits.to_numpy()] = True
        if held:
            yield pd.DataFrame({"chunk": list(held), "bits": [np.packbits(v).tobytes() for v in held.values()]})

    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    width = 1 << (FILTER_CHUNK - 3)
    for chunk, bits in placed.repartition("chunk").mapInPandas(pack, "chunk long, bits binary").collect():
        table[chunk * width : (chunk + 1) * width] |= np.frombuffer(bits, np.uint8)
    return table


def in_filter(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.astype(np.int64) & ((1 << FILTER_BITS) - 1)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def maybe_among(spark: SparkSession, ids: DataFrame, id_col: str):
    """A predicate on an id column that is true for every id of ids and for few others; only the hash of the id goes to Python."""
    table = spark.sparkContext.broadcast(bit_filter(ids.select(F.xxhash64(id_col).alias("h")), "h"))

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(in_filter(table.value, h.to_numpy()))

    return lambda column: test(F.xxhash64(column))


def maybe_among_ids(d: DataFrame, column: str, ids: DataFrame, id_col: str) -> DataFrame:
    """d plus maybe: true for every row whose column is among the ids (null among nulls), and for few others.

    Built-in functions only: a bitmap of hashes, 16 MB whatever the input, goes to every task.  A full one only costs work.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS)) + 1
    bits = ids.groupBy(F.bitmap_bucket_number(place(id_col)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(id_col))).alias("bits"))
    at = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    test = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    return d.join(F.broadcast(bits), F.bitmap_bucket_number(place(column)) == F.col("bucket"), "left").withColumn("maybe", test).drop("bucket", "bits")


#: Ids that may be broadcast; beyond it rows that pass a filter of fixed size are shuffled.
BROADCAST_IDS = 200_000


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str, gone_col: str, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs without the rows whose id is in gone (null ids match null), by built-in functions only."""
    ids = gone.select(F.col(gone_col).alias("gone"))
    d = packed(docs, id=F.col(id_col))
    on = F.col("id").eqNullSafe(F.col("gone"))
    if ids.limit(broadcast_ids + 1).count() <= broadcast_ids:
        return unpacked(d.join(F.broadcast(ids), on, "left_anti"), docs.columns)
    d = maybe_among_ids(d, "id", ids, "gone")
    return unpacked(d.filter(~F.col("maybe")).unionByName(d.filter("maybe").join(ids, on, "left_anti")), docs.columns)


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, gone_col: str) -> DataFrame:
    """docs without the rows whose id is in gone (null ids match null).  Rows that the filter clears pass without a shuffle."""
    maybe = maybe_among(docs.sparkSession, gone, gone_col)
    d = packed(docs, id=F.col(id_col))
    ids = gone.select(F.col(gone_col).alias("gone"))
    held = d.filter(maybe(F.col("id"))).join(ids, F.col("id").eqNullSafe(F.col("gone")), "left_anti")
    return unpacked(d.filter(~maybe(F.col("id"))).union(held), docs.columns)
