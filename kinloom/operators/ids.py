"""Rows that take the next ids of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def add_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing with new rows that take the next ids; columns new leaves out are null."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).withColumn("k", F.lit(1))
    kind = existing.schema["id"].dataType
    one = F.struct(*new.columns)
    buckets = new.withColumn("_b", F.pmod(F.xxhash64(one), F.lit(64)))
    ahead = buckets.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = ahead.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_ahead"))  # 64 rows
    ranked = buckets.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(one))).join(ahead, "_b")
    made = ranked.withColumn("k", F.lit(1)).join(top, "k").withColumn("id", (F.col("top") + F.col("_ahead") + F.col("_r")).cast(kind))  # one row
    columns = [F.col(c) if c == "id" or c in new.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in existing.columns]
    return existing.unionByName(made.select(*columns))


def one_per_key(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: the one that is last by order, the greatest by its values without one."""
    rest = [c for c in rows.columns if c != key]
    first = [F.col(order).alias("_order")] if order else []
    return rows.groupBy(key).agg(F.max(F.struct(*first, *[F.col(c) for c in rest])).alias("_one")).select(key, *[F.col("_one")[c].alias(c) for c in rest])
