"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the documents of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import load, materialize, release
from kinloom.llm.decontamination import drop_leaks
from kinloom.llm.jaccard_join import keep_one_of_each
from kinloom.llm.mixing import mix_documents
from kinloom.llm.quality_classifier import keep_good
from kinloom.llm.sharding import shard_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose learned quality score is under 0.7 go.  Null and empty texts are judged as an empty passage, equal texts alike."""
    return keep_good(docs, load(spark, sf_dir, "labels").select("doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least id; texts without words all stay."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go, and rows of their id; null and empty texts stay."""
    return drop_leaks(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the source weights ask, up to three times; those without words stay once; null is a source."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with shard and slot, which replace columns of these names; repeated documents, which mixing makes,
    are told apart by their slots; null texts count as empty."""
    return shard_documents(docs).withColumn("text_crc32", F.col("text_crc32").cast("long"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("sharding", shard),
]

#: SQL cannot express the learned classifier; tests hold the stages against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; a stage's table goes when the next one is written.  An empty table gives no rows."""
    docs, read = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        release(read)
        docs = read = out
    return docs
