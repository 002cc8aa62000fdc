"""Media folders, JSON snapshots and legacy media matching; exports of tables."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import tempfile
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

#: Media file types (fixed values).
MEDIA = ("jpg", "jpeg", "png", "gif", "webp", "tif", "tiff", "bmp", "heic", "pdf", "mp4", "mov", "avi", "mkv")
#: Bytes that are read at a time to hash a file.
CHUNK = 1 << 20
#: Tasks that read a folder's files; more files make larger tasks, as a task of few files is mostly its start.
TASKS = 400
#: Files that a task reads at least, where there are so many; beyond TASKS tasks it reads more.
FILES_A_TASK = 32
#: Rows of a listing that a task holds at a time, and names that a listing passes over.
PIECE, HIDDEN = 10_000, re.compile(r"\.|_(?!.*=)|.*\._COPYING_$")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder that all nodes see: under spark.checkpoint.dir, or, in a local session without one, a temporary one.
    It is deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='kinloom-')}"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(d: DataFrame, label: str) -> DataFrame:
    """d written once to a new work folder and read from there: what reads it does not compute it again, and a lost executor costs
    no recomputation."""
    folder = work_folder(d.sparkSession, label)
    d.write.parquet(folder)
    return d.sparkSession.read.schema(d.schema).parquet(folder)


def store_of(path: str):
    """(file system, path in it) of a path or URI, for use in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def content_hash(store, path: str) -> tuple[int, str]:
    """(bytes, SHA-256) of a file, which is read a chunk at a time."""
    size, sha = 0, hashlib.sha256()
    with store.open_input_stream(path) as f:
        while chunk := f.read(CHUNK):
            size += len(chunk)
            sha.update(chunk)
    return size, sha.hexdigest()


def committed(spark: SparkSession, path: str, key: str) -> list[int]:
    """The numbers n of the folders <key>=n below path that a finished write has marked."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def scan_media(spark: SparkSession, folder: str, extensions: tuple = MEDIA, recursive: bool = True) -> DataFrame:
    """(sha256, path, original_filename, mime_type, size_bytes): one row per content of the folder's media files.

    Tasks list the files and read them a chunk at a time to hash them, so files may be of any size.
    """

    def hashed(batches):
        for p in batches:
            yield p.assign(sha256=[content_hash(*store_of(path))[1] for path in p["path"]])

    return one_per_content(media_files(spark, folder, extensions, recursive).mapInPandas(hashed, "path string, length long, sha256 string"))


def media_files(spark: SparkSession, folder: str, extensions: tuple = MEDIA, recursive: bool = True) -> DataFrame:
    """(path, length) of the folder's media files, empty ones too, dealt to at most TASKS tasks of about as many files each."""
    found = listing(spark, folder, recursive).filter(_is_media(extensions))
    return found.repartition(max(1, min(TASKS, found.count() // FILES_A_TASK)))


def listing(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, length) of all files below a folder (or those that a pattern names), but for hidden ones, as Spark reads them: names that
    begin with . or _.

    Tasks list one level of folders after the other and write what they find; the driver sees how many folders a level has, and what
    the pattern itself names.  A local folder is listed a piece at a time, one of another store at once by its task.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    roots = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    if not roots:
        raise FileNotFoundError(folder)
    out, rows = work_folder(spark, "listing"), "path string, length long, folder boolean"
    level = spark.createDataFrame([(r.getPath().toString(), r.getLen(), r.isDirectory()) for r in roots], rows)
    for k in itertools.count():
        level.write.parquet(f"{out}/{k}")
        below = spark.read.schema(rows).parquet(f"{out}/{k}").filter("folder").select("path")
        count = below.count()
        if not count or (k and not recursive):
            return spark.read.schema(rows).parquet(*[f"{out}/{i}" for i in range(k + 1)]).filter("not folder").select("path", "length")
        level = below.repartition(min(TASKS, count)).mapInPandas(_entries, rows)


def _entries(batches):
    """(path, length, folder) of what is in folders, up to PIECE rows at a time."""
    for p in batches:
        for folder in p["path"]:
            rows = ((f"{folder.rstrip('/')}/{name}", length, below) for name, length, below in _inside(*store_of(folder)) if not HIDDEN.match(name))
            while some := list(itertools.islice(rows, PIECE)):
                yield pd.DataFrame(some, columns=["path", "length", "folder"])


def _inside(store, base: str):
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(base) as found:
            for x in found:
                if x.is_dir() or x.is_file():
                    yield x.name, 0 if x.is_dir() else x.stat().st_size, x.is_dir()
    else:
        for x in store.get_file_info(fs.FileSelector(base)):
            yield x.base_name, x.size or 0, not x.is_file


def _is_media(extensions: tuple):
    return F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions)


def media_rows(raw: DataFrame, extensions: tuple = MEDIA) -> DataFrame:
    """One row per content of binary files that are rows already (path, content, length), named by its least path."""
    return one_per_content(raw.filter(_is_media(extensions)).select("path", "length", F.sha2("content", 256).alias("sha256")))


def one_per_content(files: DataFrame) -> DataFrame:
    """One row per content of files (path, length, sha256), named by its least path."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("sha256", "path", name.alias("original_filename"), X.mime_of(name).alias("mime_type"), F.col("length").alias("size_bytes"))
    facts = ["path", "original_filename", "mime_type", "size_bytes"]
    return rows.groupBy("sha256").agg(F.min(F.struct(*facts)).alias("m")).select("sha256", *[F.col("m")[c].alias(c) for c in facts])


def register(assets: DataFrame, found: DataFrame) -> DataFrame:
    """found without the contents that assets holds already."""
    return found.join(assets.select("sha256"), "sha256", "left_anti")


def register_media(assets: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets as found files change them, found files that are new).

    A known content fills the paths its asset lacks.  Of assets that have the name of a new file the last one takes its content: a
    placeholder that an import made becomes the file.  Of several new files of one name that is the one of the least content hash.
    """
    fields = ["sha256", "path", "mime_type", "size_bytes"]
    have = [c for c in fields if c in assets.columns]
    known = found.select("sha256", F.col("path").alias("_path"))
    fresh = register(assets, found)
    by_name = assets.groupBy("original_filename").agg(F.max("id").alias("id"))
    first = fresh.groupBy("original_filename").agg(F.min(F.struct(*fields)).alias("f"))
    fill = by_name.join(first, "original_filename").select("id", *[F.col("f")[c].alias(f"_{c}") for c in fields])
    out = assets.join(known, "sha256", "left").withColumn("path", F.coalesce(F.nullif("path", F.lit("")), "_path")).drop("_path")
    out = out.join(fill, "id", "left")
    out = out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in have else F.col(c) for c in assets.columns])
    return out, fresh.join(fill.select(F.col("_sha256").alias("sha256")), "sha256", "left_anti")


def safe_name(sha: str = "sha256", mime: str = "mime_type", original: str = "original_filename"):
    """Content hash with the usual extension of the type, else that of the file, else .bin."""
    usual = F.create_map(*[F.lit(x) for kv in {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif", "application/pdf": ".pdf"}.items() for x in kv])
    own = F.nullif(F.lower(F.regexp_extract(F.coalesce(original, F.lit("")), r"(\.[A-Za-z0-9]+)$", 1)), F.lit(""))
    return F.concat(F.col(sha), F.coalesce(F.try_element_at(usual, F.col(mime)), own, F.lit(".bin")))


def match_media(wanted: DataFrame, assets: DataFrame, on_disk: DataFrame | None = None) -> DataFrame:
    """wanted (key, sha256, path) with the asset that fits best: by content 1.0, path 0.95, source path 0.9, file name 0.8, and where
    nothing fits, a file of that name on disk (on_disk: path, sha256) whose content is an asset, 0.85.

    assets: id, sha256, path, source_path.  The first way wins among equals, then the least id; rows that nothing fits stay.
    """
    base = lambda c: F.element_at(F.split(X.normalize_path(F.col(c)), "/"), -1)
    ways = (("sha256", F.col("sha256"), F.col("sha256"), 1.0), ("path", X.normalize_path(F.col("path")), X.normalize_path(F.col("path")), 0.95), ("source_path", X.normalize_path(F.col("path")), X.normalize_path(F.col("source_path")), 0.9), ("basename", base("path"), base("path"), 0.8))
    parts = []
    for i, (name, left, right, confidence) in enumerate(ways):
        a = wanted.select("key", left.alias("k")).filter("k <> ''")
        b = assets.select(F.col("id").alias("asset_id"), right.alias("k")).filter("k <> ''")
        parts.append(a.join(b, "k").select("key", "asset_id", F.lit(name).alias("matched_by"), F.lit(confidence).alias("confidence"), F.lit(i).alias("way")))
    best = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "way", "asset_id", "matched_by", "confidence")).alias("m"))
    out = wanted.join(best, "key", "left").select(*wanted.columns, "m.asset_id", "m.matched_by", "m.confidence")
    if on_disk is None:
        return out
    files = on_disk.select(base("path").alias("_base"), "sha256").join(assets.groupBy("sha256").agg(F.min("id").alias("_asset")), "sha256")
    files = files.filter("_base <> ''").groupBy("_base").agg(F.min("_asset").alias("_asset"))
    out = out.withColumn("_base", base("path")).join(files, "_base", "left")
    late = F.col("asset_id").isNull() & F.col("_asset").isNotNull()
    return out.select(
        *wanted.columns, F.coalesce("asset_id", "_asset").alias("asset_id"), F.when(late, "basename_disk").otherwise(F.col("matched_by")).alias("matched_by"),
        F.when(late, 0.85).otherwise(F.col("confidence")).alias("confidence"),
    )


def link_report(matches: DataFrame, path: str) -> None:
    """The match report as CSV with a header."""
    matches.write.option("header", True).csv(path)


def read_snapshot(spark: SparkSession, folder: str, table: str, schema: str | None = None) -> DataFrame:
    """A JSON table of a snapshot, as one array or as a record a line; a missing one is empty."""
    path = f"{folder}/{table}.json"
    try:
        first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
        reader = spark.read.option("multiLine", bool(first) and first[0]["value"].lstrip().startswith("["))
        return (reader.schema(schema) if schema else reader).json(path)
    except Exception as e:  # Spark reports a missing path in the analysis
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema or "id int")


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Every table as JSON under folder/<name>.json, and their row counts with a total as _metadata.json."""
    for name, d in tables.items():
        d.write.mode("overwrite").json(f"{folder}/{name}.json")
    counts = reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, d in tables.items()])
    meta = counts.agg(F.array_sort(F.collect_list(F.struct("table", "rows"))).alias("tables"), F.sum("rows").alias("total"))
    meta.write.mode("overwrite").json(f"{folder}/_metadata.json")
    return meta


def csv_line(columns: list[str]):
    """One CSV line of the columns: fields with quotes, commas or line ends are quoted, nulls are empty."""
    quote = lambda v: F.when(v.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    return F.concat_ws(",", *[quote(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def write_csv(d: DataFrame, path: str) -> None:
    """CSV with CR LF line ends, as spreadsheets expect; every part file begins with the names, and a table without rows has one part."""
    head = ",".join(d.columns)
    marked = d.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33))
    line = F.when(F.col("_i") == 0, F.concat(F.lit(head + "\r\n"), csv_line(d.columns))).otherwise(csv_line(d.columns))
    lines = marked.select(line.alias("value"))
    (d.sparkSession.createDataFrame([(head,)], "value string") if d.isEmpty() else lines).write.option("lineSep", "\r\n").text(path)


def latest_by(d: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: later rows replace earlier ones."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
