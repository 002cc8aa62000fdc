"""Watching a media folder with Structured Streaming: a stream source of files keyed by path and modification time."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators.ids import add_rows
from ..sources.files import FILES_A_TASK, MEDIA, TASKS, committed, content_hash, register_media, store_of, written

#: Columns of the asset table that a watch keeps.
ASSETS = "id long, sha256 string, path string, original_filename string, mime_type string, size_bytes long, status string"


class MediaFolder(DataSource):
    """Format media_folder: options folder, state and extensions (JSON).  A row for each file that is new or changed."""

    @classmethod
    def name(cls) -> str:
        return "media_folder"

    def schema(self) -> str:
        return "path string, modified timestamp, size_bytes long, sha256 string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderReader(self.options["folder"], self.options["state"], json.loads(self.options["extensions"]))


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class FolderReader(DataSourceStreamReader):
    """Offsets are numbers of listings kept in the state folder, path to modification time in nanoseconds each; a batch is what one
    listing has beyond an earlier one, so a batch that is run again after a crash has the same files."""

    def __init__(self, folder: str, state: str, extensions: list[str]):
        self.folder, self.state, self.extensions = folder, state, tuple(f".{e}" for e in extensions)

    def _kept(self) -> list[int]:
        from pyarrow import fs

        store, base = store_of(self.state)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def _listing(self, number: int) -> dict[str, int]:
        if number == 0:
            return {}
        store, base = store_of(self.state)
        with store.open_input_stream(f"{base}/{number}.json") as f:
            return json.loads(f.read())

    def _now(self) -> dict[str, int]:
        from pyarrow import fs

        store, base = store_of(self.folder)
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        return {f.path: f.mtime_ns for f in found if f.is_file and f.path.lower().endswith(self.extensions)}

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last = max(self._kept(), default=0)
        old, now = self._listing(last), self._now()
        if all(old.get(path, -1) >= at for path, at in now.items()):
            return {"listing": last}
        store, base = store_of(self.state)
        store.create_dir(base)
        with store.open_output_stream(f"{base}/{last + 1}.new") as f:
            f.write(json.dumps(old | {p: max(at, old.get(p, -1)) for p, at in now.items()}).encode())
        store.move(f"{base}/{last + 1}.new", f"{base}/{last + 1}.json")
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        old, new = self._listing(start["listing"]), self._listing(end["listing"])
        some = sorted((p, at) for p, at in new.items() if old.get(p, -1) < at)
        size = max(FILES_A_TASK, -(-len(some) // TASKS))
        return [Files(some[k : k + size]) for k in range(0, len(some), size)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = store_of(self.folder)
        for path, at in partition.files:
            try:
                size, sha = content_hash(store, path)
            except FileNotFoundError:  # it went after it was listed
                continue
            yield path, datetime.fromtimestamp(at / 1e9, timezone.utc), size, sha

    def commit(self, end: dict) -> None:
        store, base = store_of(self.state)
        for number in self._kept():
            if number < end["listing"]:
                store.delete_file(f"{base}/{number}.json")


def watch_media(spark: SparkSession, folder: str, state: str, extensions: tuple = MEDIA) -> DataFrame:
    """A stream of media files (sha256, path, original_filename, mime_type, size_bytes, modified): each file when it is first seen, and
    again whenever its modification time grows.  state is a folder of the watch's own that the driver keeps listings in.

    Contents are hashed in tasks, a piece at a time; files may be of any size.  Files that vanish before they are read are passed over.
    """
    spark.dataSource.register(MediaFolder)
    raw = spark.readStream.format("media_folder").options(folder=folder, state=state, extensions=json.dumps(extensions)).load()
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("sha256", "path", name.alias("original_filename"), X.mime_of(name).alias("mime_type"), "size_bytes", "modified")


def current_assets(spark: SparkSession, table_path: str, before: int | None = None) -> DataFrame:
    """The assets that a watch has registered (in batches before a number): the last row of each id over the finished batches."""
    done = [n for n in committed(spark, table_path, "batch") if before is None or n < before]
    if not done:
        return spark.createDataFrame([], ASSETS)
    rows = spark.read.schema(ASSETS + ", batch long").option("basePath", table_path).parquet(*[f"{table_path}/batch={n}" for n in done])
    fields = [c for c in rows.columns if c not in ("id", "batch")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*fields), "batch").alias("m")).select("id", *[F.col("m")[c].alias(c) for c in fields])


def upsert_assets(found: DataFrame, table_path: str, number: int) -> None:
    """Write what the files of batch number change in the asset table: new assets, paths that known contents lacked, and assets, place
    holders too, that take the content of a new file of their name.  Written again, a batch gives the same rows."""
    spark = found.sparkSession
    assets = current_assets(spark, table_path, number)
    facts = ["path", "original_filename", "mime_type", "size_bytes"]
    one = found.groupBy("sha256").agg(F.min(F.struct(*facts)).alias("m")).select("sha256", *[F.col("m")[c].alias(c) for c in facts])
    one = written(one, "found")  # it is asked for several times below, and files are read once
    after, fresh = register_media(assets, one)
    whole = add_rows(after.select(*assets.columns), fresh.withColumn("status", F.lit("unassigned")))
    changed = whole.join(assets, [whole[c].eqNullSafe(assets[c]) for c in assets.columns], "left_anti")
    changed.select(*assets.columns).write.mode("overwrite").parquet(f"{table_path}/batch={number}")


def register_stream(stream: DataFrame, table_path: str, checkpoint: str, interval: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Keep an asset table (current_assets) by the stream: every batch is one folder of changed rows with its commit marker, so a batch
    that is run again replaces its own folder and repeats nothing."""
    out = stream.writeStream.foreachBatch(lambda batch, number: upsert_assets(batch, table_path, number)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=interval)).start()
