"""Genealogy programs' SQLite files, plain or zipped, as a Spark data source, and the persons, edges and media in them.

A first job opens every file once and tells the layout of its tables.  Then each table is read by its own columns only, in pieces
of row ids that are partitions of the data source, so that several tasks read one large file.  A plain file is read in place and
never held in memory as a whole.
"""

from __future__ import annotations

import io
import json
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: File signatures (fixed values).
ZIP, SQLITE = b"PK\x03\x04", b"SQLite format 3\x00"
#: Rows of a batch, row ids of a piece, and tasks that read one set of tables, from which on a task reads several pieces.
BATCH, PIECE, TASKS = 500, 50_000, 1000


def database_bytes(content: bytes, largest: int | None = None) -> bytes:
    """The SQLite file itself: the content, or the first .rmtree member of a zip archive; anything else is refused, and so is more than
    largest bytes, where that is given."""
    if content.startswith(ZIP):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            inner = next((n for n in z.infolist() if n.filename.lower().endswith(".rmtree")), None)
            if inner is None:
                raise ValueError("the archive holds no .rmtree file")
            _fits(inner.file_size, largest)
            content = z.read(inner)
    _fits(len(content), largest)
    if not content.startswith(SQLITE):
        raise ValueError("no SQLite file")
    return content


def _fits(size: int, largest: int | None) -> None:
    if largest is not None and size > largest:
        raise ValueError(f"the file holds {size} bytes, more than the {largest} that are allowed")


def plain_name(name: str) -> str:
    """Lower-case identifier: the last part of a qualified name, without quotes, blanks as _."""
    return re.sub(r"\s+", "_", name.split(".")[-1].strip().strip("\"'`[]").strip()).lower()


def _in_memory(content: bytes) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    return con


def connect(path: str, largest: int | None = None) -> sqlite3.Connection:
    """The database at a path or URI, for reading.  A plain file on a file system that this node mounts is opened in place; zip archives
    and files of other stores are held in memory."""
    uri = urlsplit(path)
    if uri.scheme in ("", "file"):
        local = unquote(uri.path) if uri.scheme else path
        with open(local, "rb") as f:
            if f.read(len(SQLITE)) == SQLITE:
                _fits(f.seek(0, io.SEEK_END), largest)
                return sqlite3.connect(f"file:{quote(local)}?mode=ro&immutable=1", uri=True)
            f.seek(0)
            return _in_memory(database_bytes(f.read(), largest))
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as f:
        return _in_memory(database_bytes(f.read(), largest))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class Table:
    """A table of a file: plain and own names, and what its row ids span (None without row ids)."""

    file: str
    name: str
    source: str
    columns: tuple[str, ...]
    sources: tuple[str, ...]
    rows: int
    low: int | None
    high: int | None

    def pieces(self, size: int) -> list[tuple]:
        """(file, table, first row id, last row id) of stretches of about so many rows; None reads all."""
        if self.low is None or self.rows <= size or urlsplit(self.file).path.lower().endswith(".zip"):
            return [(self.file, self.source, None, None)]
        n = -(-self.rows // size)
        edges = [self.low + (self.high - self.low + 1) * k // n for k in range(n + 1)]
        return [(self.file, self.source, a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]


class Pieces(InputPartition):
    """What one task reads: (file, table, first row id, last row id) of each piece."""

    def __init__(self, pieces: list):
        self.pieces = pieces


def dealt(tables: list, size: int) -> list[Pieces]:
    """The pieces of tables, in order, dealt to tasks: of size rows, or of more where that would make more than TASKS."""
    most = max(size, sum(t.rows for t in tables) // TASKS)
    out, held, rows = [], [], 0
    for t in tables:
        pieces = t.pieces(size)
        for p in pieces:
            held.append(p)
            rows += -(-t.rows // len(pieces))
            if rows >= most:
                out.append(Pieces(held))
                held, rows = [], 0
    return out + ([Pieces(held)] if held else [])


class DatabaseSource(DataSource):
    """Format genealogy_db.  Options, as JSON: tables (file, own name, rows, first and last row id), piece, columns (own names; null gives
    nulls) and largest; the schema is file and then one string for each column."""

    @classmethod
    def name(cls) -> str:
        return "genealogy_db"

    def reader(self, schema) -> DataSourceReader:
        o = {k: json.loads(self.options.get(k, "null")) for k in ("tables", "piece", "columns", "largest")}
        tables = [Table(file, "", source, (), (), rows, low, high) for file, source, rows, low, high in o["tables"]]
        return DatabaseReader(dealt(tables, o["piece"]), o["columns"], o["largest"], schema.names)


class DatabaseReader(DataSourceReader):
    def __init__(self, parts: list[Pieces], columns: list, largest: int | None, names: list[str]):
        self.parts, self.columns, self.largest, self.names = parts, columns, largest, names

    def partitions(self) -> list[Pieces]:
        return self.parts

    def __getstate__(self) -> dict:
        """What a task gets of the reader: its own pieces reach it as its partition, those of all tasks stay behind."""
        return self.__dict__ | {"parts": []}

    def read(self, part: Pieces) -> Iterator[pa.RecordBatch]:
        for piece in part.pieces:
            yield from self.rows(*piece)

    def rows(self, file: str, table: str, low: int | None, high: int | None) -> Iterator[pa.RecordBatch]:
        chosen = ", ".join("null" if c is None else _quoted(c) for c in self.columns)
        where, bounds = ("", ()) if low is None else (" where rowid between ? and ?", (low, high))
        try:
            with closing(connect(file, self.largest)) as con:
                cur = con.execute(f"select {chosen} from {_quoted(table)}{where}", bounds)
                while rows := cur.fetchmany(BATCH):
                    text = lambda v: None if v is None or isinstance(v, bytes) else str(v)
                    columns = [pa.array([file] * len(rows), pa.string())] + [pa.array([text(v) for v in values], pa.string()) for values in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, self.names)
        except sqlite3.DatabaseError as e:  # never part of a table without a word
            raise ValueError(f"{file}, table {table}: {e}") from e


def layouts(spark: SparkSession, path: str, largest: int | None = None) -> DataFrame:
    """(file, name, source, columns, sources, rows, low, high, error) of every table of the files; no file is split, and tasks take files
    by their bytes.

    Every table is read through once by the database itself; error tells why one cannot be read, and then no row of it is taken.
    """
    files = spark.read.format("binaryFile").load(path).select("path")

    def look(batches):
        for p in batches:
            for file in p["path"]:
                out = []
                with closing(connect(file, largest)) as con:
                    for (source,) in con.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name").fetchall():
                        columns, rows, low, high, error = [], None, None, None, None
                        try:
                            columns = [r[1] for r in con.execute(f"pragma table_info({_quoted(source)})")]
                            read = " + ".join(f"coalesce(length({_quoted(c)}), 0)" for c in columns)
                            rows = con.execute(f"select count(*), sum({read}) from {_quoted(source)}").fetchone()[0]
                            if "rowid" not in map(str.lower, columns):
                                low, high = con.execute(f"select min(rowid), max(rowid) from {_quoted(source)}").fetchone()
                        except sqlite3.DatabaseError as e:
                            if "no such column: rowid" not in str(e):
                                error = str(e)
                        out.append((file, plain_name(source), source, [plain_name(c) for c in columns], columns, rows, low, high, error))
                frame = pd.DataFrame(out, columns=["file", "name", "source", "columns", "sources", "rows", "low", "high", "error"])
                yield frame.astype({"rows": "Int64", "low": "Int64", "high": "Int64"})

    kinds = "file string, name string, source string, columns array<string>, sources array<string>, rows long, low long, high long, error string"
    return files.mapInPandas(look, kinds)


@dataclass
class Databases:
    """Opened files: their readable tables, in order of files and names."""

    spark: SparkSession
    tables: list[Table]
    largest: int | None = None
    piece: int = PIECE

    def frame(self, tables: list[Table], columns: list[str | None], names: list[str]) -> DataFrame:
        """file and the columns (plain names) of the tables, under other names, values as text; other columns are not read."""
        rows = None
        by_source: dict[tuple, list] = {}
        for t in tables:
            own = tuple(None if c is None else t.sources[t.columns.index(c)] for c in columns)
            by_source.setdefault(own, []).append((t.file, t.source, t.rows, t.low, t.high))
        schema = ", ".join(["file string", *[f"`{n}` string" for n in names]])
        for own, some in by_source.items():
            options = {"tables": json.dumps(some), "piece": json.dumps(self.piece), "columns": json.dumps(own), "largest": json.dumps(self.largest)}
            d = self.spark.read.format("genealogy_db").schema(schema).options(**options).load()
            rows = d if rows is None else rows.unionByName(d)
        return rows if rows is not None else self.spark.createDataFrame([], schema)


def open_databases(spark: SparkSession, path: str, largest: int | None = None, piece: int = PIECE) -> Databases:
    """The files of a path; largest bounds their bytes where it is given.  Layouts, a row for each table, come to the driver."""
    spark.dataSource.register(DatabaseSource)
    found = layouts(spark, path, largest).filter("error is null").orderBy("file", "name").collect()
    return Databases(spark, [Table(r["file"], r["name"], r["source"], tuple(r["columns"]), tuple(r["sources"]), r["rows"], r["low"], r["high"]) for r in found], largest, piece)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(file, fingerprint): SHA-256 of type:name:table:sql of every schema object, in order, joined by |."""

    def objects(batches):
        for p in batches:
            for file in p["path"]:
                with closing(connect(file)) as con:
                    rows = con.execute("select type, name, tbl_name, coalesce(sql, '') from sqlite_master order by type, name").fetchall()
                yield pd.DataFrame({"file": [file], "text": ["|".join(":".join(r) for r in rows)]})

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(objects, "file string, text string").select("file", F.sha2("text", 256).alias("fingerprint"))


def pick(columns: tuple[str, ...], words: tuple[str, ...], but: tuple[str, ...] = ()) -> str | None:
    """The first column that holds one of the words, in the order of the words, and none of the others."""
    return next((c for w in words for c in columns if w in c and not any(b in c for b in but)), None)


def qualifies(table: Table, names: tuple[str, ...], columns: tuple[str, ...]) -> bool:
    return any(w in table.name for w in names) or any(w in c for w in columns for c in table.columns)


def _text(column: str):
    return F.nullif(F.trim(F.col(column)), F.lit(""))


# What tables and columns of the programs are called, and what must not be in a column's name.
PERSON_TABLES = (("individual", "person", "indi"), ("given", "surname", "gender", "sex", "birth", "death"))
PERSON_ID = (("individualid", "personid", "person_id", "id"), ("media", "relation", "parent", "child"))
PERSON_FIELDS = {
    "given": (("given", "givn", "first", "fname", "name"), ()), "surname": (("surname", "last", "lname"), ()), "sex": (("sex", "gender"), ()),
    "birth_date": (("birthdate", "birth_date", "dob", "born"), ("place",)), "birth_place": (("birthplace", "birth_place", "birthlocation", "birth_loc"), ()),
    "death_date": (("deathdate", "death_date", "dod", "died"), ("place",)), "death_place": (("deathplace", "death_place", "deathlocation"), ()), "notes": (("notes", "note", "description"), ("media",)),
}
EDGE_TABLES = (("relationship", "parent", "child"), ("parent", "child"))
CHILD_ID, PARENTS = ("childid", "child", "personid"), ("parent", "father", "mother")
MEDIA_ID, PATHS = (("mediaid", "media_id", "id"), ("person", "family")), ("path", "filepath", "filename", "location")
MEDIA_NAMES, MEDIA_TEXTS = ("name", "title"), ("description", "comment", "note", "caption")
LINKED_MEDIA, TARGETS = ("mediaid", "media_id", "media"), ("person", "family", "owner", "object")
OWNER_ID = (("ownerid", "owner_id", "objectid", "object_id", "personid", "person_id", "familyid", "family_id"), ("media",))
OWNER_TYPE = (("ownertype", "owner_type", "objecttype", "object_type", "type"), ("mediatype",))


def _alike(db: Databases, chosen) -> dict[tuple, list[Table]]:
    """Tables by the columns that a function chooses of them; those it gives None for are left out."""
    out: dict[tuple, list[Table]] = {}
    for t in db.tables:
        columns = chosen(t)
        if columns is not None:
            out.setdefault(columns, []).append(t)
    return out


def persons(db: Databases) -> DataFrame:
    """file, source_id, xref (rmtree:<id> where the file has none) and the person fields, blanks as null.

    A table holds persons if its name or its columns' names say so, and if it has an id.
    """
    names = ["source_id", "own_xref", *PERSON_FIELDS]

    def chosen(t: Table):
        key = pick(t.columns, *PERSON_ID)
        if key and qualifies(t, *PERSON_TABLES):
            return (key, pick(t.columns, ("xref",)), *[pick(t.columns, *v) for v in PERSON_FIELDS.values()])
        return None

    out = db.frame([], [None] * len(names), names)
    for columns, tables in _alike(db, chosen).items():
        out = out.unionByName(db.frame(tables, list(columns), names))
    xref = F.coalesce(_text("own_xref"), F.concat(F.lit("rmtree:"), F.col("source_id")))
    return out.filter("source_id is not null").select("file", "source_id", xref.alias("xref"), *[_text(k).alias(k) for k in PERSON_FIELDS])


def relationships(db: Databases) -> DataFrame:
    """(file, parent, child): every parent, father or mother column of a table with a child column gives an edge, each once.  Edges are dealt
    by file and parent, so a join on these does not deal them again."""

    def chosen(t: Table):
        child = pick(t.columns, CHILD_ID)
        parents = [c for c in t.columns if any(w in c for w in PARENTS) and c != child]
        return (child, *parents) if child and parents and qualifies(t, *EDGE_TABLES) else None

    out = db.frame([], [None, None], ["parent", "child"])
    for columns, tables in _alike(db, chosen).items():
        names = ["child", *[f"p{k}" for k in range(len(columns) - 1)]]
        d = db.frame(tables, list(columns), names).filter("child is not null")
        out = out.unionByName(d.select("file", F.explode(F.array(*names[1:])).alias("parent"), "child").filter("parent is not null and parent <> '0'"))
    return out.repartition("file", "parent").distinct()


def media(db: Databases) -> tuple[DataFrame, DataFrame]:
    """(file, media_id, path, original_name, description) and (file, media_id, owner_type, owner_id) with owners person or family."""

    def placed(t: Table):
        found = pick(t.columns, *MEDIA_ID), pick(t.columns, PATHS), pick(t.columns, MEDIA_NAMES), pick(t.columns, MEDIA_TEXTS)
        return found if all(found[:2]) and pick(t.columns, ("media",)) and pick(t.columns, ("path", "file")) else None

    def owned(t: Table):
        found = pick(t.columns, LINKED_MEDIA), pick(t.columns, *OWNER_ID), pick(t.columns, *OWNER_TYPE)
        return found if all(found[:2]) and pick(t.columns, TARGETS) else None

    names = ["media_id", "path", "original_name", "description"]
    places = db.frame([], [None] * 4, names)
    for columns, tables in _alike(db, placed).items():
        places = places.unionByName(db.frame(tables, list(columns), names))
    places = places.filter("media_id is not null and path is not null")
    links = db.frame([], [None] * 3, ["media_id", "owner_id", "owner_type"])
    for columns, tables in _alike(db, owned).items():
        d, said, owner = db.frame(tables, list(columns), ["media_id", "owner_id", "said"]), F.lower("said"), columns[1]
        named = "person" if "person" in owner else "family" if "family" in owner else None
        kind = F.when(said.contains("person") | said.rlike(r"^-?[0-9]+$"), "person").when(said.contains("family"), "family").otherwise(F.lit(named))
        links = links.unionByName(d.select("file", "media_id", "owner_id", kind.alias("owner_type")))
    links = links.filter("media_id is not null and owner_id is not null and owner_type is not null")
    return places.select("file", "media_id", F.trim("path").alias("path"), _text("original_name").alias("original_name"), _text("description").alias("description")), links.select("file", "media_id", "owner_type", "owner_id")
