"""Operator 7: WARC derivatives.

Response records become two linked records each: metadata (title, links, counts as JSON) and conversion (plain text).
Both refer to the response by WARC-Refers-To, keep its target URI, date and payload digest, and carry digests of their own.
Everything is a projection: no shuffle, any number of records.  Markup is read once from left to right in Arrow batches.
"""

from __future__ import annotations

import gzip
import html
import re
import uuid
from bisect import bisect_left
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..sources.files import store_of
from .common import load, materialize, packed, scratch, small_batches, text_of

CRLF = "\r\n"
VERSION = "WARC/1.0"
#: Elements that stand on lines of their own, and elements whose content is no text (fixed values).
BLOCK = frozenset(
    "address article aside blockquote body br center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "noscript", "template")}
_OPEN = re.compile(r"<!--|<(/?)([A-Za-z][A-Za-z0-9:_-]*)|<[!?]")
_TAG_END = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_HREF = re.compile(r"""(?<![\w-])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TITLE_END = re.compile(r"</title(?=[\s/>])", re.I)


def digest(block: Column) -> Column:
    """sha1: and the base-32 SHA-1 of a text's UTF-8 bytes; five hex digits make four base-32 digits."""
    hexed = F.sha1(block.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.lower(F.concat(*groups)), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def record_id(*parts: Column) -> Column:
    """A urn:uuid that depends on its parts alone: reruns name the same record alike."""
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


class _Ends:
    """Where tags end: at the first > outside quotes, or at the first > where a quote is never closed."""

    def __init__(self, text: str):
        self.text, self.places, self.ends = text, None, None

    def after(self, at: int) -> int:
        """The place behind the tag whose inside begins at a place, or -1 where no > follows."""
        if self.places is None:
            found = _TAG_END.match(self.text, at)
            if found:
                return found.end()
            self._tabulate()
        k = bisect_left(self.places, at)
        end = self.ends[k] if k < len(self.places) else -1
        return end if end > 0 else self.text.find(">", at) + 1 or -1

    def _tabulate(self) -> None:
        """For every quote and > the end of a tag in which it is the next mark, from the last one back: once a text."""
        self.places = [m.start() for m in re.finditer("[\"'>]", self.text)]
        self.ends = [-1] * len(self.places)
        behind = {'"': -1, "'": -1}
        for k in range(len(self.places) - 1, -1, -1):
            mark = self.text[self.places[k]]
            if mark == ">":
                self.ends[k] = self.places[k] + 1
            else:
                closed = behind[mark]
                self.ends[k] = self.ends[closed + 1] if 0 <= closed < len(self.places) - 1 else -1
                behind[mark] = k


def read_markup(page: str) -> tuple[str, str, list[str]]:
    """(visible text, title, links) of a page, in one pass.

    Scripts, styles and comments go, up to the end of the text where they are not closed; block tags break lines, other tags
    vanish; a tag without > is text.  The title is that of the first closed title element, links are the href values of a tags.
    """
    out, links, title, at, ends, closed = [], [], "", 0, _Ends(page), True
    while True:
        m = _OPEN.search(page, at)
        if m is None:
            out.append(page[at:])
            break
        out.append(page[at : m.start()])
        if m.group() == "<!--":
            at = page.find("-->", m.end()) + 3
            if at == 2:
                break
            out.append(" ")
            continue
        end = ends.after(m.end())
        if end < 0:
            out.append(page[m.start() :])
            break
        name = (m.group(2) or "").lower()
        if name in HIDDEN and not m.group(1):
            stop = HIDDEN[name].search(page, end)
            if stop is None:
                break
            end = ends.after(stop.end())
            if end < 0:
                break
            out.append(" ")
        elif name in BLOCK:
            out.append("\n")
        if not m.group(1):
            if name == "a" and (href := _HREF.search(page, m.end(), end)):
                links.append(html.unescape(next(g for g in href.groups() if g is not None)))
            if name == "title" and not title and closed:
                stop = _TITLE_END.search(page, end)
                closed = stop is not None  # none follows any later one either
                title = read_markup(page[end : stop.start()])[0] if stop else ""
        at = end
    return settle("".join(out)), title, links


def settle(text: str) -> str:
    """Entities decoded, white space settled."""
    t = re.sub(r"[ \t\r\f]+", " ", html.unescape(text).replace("\xa0", " "))
    return re.sub(r" ?\n[ \n]*", "\n", t).strip(" \n")


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("title", StringType()), StructField("links", ArrayType(StringType()))]))
def markup(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_markup(p) for p in pages], columns=["text", "title", "links"])


def page_responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records (record_id, target_uri, date, source, http_headers, payload) of the pages table; a null page is empty."""
    payload = text_of("html")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF))
    return pages.select(
        "page_id", record_id(F.lit("response"), text_of("url"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), payload).alias("record_id"),
        text_of("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), payload.alias("payload"),
    )


def derive(responses: DataFrame) -> DataFrame:
    """Two records per response: the columns of responses without payload and http_headers, then record_type, record_id,
    refers_to, content_type, source_headers, payload_digest, block, block_digest, content_length, which replace columns of these names.

    A null payload counts as empty: its text block is empty and its metadata has no links.  Repeated responses give
    repeated records with equal ids.  An empty table gives no records.
    """
    small_batches(responses.sparkSession)
    made_ = ("record_type", "record_id", "refers_to", "content_type", "source_headers", "payload_digest", "block", "block_digest", "content_length")
    kept = [c for c in responses.columns if c not in ("payload", "http_headers", *made_)]
    payload = F.coalesce(F.col("payload"), F.lit(""))
    d = packed(responses, payload=payload, head=F.col("http_headers"), id=F.col("record_id"), sum=digest(payload), bytes=F.octet_length(payload))
    d = d.withColumn("m", markup(F.col("payload"))).drop("payload")
    meta = F.to_json(F.struct(F.lit("text/html").alias("mime"), "bytes", F.col("m.title").alias("title"), F.col("m.links").alias("links"), F.length("m.text").alias("text_chars")))
    shape = lambda kind, mime, block: F.struct(F.lit(kind).alias("record_type"), F.lit(mime).alias("content_type"), block.alias("block"))
    d = d.withColumn("r", F.explode(F.array(shape("metadata", "application/json", meta), shape("conversion", "text/plain", F.col("m.text")))))
    return d.select(
        *[F.col("row")[c].alias(c) for c in kept], F.col("r.record_type").alias("record_type"), record_id(F.col("r.record_type"), F.col("id")).alias("record_id"), F.col("id").alias("refers_to"),
        F.col("r.content_type").alias("content_type"), F.col("head").alias("source_headers"), F.col("sum").alias("payload_digest"), F.col("r.block").alias("block"),
        digest(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"),
    )


def warc_text(records: DataFrame) -> Column:
    """A derived record as WARC text: header lines, a blank line, the block, two line ends.  The headers of the source response are
    one header line, WARC-Source-Headers, as a JSON list of their lines."""
    fields = (("WARC-Type", "record_type"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    value = {c: F.col(c).cast("string") for _, c in fields if c in records.columns}
    if "source_headers" in records.columns:
        fields += (("WARC-Source-Headers", "source_headers"),)
        value["source_headers"] = F.when(F.col("source_headers").isNotNull(), F.to_json(F.split("source_headers", CRLF, -1)))
    lines = [F.when(value[c].isNotNull(), F.concat(F.lit(f"{name}: "), value[c], F.lit(CRLF))).otherwise("") for name, c in fields if c in value]
    return F.concat(F.lit(VERSION + CRLF), *lines, F.lit(CRLF), F.col("block"), F.lit(CRLF + CRLF))


def source_headers_of(headers: Column) -> Column:
    """The headers of the source response, as they were, from the headers of a record that was read."""
    return F.array_join(F.from_json(F.try_element_at(headers, F.lit("warc-source-headers")), "array<string>"), CRLF)


class WarcFiles(DataSource):
    """Format warc_gzip, for writing: a .warc.gz file a partition, each record (column value) a gzip member of its own."""

    @classmethod
    def name(cls) -> str:
        return "warc_gzip"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceWriter):
    """Tasks write files of hidden names; those that counted are renamed when all have ended, and the others go."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> Written:
        store, base = store_of(self.path)
        store.create_dir(base)
        name = f"{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{base}/_{name}", compression=None) as out:  # the members are made here
            for row in rows:
                out.write(gzip.compress(row.value.encode("utf-8"), mtime=0))
        return Written(name)

    def commit(self, messages) -> None:
        store, base = store_of(self.path)
        for m in messages:
            if m is not None:
                store.move(f"{base}/_{m.name}", f"{base}/part-{m.name}")
        with store.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        store, base = store_of(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{base}/_{m.name}")


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """One WARC file per partition; gzip makes each record a member of its own, as readers that seek records expect.

    The folder of gzip files must be on a file system that Arrow opens; other compressions are Spark's own.
    """
    text = records.select(warc_text(records).alias("value"))
    if compression == "gzip":
        records.sparkSession.dataSource.register(WarcFiles)
        text.write.format("warc_gzip").option("path", path).mode("append").save()
    else:
        text.write.option("lineSep", CRLF).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of text WARC files: headers as a map, and the block, as many bytes as its Content-Length says.

    Spark splits plain files at the version line, so one file is read by many tasks.  Where that line stands inside a block, the
    pieces are put together again by their lengths; a record whose file ends before its block does comes with complete = false.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq")]
    raw = spark.read.option("lineSep", VERSION + CRLF).text(path).select(*place, "value")
    records = _records(raw)
    cut = records.filter(~F.col("complete")).select("file").distinct()
    if not cut.limit(1).count():
        return records.select("headers", "block", "complete")
    with scratch() as keep:
        cut = keep(materialize(cut, "cut-files"))
        pieces = materialize(raw.join(cut, "file", "left_semi").select("file", "split", "seq", "value"), "pieces")
        head = F.instr("value", CRLF * 2)
        size = F.nullif(F.regexp_extract("value", r"(?i)(?:^|\r\n)content-length:\s*([0-9]+)", 1), F.lit("")).cast("long")
        sizes = pieces.select("file", "split", "seq", F.octet_length("value").alias("bytes"), F.octet_length(F.substring(F.col("value"), head + 4, F.length("value"))).alias("have"), size.alias("need"))
        lead = sizes.groupBy("file").applyInPandas(_leads, "file string, split long, seq long, lead long")
        whole = pieces.join(lead, ["file", "split", "seq"]).groupBy("file", "lead").agg(F.array_sort(F.collect_list(F.struct("split", "seq", "value"))).alias("p"))
        whole = whole.select("file", F.array_join(F.transform("p", lambda p: p["value"]), VERSION + CRLF).alias("value"))
        mended = keep(materialize(_records(whole), "mended"))
    return records.join(cut, "file", "left_anti").unionByName(mended).select("headers", "block", "complete")


def _leads(pieces: pd.DataFrame) -> pd.DataFrame:
    """The number of the piece that each piece of a file belongs to: sizes of one file's pieces only."""
    p = pieces.sort_values(["split", "seq"])
    lead, missing, current = [], 0, -1
    for k, (size, have, need) in enumerate(zip(p["bytes"], p["have"], p["need"], strict=True)):
        if missing > 0:
            missing -= size + len(VERSION + CRLF)
        else:
            current, missing = k, (0 if need != need or need is None else need - have)
        lead.append(current)
    return p[["file", "split", "seq"]].assign(lead=lead)


def _records(raw: DataFrame) -> DataFrame:
    some = raw.filter(F.length("value") > 0)
    cut = F.instr("value", CRLF * 2)
    head = some.select("file", F.substring(F.col("value"), F.lit(1), cut - 1).alias("h"), F.substring(F.col("value"), cut + 4, F.length("value")).alias("b"))
    pairs = F.transform(F.filter(F.split("h", CRLF), lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    d = head.select("file", F.map_from_entries(pairs).alias("headers"), "b")
    size = F.try_element_at("headers", F.lit("content-length")).cast("int")
    return d.select("file", "headers", F.substring(F.col("b").cast("binary"), F.lit(1), size).cast("string").alias("block"), F.coalesce(F.octet_length("b") >= size, F.lit(False)).alias("complete"))


def op7_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    return derive(page_responses(load(spark, sf_dir, "pages")))
