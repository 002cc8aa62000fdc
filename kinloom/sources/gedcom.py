"""GEDCOM text files as DataFrames of persons and families, and their import into the tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ids import one_per_key
from .files import written

#: The form of a line: level, optional reference, tag and value (a fixed value of the format).
LINE = r"^([0-9]+)\s+(?:(@[^@]+@)\s+)?([A-Z0-9_]+)(?:\s+(.*))?$"

#: Lines that open an event of a kind of record (fixed values of the format).
EVENTS = {"INDI": ("BIRT", "DEAT"), "FAM": ("MARR",)}


@dataclass
class Gedcom:
    """persons: xref, given, surname, sex, dates, places, notes; families: xref, husb, wife, marriage, children, notes."""

    persons: DataFrame
    families: DataFrame


def gedcom_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, pos, level, xref, tag, value) of the lines that follow the GEDCOM form; others are passed over.

    Files are read line by line and split like any text, so many tasks read a large one.  pos orders the lines of a file: block is
    where the task's piece of the file begins, n counts on inside it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    return _parts(lines)


def split_lines(texts: DataFrame) -> DataFrame:
    """The lines of texts (file, value), one block each; a file of several texts has a column block that orders them."""
    block = F.col("block") if "block" in texts.columns else F.lit(0)
    return _parts(texts.select("file", block.cast("long").alias("block"), F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("n", "line")))


def _parts(lines: DataFrame) -> DataFrame:
    part = lambda k: F.regexp_extract("line", LINE, k)
    some = lines.filter(F.col("line").rlike(LINE))
    pos = F.struct("block", F.col("n").cast("long").alias("n")).alias("pos")
    return some.select("file", "block", pos, part(1).cast("int").alias("level"), F.nullif(part(2), F.lit("")).alias("xref"), part(3).alias("tag"), F.trim(part(4)).alias("value"))


def with_records(lines: DataFrame) -> DataFrame:
    """lines with rec, the last level-0 line up to each: xref (null but for INDI and FAM), kind and start; and with event, the tag of the
    last line of the record, up to each, that opens an event of its kind.

    A window goes over one block of a file at a time.  What a block begins with, the record and event that an earlier one left open,
    comes from the last such lines of the blocks, one row each.  So lines are dealt by blocks at most, and not by records once more.
    """
    zero = F.col("level") == 0
    heads = F.when(zero, F.struct(F.when(F.col("tag").isin("INDI", "FAM"), F.col("xref")).alias("xref"), F.col("tag").alias("kind"), F.col("pos").alias("start")))
    opens = {k: F.when(zero, F.struct(F.lit(None).cast("string").alias("tag"))).when(F.col("tag").isin(*tags), F.struct("tag")) for k, tags in EVENTS.items()}  # a record begins without one
    last = {"record": (heads, zero)} | {k: (x, x.isNotNull()) for k, x in opens.items()}
    ends = lines.groupBy("file", "block").agg(*[_last(x, when).alias(k) for k, (x, when) in last.items()])
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = ends.select("file", "block", *[F.last(k, ignorenulls=True).over(before).alias(f"opened_{k}") for k in last])
    upto = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumns({f"own_{k}": F.last(x, ignorenulls=True).over(upto) for k, (x, _) in last.items()}).join(opened, ["file", "block"])
    at = {k: F.coalesce(f"own_{k}", f"opened_{k}") for k in last}
    event = F.when(at["record"]["kind"] == "INDI", at["INDI"]["tag"]).when(at["record"]["kind"] == "FAM", at["FAM"]["tag"])
    return d.select(*lines.columns, at["record"].alias("rec"), event.alias("event"))


def _last(value: Column, when: Column, pos: str = "pos") -> Column:
    """The value of the last line for which the condition holds."""
    return F.max_by(F.when(when, value), F.when(when, F.col(pos)))


def parse(lines: DataFrame) -> Gedcom:
    """Records of level-0 INDI and FAM lines.  A record whose xref comes again goes on where it stopped.

    The latest BIRT, DEAT or MARR line of a record names the event that DATE and PLAC lines belong to, until the next level 0:
    later event lines of other kinds do not end it.  The last writer of a field wins.
    """
    d = with_records(lines).filter("rec.xref is not null")
    d = d.select("file", "pos", "level", "tag", "value", F.col("rec.xref").alias("record"), F.col("rec.kind").alias("kind"), "event")
    tag, value = F.col("tag"), F.col("value")
    filled = value != ""
    field = lambda name, event: _last(value, (tag == name) & (F.col("event") == event) & (F.col("level") > 0))
    listed = lambda name: F.transform(F.array_sort(F.collect_list(F.when((tag == name) & filled & (F.col("level") > 0), F.struct("pos", "value")))), lambda x: x["value"])
    slash = F.split(value, "/")
    given = F.when(tag == "NAME", F.trim(slash[0])).when((tag == "GIVN") & filled, value)
    last = F.when((tag == "NAME") & value.contains("/"), F.trim(slash[1])).when((tag == "SURN") & filled, value)
    persons = d.filter("kind = 'INDI'").groupBy("file", F.col("record").alias("xref")).agg(
        F.coalesce(_last(given, given.isNotNull()), F.lit("")).alias("given"), F.coalesce(_last(last, last.isNotNull()), F.lit("")).alias("surname"), _last(value, tag == "SEX").alias("sex"),
        field("DATE", "BIRT").alias("birth_date"), field("PLAC", "BIRT").alias("birth_place"), field("DATE", "DEAT").alias("death_date"), field("PLAC", "DEAT").alias("death_place"), listed("NOTE").alias("notes"),
    )
    families = d.filter("kind = 'FAM'").groupBy("file", F.col("record").alias("xref")).agg(
        _last(value, (tag == "HUSB") & filled).alias("husb"), _last(value, (tag == "WIFE") & filled).alias("wife"), field("DATE", "MARR").alias("marriage_date"), field("PLAC", "MARR").alias("marriage_place"),
        listed("CHIL").alias("children"), listed("NOTE").alias("notes"),
    )
    return Gedcom(persons, families)


def read_gedcom(spark: SparkSession, path: str) -> Gedcom:
    return parse(gedcom_lines(spark, path))


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "xref") -> DataFrame:
    """Rows of incoming replace those of equal key, new keys get the next ids.

    Of incoming rows of one key one counts: that of the last file, where they have files.  Ids follow the order of the keys; ranks
    are taken inside hash buckets, and only bucket sizes meet in one task.
    """
    incoming = one_per_key(incoming, key, "file" if "file" in incoming.columns else None)
    fields = [c for c in existing.columns if c not in ("id", key)]
    have = existing.select(key, "id")
    merged = incoming.select(key, *[F.col(c) if c in incoming.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in fields]).join(have, key, "left")
    fresh = merged.filter("id is null").withColumn("bucket", F.pmod(F.hash(key), F.lit(64)))
    sizes = fresh.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("ahead"))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).withColumn("k", F.lit(1))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(key))
    numbered = fresh.withColumn("rank", rank).join(ahead, "bucket").withColumn("k", F.lit(1)).join(top, "k")  # one row
    numbered = numbered.withColumn("id", (F.col("top") + F.col("ahead") + F.col("rank")).cast(existing.schema["id"].dataType))
    kept = existing.join(incoming.select(key), key, "left_anti").select(*existing.columns)
    return kept.unionByName(merged.filter("id is not null").select(*existing.columns)).unionByName(numbered.select(*existing.columns))


def import_families(g: Gedcom, persons: DataFrame, families: DataFrame, family_children: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(families, family_children, relationships) after an import: unknown spouses are null, unknown children are passed over,
    children are added and never taken away, and parent edges are built anew from all families.

    Parsed families, and families with their ids, are asked for several times, so they are written once, here.
    """
    ids = persons.select("xref", "id")
    parsed = written(g.families.select("xref", "husb", "wife", "marriage_date", "marriage_place", "children"), "gedcom-families")
    f = parsed.drop("children")
    for role, column in (("husb", "husband_person_id"), ("wife", "wife_person_id")):
        f = f.join(ids.select(F.col("xref").alias(role), F.col("id").alias(column)), role, "left")
    families = written(upsert(families, f.drop("husb", "wife")), "families")
    kids = parsed.select("xref", "children").join(families.select("xref", F.col("id").alias("family_id")), "xref").select("family_id", F.explode("children").alias("child"))
    kids = kids.join(ids.select(F.col("xref").alias("child"), F.col("id").alias("child_person_id")), "child").select("family_id", "child_person_id")
    family_children = family_children.unionByName(kids).repartition("family_id").distinct()  # dealt as the join below asks
    both = families.join(family_children, families["id"] == family_children["family_id"])
    edges = both.select(F.explode(F.array("husband_person_id", "wife_person_id")).alias("parent_person_id"), "child_person_id").filter("parent_person_id is not null")
    return families, family_children, edges.distinct().withColumn("rel_type", F.lit("parent"))
