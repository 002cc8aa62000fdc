"""Record keeping: adding and deleting rows, media links, issue and action listings, imports from other programs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.tables import Tables
from ..sources.files import committed, match_media, written
from ..sources.gedcom import upsert
from .actions import Outcome, _replaced, undo
from .ids import add_rows
from .search import MAX_ROWS

LOG = "action_type string, payload_json string, undo_tables array<string>, created_at timestamp_ntz, applied_by string"


def blank_to_null(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def add_persons(t: Tables, new: DataFrame) -> Tables:
    """New persons: blanks become null, rows without given name and surname are refused."""
    text = [c for c, k in new.dtypes if k == "string"]
    clean = new.select(*[blank_to_null(c).alias(c) if c in text else F.col(c) for c in new.columns])
    return _replaced(t, persons=add_rows(t.persons, clean.filter("given is not null or surname is not null")))


def update_persons(t: Tables, changed: DataFrame, clear: bool = False) -> Tables:
    """Persons take the fields of rows of equal id.  A null leaves a field; a blank leaves it too, or with clear empties it."""
    fields = [c for c in changed.columns if c != "id" and c in t.persons.columns]
    d = t.persons.join(changed.select("id", *[F.col(c).alias(f"_{c}") for c in fields]), "id", "left")
    keeps = lambda c: F.col(f"_{c}").isNull() if clear else blank_to_null(f"_{c}").isNull()
    return _replaced(t, persons=d.select(*[F.when(keeps(c), F.col(c)).otherwise(blank_to_null(f"_{c}")).alias(c) if c in fields else F.col(c) for c in t.persons.columns]))


def delete_persons(t: Tables, ids: list[int]) -> Tables:
    """Persons go with their events, notes and media links; edges and spouse ids may dangle, as detectors expect."""
    gone = lambda d, c: d.filter(~F.coalesce(F.col(c).isin(ids), F.lit(False)))
    return _replaced(t, persons=gone(t.persons, "id"), events=gone(t.events, "person_id"), notes=gone(t.notes, "person_id"), media_links=gone(t.media_links, "person_id"))


def add_notes(t: Tables, new: DataFrame) -> Tables:
    return _replaced(t, notes=add_rows(t.notes, new.filter(~X.blank(F.col("note_text")))))


def set_attributes(attributes: DataFrame, new: DataFrame) -> DataFrame:
    """Key and value rows of persons; blank keys and values are refused."""
    return add_rows(attributes, new.filter(~X.blank(F.col("key")) & ~X.blank(F.col("value"))))


def link_media(t: Tables, new: DataFrame) -> Tables:
    """Links (asset_id, person_id, family_id) to one person or one family each; those that exist already are passed over."""
    key = ["asset_id", "person_id", "family_id"]
    fit = new.select(*key).distinct().filter(F.col("person_id").isNull() != F.col("family_id").isNull())
    have = t.media_links.select(*[F.col(c).alias(f"_{c}") for c in key])
    fresh = fit.join(have, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left_anti")
    linked = add_rows(t.media_links, fresh)
    return _replaced(t, media_links=linked, media_assets=refresh_status(t.media_assets, linked))


def unlink_media(t: Tables, link_ids: list[int]) -> Tables:
    left = t.media_links.filter(~F.col("id").isin(link_ids))
    return _replaced(t, media_links=left, media_assets=refresh_status(t.media_assets, left))


def refresh_status(assets: DataFrame, links: DataFrame) -> DataFrame:
    """assets with the status that their links give them."""
    n = links.groupBy(F.col("asset_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return assets.join(n, "id", "left").select(*[F.when(F.col("_n") > 0, "assigned").otherwise("unassigned").alias(c) if c == "status" else F.col(c) for c in assets.columns])


def list_issues(issues: DataFrame, kind: str | None = None, status: str | None = "open", page: int = 1, per_page: int = 50) -> DataFrame:
    """A page of issues, the newest first."""
    d = _chosen(issues, kind, status)
    order = [F.desc("detected_at")] if "detected_at" in issues.columns else []
    size = max(1, min(per_page, MAX_ROWS))
    return d.orderBy(*order, F.desc("id")).offset((max(1, page) - 1) * size).limit(size)


def _chosen(issues: DataFrame, kind: str | None, status: str | None) -> DataFrame:
    d = issues if kind is None else issues.filter(F.col("issue_type") == kind)
    return d if status is None else d.filter(F.col("status") == status)


def issue_total(issues: DataFrame, kind: str | None = None, status: str | None = "open") -> DataFrame:
    """One row: how many issues all pages hold."""
    return _chosen(issues, kind, status).agg(F.count(F.lit(1)).alias("total"))


def resolve_issues(issues: DataFrame, kinds: list[str], ids: list[int]) -> DataFrame:
    """Open issues of the kinds that name one of the ids become resolved."""
    hit = F.col("issue_type").isin(kinds) & (F.col("status") == "open") & F.arrays_overlap("entity_ids", F.array(*[F.lit(i) for i in ids]))
    return issues.withColumn("status", F.when(hit, "resolved").otherwise(F.col("status")))


def log_action(log: DataFrame, outcome: Outcome, by: str | None = None, action_id: int | None = None) -> DataFrame:
    """The action log with one more row: what was done, under which id, and which tables undo needs."""
    row = [(outcome.action, json.dumps(outcome.payload, sort_keys=True), sorted(set(outcome.before) | set(outcome.added)), by)]
    new = log.sparkSession.createDataFrame(row, "action_type string, payload_json string, undo_tables array<string>, applied_by string").withColumn("created_at", F.localtimestamp())
    return log.unionByName(new.withColumn("id", F.lit(action_id).cast("long")) if "id" in log.columns else new)


def undo_rows(outcome: Outcome, action_id: int) -> DataFrame:
    """(action_id, table_name, kind, row_json): the undo payload of an action as rows, any number of them: rows as they were before
    (kind before) and rows that the action made (kind added)."""
    parts = [
        d.select(F.lit(action_id).cast("long").alias("action_id"), F.lit(name).alias("table_name"), F.lit(kind).alias("kind"), F.to_json(F.struct(*d.columns)).alias("row_json"))
        for kind, frames in (("before", outcome.before), ("added", outcome.added)) for name, d in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def undo_logged(t: Tables, log: DataFrame, action_id: int) -> Tables:
    """The tables as they were before a logged action, from its stored undo rows (undo_rows) alone, which are written once, here."""
    own = written(log.filter(F.col("action_id") == action_id), "undo")
    names = [r["table_name"] for r in own.select("table_name").distinct().collect()]  # the tables of one action
    o = Outcome(t)
    for name in names:
        schema = getattr(t, name).schema
        for kind, frames in (("before", o.before), ("added", o.added)):
            rows = own.filter((F.col("table_name") == name) & (F.col("kind") == kind))
            frames[name] = rows.select(F.from_json("row_json", schema).alias("r")).select("r.*")
    return undo(o)


def write_action(path: str, outcome: Outcome, action_id: int, by: str | None = None) -> None:
    """Log an action durably: its log row and its undo rows are one write to a folder of their own, which counts once it is marked.  A
    crash before leaves no action; the same id written again replaces it."""
    spark = outcome.tables.spark
    said = [(action_id, outcome.action, json.dumps(outcome.payload, sort_keys=True), by)]
    log = spark.createDataFrame(said, "action_id long, action_type string, payload_json string, applied_by string").withColumns({"created_at": F.localtimestamp(), "kind": F.lit("log")})
    rows = [log]
    if outcome.before or outcome.added:
        rows.append(undo_rows(outcome, action_id))
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).drop("action_id").write.mode("overwrite").parquet(f"{path}/action_id={action_id}")


ACTION = "action_type string, payload_json string, applied_by string, created_at timestamp_ntz, kind string, table_name string, row_json string, action_id long"


def logged_actions(spark: SparkSession, path: str) -> DataFrame:
    """All rows of finished actions, log rows (kind log) and undo rows."""
    done = committed(spark, path, "action_id")
    if not done:
        return spark.createDataFrame([], ACTION)
    return spark.read.schema(ACTION).option("basePath", path).parquet(*[f"{path}/action_id={n}" for n in done])


def undo_action(t: Tables, path: str, action_id: int) -> Tables:
    """The tables as they were before a logged action, which is then logged no more.  Other actions stay, later ones too: undo of an older
    action puts its own rows back."""
    spark = t.spark
    if action_id not in committed(spark, path, "action_id"):
        raise ValueError(f"action {action_id} is not in the log")
    before = undo_logged(t, logged_actions(spark, path).filter("kind <> 'log'"), action_id)  # which copies the rows first
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/action_id={action_id}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS"), False)  # from here on it does not count
    files.delete(folder, True)
    return before


def list_actions(log: DataFrame, page: int = 1, per_page: int = 50) -> DataFrame:
    size = max(1, min(per_page, MAX_ROWS))
    return log.orderBy(F.desc("created_at")).offset((max(1, page) - 1) * size).limit(size)


def legacy_links(associations: DataFrame, locations: DataFrame, persons: DataFrame, assets: DataFrame, least: float = 0.9) -> DataFrame:
    """Report of media associations (media_id, owner_id, owner_name) against locations (media_id, path, sha256).

    Persons are found by xref, then as rmtree:<id>, then by full name (the last person of a name); assets by match_media.
    apply says whether both are found with enough confidence.
    """
    a = associations.join(locations, "media_id", "left").withColumn("key", F.xxhash64("media_id", "owner_id", "owner_name"))
    by = persons.select("xref", F.col("id").alias("pid")).filter("xref is not null")
    names = persons.groupBy(X.norm_name(F.concat_ws(" ", "given", "surname")).alias("full")).agg(F.max("id").alias("p3"))
    a = a.join(by.select(F.col("xref").alias("owner_id"), F.col("pid").alias("p1")), "owner_id", "left")
    a = a.withColumn("made", F.concat(F.lit("rmtree:"), F.col("owner_id"))).join(by.select(F.col("xref").alias("made"), F.col("pid").alias("p2")), "made", "left")
    a = a.withColumn("full", X.norm_name(F.col("owner_name"))).join(names, "full", "left")
    m = match_media(a.select("key", "sha256", "path", "media_id", "owner_id", F.coalesce("p1", "p2", "p3").alias("person_id")), assets)
    apply = F.col("person_id").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) >= least)
    return m.select("media_id", "owner_id", "person_id", "asset_id", "matched_by", "confidence", apply.alias("apply"))


def import_database(t: Tables, persons: DataFrame, edges: DataFrame, places: DataFrame, links: DataFrame) -> Tables:
    """Rows of genealogy_db go into the tables: persons by xref, parent edges without repeats, media by file name.

    Ids of the rows mean something in their file only, so edges, media and links meet persons and media of the same file.  Files count
    in order of their names: where two files have persons of one xref, which rmtree:<id> is for equal ids, they are one person, with the
    fields of the last file and the edges and media of all.  Media that no asset has the name of become placeholders, named by a hash of
    'missing::' and their path.  Links of unknown persons, of families and of unknown media are passed over.

    Persons, media and what becomes of them are read many times below, so they are written once, when this is called: files are read
    once, and the plans of the results stay small.
    """
    persons, places = written(persons, "import-persons"), written(places, "import-media")
    everyone = written(upsert(t.persons, persons.drop("source_id", "notes")), "import-everyone")
    ids = persons.select("file", "source_id", "xref").join(everyone.select("xref", "id"), "xref").select("file", "source_id", "id")
    ids = ids.repartition("file", "source_id").distinct()  # dealt once, as all joins below ask
    one = lambda side: ids.select("file", F.col("source_id").alias(side), F.col("id").alias(f"{side}_person_id"))
    found = edges.join(one("parent"), ["file", "parent"]).join(one("child"), ["file", "child"]).select("parent_person_id", "child_person_id", F.lit("parent").alias("rel_type"))
    relationships = t.relationships.unionByName(found.distinct().join(t.relationships, ["parent_person_id", "child_person_id", "rel_type"], "left_anti"))
    base = lambda c: F.lower(F.element_at(F.split(F.replace(F.col(c), F.lit("\\"), F.lit("/")), "/"), -1))
    known = t.media_assets.groupBy(F.lower("original_filename").alias("base")).agg(F.min("id").alias("asset_id"))
    p = places.withColumn("base", base("path")).join(known, "base", "left").withColumn("sha256", F.sha2(F.concat(F.lit("missing::"), F.col("path")), 256))
    lost = p.filter("asset_id is null").groupBy("sha256").agg(F.min(F.struct(F.col("path"), F.coalesce("original_name", "base").alias("original_filename"))).alias("m"))
    lost = lost.select("sha256", "m.path", "m.original_filename", F.lit("unassigned").alias("status"))
    assets = written(add_rows(t.media_assets, lost.join(t.media_assets.select("sha256"), "sha256", "left_anti")), "import-assets")
    at = p.join(assets.select("sha256", F.col("id").alias("lost_id")), "sha256", "left")
    media = at.select("file", "media_id", F.coalesce("asset_id", "lost_id").alias("asset_id"))
    new = links.filter("owner_type = 'person'").join(media, ["file", "media_id"]).join(ids.withColumnsRenamed({"source_id": "owner_id", "id": "person_id"}), ["file", "owner_id"])
    out = _replaced(t, persons=everyone, relationships=relationships, media_assets=assets)
    return link_media(out, new.select("asset_id", "person_id", F.lit(None).cast("int").alias("family_id")))


def graph_find(t: Tables, text: str) -> DataFrame:
    """Persons whose label holds the text, or whose id it is."""
    label = F.lower(F.concat_ws(" ", "given", "surname"))
    return t.persons.filter(label.contains(text.lower()) | (F.col("id").cast("string") == text))
