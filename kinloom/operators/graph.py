"""Family graph: bounded neighbourhoods, assembly of nodes and edges, one-hop trees and family details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.tables import Tables
from ..sources.files import work_folder
from .search import node_quality, person_summary

MAX_DEPTH = 5


def neighbourhood(t: Tables, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(id, distance) of persons within depth steps (at most 5) of the root ids, over parent and child edges in both ways.

    The walk runs here, a step at a time: edges are written once, and so is every step, the persons next to the last one's that no step
    before has met.  So no person is expanded twice, and the plan of a step does not hold the steps before it.
    """
    spark, r = t.spark, t.relationships
    folder = work_folder(spark, "walk")
    way = lambda a, b: F.struct(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = r.select(F.explode(F.array(way("parent_person_id", "child_person_id"), way("child_person_id", "parent_person_id"))).alias("e")).select("e.a", "e.b")
    kind = roots.schema["id"].dataType.simpleString()
    met = lambda steps: spark.read.schema("id long, distance int").parquet(*[f"{folder}/step{k}" for k in steps])
    roots.select(F.col("id").cast("long").alias("id")).distinct().withColumn("distance", F.lit(0)).write.parquet(f"{folder}/step0")
    most = max(0, min(depth, MAX_DEPTH))
    if most:
        edges.write.parquet(f"{folder}/edges")
    edges, last = spark.read.schema("a long, b long").parquet(f"{folder}/edges") if most else None, 0
    for k in range(1, most + 1):
        here = met([k - 1]).select(F.col("id").alias("a"))
        fresh = edges.join(here, "a", "left_semi").select(F.col("b").alias("id")).distinct().join(met(range(k)).select("id"), "id", "left_anti")
        fresh.withColumn("distance", F.lit(k)).write.parquet(f"{folder}/step{k}")
        last = k
        if met([k]).isEmpty():
            break
    return met(range(last + 1)).select(F.col("id").cast(kind).alias("id"), "distance")


def families_touching(t: Tables, persons: DataFrame) -> DataFrame:
    """Families with a spouse among the persons."""
    ids = persons.select(F.col("id").alias("p"))
    spouses = t.families.select("id", F.explode(F.array("husband_person_id", "wife_person_id")).alias("p")).join(ids, "p", "left_semi")
    return t.families.join(spouses.select("id"), "id", "left_semi")


def graph_nodes(t: Tables, persons: DataFrame) -> DataFrame:
    """(node, kind, label, quality) of the persons and of the families they are spouses in."""
    p = node_quality(person_summary(t.persons.join(persons.select("id"), "id", "left_semi")))
    people = p.select(F.concat(F.lit("person_"), "id").alias("node"), F.lit("person").alias("kind"), X.full_name(F.col("given"), F.col("surname")).alias("label"), "quality")
    fams = families_touching(t, persons).select(F.concat(F.lit("family_"), "id").alias("node"), F.lit("family").alias("kind"), F.coalesce("marriage_date", F.lit("")).alias("label"), F.lit(None).cast("string").alias("quality"))
    return people.unionByName(fams)


def graph_edges(t: Tables, persons: DataFrame) -> DataFrame:
    """(edge, source, target, kind): spouses to families and families to children, between persons of the set only."""
    inside = persons.select(F.col("id").alias("pid"))
    role = lambda name, short: F.struct(F.lit(short).alias("role"), F.col(f"{name}_person_id").alias("pid"))
    spouses = t.families.select("id", F.explode(F.array(role("husband", "h"), role("wife", "w"))).alias("r")).select("id", "r.role", "r.pid").join(inside, "pid", "left_semi")
    kids = t.family_children.join(spouses.select(F.col("id").alias("family_id")), "family_id", "left_semi").withColumnRenamed("child_person_id", "pid").join(inside, "pid", "left_semi")
    one = spouses.select(F.concat(F.lit("spouse_"), "role", F.lit("_"), "id").alias("edge"), F.concat(F.lit("person_"), "pid").alias("source"), F.concat(F.lit("family_"), "id").alias("target"), F.lit("spouse").alias("kind"))
    two = kids.select(F.concat_ws("_", F.lit("child"), "family_id", "pid").alias("edge"), F.concat(F.lit("family_"), "family_id").alias("source"), F.concat(F.lit("person_"), "pid").alias("target"), F.lit("child").alias("kind"))
    return one.unionByName(two)


def one_hop(t: Tables, person_id: int) -> DataFrame:
    """The person, its parents and its children with their roles."""
    r, p = t.relationships, t.persons
    me = p.filter(F.col("id") == person_id).select(F.lit("self").alias("role"), "id", "given", "surname")
    up = r.filter(F.col("child_person_id") == person_id).select(F.col("parent_person_id").alias("id")).distinct()
    down = r.filter(F.col("parent_person_id") == person_id).select(F.col("child_person_id").alias("id")).distinct()
    show = lambda role, ids: p.join(ids, "id", "left_semi").select(F.lit(role).alias("role"), "id", "given", "surname")
    return me.unionByName(show("parent", up)).unionByName(show("child", down))


def family_detail(t: Tables, family_id: int) -> DataFrame:
    """One row: both spouses, the children's ids, the notes (id, text; by id) and the number of media links of a family."""
    f = t.families.filter(F.col("id") == family_id)
    names = t.persons.select("id", F.concat_ws(" ", "given", "surname").alias("name"))
    h, w = (names.withColumnsRenamed({"id": f"{r}_person_id", "name": r}) for r in ("husband", "wife"))
    kids = t.family_children.filter(F.col("family_id") == family_id).groupBy(F.col("family_id").alias("id")).agg(F.array_sort(F.collect_list("child_person_id")).alias("children"))
    media = t.media_links.filter(F.col("family_id") == family_id).groupBy(F.col("family_id").alias("id")).agg(F.count(F.lit(1)).alias("media"))
    own = t.notes if "family_id" in t.notes.columns else t.notes.withColumn("family_id", F.lit(None).cast("int"))
    notes = own.filter(F.col("family_id") == family_id).groupBy(F.col("family_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("note_id"), F.col("note_text").alias("text")))).alias("notes"))
    f = f.join(notes, "id", "left")
    out = f.join(h, "husband_person_id", "left").join(w, "wife_person_id", "left").join(kids, "id", "left").join(media, "id", "left")
    return out.select(
        "id", "husband", "wife", "marriage_date", "marriage_place", F.coalesce("children", F.array().cast("array<int>")).alias("children"), F.coalesce("media", F.lit(0)).alias("media"),
        F.coalesce("notes", F.array().cast("array<struct<note_id:int,text:string>>")).alias("notes"),
    )


def parent_edges(t: Tables) -> DataFrame:
    """Parent to child edges of the families together with those stored, without repeats."""
    f = t.families.join(t.family_children, t.families["id"] == t.family_children["family_id"])
    made = f.select(F.explode(F.array("husband_person_id", "wife_person_id")).alias("parent_person_id"), "child_person_id").filter("parent_person_id is not null")
    return made.unionByName(t.relationships.select("parent_person_id", "child_person_id")).distinct()
