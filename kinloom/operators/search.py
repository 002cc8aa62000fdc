"""Listings, searches, drill-downs and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.tables import Tables

MAX_ROWS = 200


def people_search(t: Tables, query: str = "", limit: int = MAX_ROWS) -> DataFrame:
    """Persons whose given name or surname holds the text (any case; % and _ are wildcards), by name, nulls first."""
    like = f"%{query}%"
    found = t.persons.filter(F.col("given").ilike(like) | F.col("surname").ilike(like)) if query else t.persons
    return found.orderBy(F.asc_nulls_first("surname"), F.asc_nulls_first("given"), "id").limit(max(0, limit))


def full_name_search(t: Tables, query: str) -> DataFrame:
    q = query.lower()
    return t.persons.filter(F.lower(F.concat_ws(" ", "given", "surname")).contains(q))


def by_ids(d: DataFrame, ids: list, column: str = "id") -> DataFrame:
    """Rows of the listed ids; anything that is no number is passed over."""
    wanted = [int(i) for i in ids if str(i).isdigit()]
    return d.filter(F.col(column).isin(wanted)) if wanted else d.limit(0)


def page(d: DataFrame, page_no: int = 1, size: int = 20) -> DataFrame:
    size = max(1, min(size, MAX_ROWS))
    return d.offset((max(1, page_no) - 1) * size).limit(size)


def person_summary(d: DataFrame) -> DataFrame:
    return d.withColumns({"birth_year": X.least_year(F.col("birth_date")), "death_year": X.least_year(F.col("death_date"))})


def _spouses(families: DataFrame) -> DataFrame:
    """Distinct ids of the persons that are spouses in the families."""
    both = families.select(F.explode(F.array("husband_person_id", "wife_person_id")).alias("id"))
    return both.filter("id is not null").distinct()


def drilldown(t: Tables, kind: str, **f) -> DataFrame:
    """Persons behind a chart mark; unknown kinds and missing filters give no rows."""
    p = t.persons
    kind = (kind or "").lower()
    year = lambda c: X.decade(X.least_year(F.col(c)))
    if kind == "surname" and (f.get("surname") or "").strip():
        return p.filter(F.lower("surname") == f["surname"].strip().lower())
    if kind == "birth_place" and (f.get("place") or "").strip():
        return p.filter(F.lower(F.trim("birth_place")) == f["place"].strip().lower())
    if kind in ("birth_decade", "death_decade") and f.get("decade") is not None:
        return p.filter(year(kind.replace("decade", "date")) == int(f["decade"]))
    if kind == "marriage_decade" and f.get("decade") is not None:
        return p.join(_spouses(t.families.filter(year("marriage_date") == int(f["decade"]))), "id", "left_semi")
    if kind == "children_count" and f.get("children") is not None:
        wanted = t.family_children.groupBy("family_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == int(f["children"]))
        return p.join(_spouses(t.families.join(wanted, t.families["id"] == wanted["family_id"], "left_semi")), "id", "left_semi")
    if kind == "migration_pair":
        key = lambda v: X.place_key(F.lit(v).cast("string"))
        return p.filter((X.place_key(F.col("birth_place")) == key(f.get("from_place"))) & (X.place_key(F.col("death_place")) == key(f.get("to_place"))))
    if kind == "duplicate_cluster":
        return by_ids(p, f.get("ids") or [])
    return p.limit(0)


def confidence_bucket(c):
    return F.when(c.isNull(), "Unknown").when(c >= 0.9, "High").when(c >= 0.75, "Medium").otherwise("Low")


def node_quality(d: DataFrame) -> DataFrame:
    named = ~X.blank(F.col("given")) | ~X.blank(F.col("surname"))
    known = ~X.blank(F.col("birth_date")) | ~X.blank(F.col("birth_place"))
    return d.withColumn("quality", F.when(named & known, "high").when(named, "medium").otherwise("low"))
