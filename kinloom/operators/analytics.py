"""Counts, coverage, top lists, decades, duplicates and migration as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..plans.tables import Tables


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def table_counts(t: Tables) -> DataFrame:
    names = {"people": t.persons, "families": t.families, "notes": t.notes, "media_assets": t.media_assets, "media_links": t.media_links}
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, d in names.items()])


def coverage(t: Tables) -> DataFrame:
    """Share of persons with each field, in percent with one decimal (half to even)."""
    fields = {
        "birth_date": X.least_year(F.col("birth_date")).isNotNull(), "death_date": X.least_year(F.col("death_date")).isNotNull(),
        "birth_place": ~X.blank(F.col("birth_place")), "death_place": ~X.blank(F.col("death_place")), "sex": ~X.blank(F.col("sex")),
    }
    one = t.persons.agg(F.count(F.lit(1)).alias("total"), *[_count(c).alias(k) for k, c in fields.items()])
    long = one.unpivot(["total"], list(fields), "field", "known")
    return long.select("field", "known", "total", F.bround(F.col("known") / F.greatest("total", F.lit(1)) * 100, 1).alias("pct"))


def top_values(d: DataFrame, column: str, limit: int = 15) -> DataFrame:
    """Most frequent non-empty values; ties by value."""
    some = d.filter(F.col(column).isNotNull() & (F.col(column) != ""))
    return some.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def top_surnames_with_unknown(t: Tables, limit: int = 10) -> DataFrame:
    """Most frequent surnames, blanks counted as Unknown; ties by value."""
    name = F.coalesce(F.nullif(F.col("surname"), F.lit("")), F.lit("Unknown"))
    return t.persons.groupBy(name.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def recently_added(d: DataFrame, limit: int = 10, order: str = "created_at") -> DataFrame:
    """The newest rows first, those without a time last, ties by id."""
    return d.orderBy(F.desc_nulls_last(order), "id").limit(limit)


def children_per_family(t: Tables) -> DataFrame:
    return t.family_children.groupBy("family_id").agg(F.count(F.lit(1)).alias("children"))


def children_distribution(t: Tables) -> DataFrame:
    return children_per_family(t).groupBy("children").agg(F.count(F.lit(1)).alias("families"))


def children_summary(t: Tables) -> DataFrame:
    return children_per_family(t).agg(F.round(F.avg("children"), 2).alias("average"), F.max("children").alias("largest"), F.count(F.lit(1)).alias("families"))


def timeseries(t: Tables) -> DataFrame:
    """(series, decade, n) of births, deaths and marriages; dates without a year, or of year 0, are left out."""
    parts = (("births", t.persons, "birth_date"), ("deaths", t.persons, "death_date"), ("marriages", t.families, "marriage_date"))
    years = [d.select(F.lit(name).alias("series"), X.least_year(F.col(c)).alias("year")) for name, d, c in parts]
    return reduce(DataFrame.unionByName, years).filter("year > 0").groupBy("series", X.decade(F.col("year")).alias("decade")).agg(F.count(F.lit(1)).alias("n"))


def decade_pivot(t: Tables) -> DataFrame:
    """One row per decade with the three series side by side, 0 where one has none."""
    kinds = ["births", "deaths", "marriages"]
    return timeseries(t).groupBy("decade").pivot("series", kinds).agg(F.sum("n")).na.fill(0, kinds)


def exact_duplicates(t: Tables, limit: int = 50, ids_shown: int = 25) -> DataFrame:
    """Groups of persons of equal given name, surname and birth year, the largest first; at most ids_shown ids are listed."""
    p = t.persons.select("id", X.norm_text(F.col("given")).alias("given"), X.norm_text(F.col("surname")).alias("surname"), X.least_year(F.col("birth_date")).alias("birth_year"))
    p = p.filter("given <> '' and surname <> '' and birth_year > 0")
    key = ["given", "surname", "birth_year"]
    order = [F.desc("n"), "surname", "given", "birth_year"]
    top = p.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(*order).limit(max(0, min(limit, 200)))
    # ids are gathered for the listed groups only, and ranked before they meet, so a group of any size gives ids_shown rows
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    shown = p.join(F.broadcast(top.select(*key)), key).withColumn("rank", rank).filter(F.col("rank") <= ids_shown)  # 200 groups at most
    ids = shown.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return top.join(ids, key).select(*key, "n", "ids").orderBy(*order)


def migration_pairs(t: Tables, limit: int | None = 20) -> DataFrame:
    """Birth place to death place counts, the most frequent first, ties by the first person."""
    p = t.persons.select("id", X.place_key(F.col("birth_place")).alias("from_place"), X.place_key(F.col("death_place")).alias("to_place"))
    p = p.filter("from_place <> '' and to_place <> '' and from_place <> to_place")
    found = p.groupBy("from_place", "to_place").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return found if limit is None else found.orderBy(F.desc("n"), "first_id").limit(max(0, min(limit, 200)))


def sex_totals(t: Tables) -> DataFrame:
    sex = F.coalesce("sex", F.lit("U"))
    return t.persons.agg(F.count(F.lit(1)).alias("persons"), _count(sex == "M").alias("male"), _count(sex == "F").alias("female"), _count(sex == "U").alias("unknown"))


def surname_groups(t: Tables) -> DataFrame:
    """Surname, number of members and their ids; blank names count as Unknown."""
    name = F.coalesce(F.nullif(F.col("surname"), F.lit("")), F.lit("Unknown"))
    return t.persons.groupBy(name.alias("surname")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def surname_members(t: Tables) -> DataFrame:
    """(surname, id, n): every person with its group and the group's size, as rows, so that no list grows with a name."""
    name = F.coalesce(F.nullif(F.col("surname"), F.lit("")), F.lit("Unknown"))
    p = t.persons.select(name.alias("surname"), "id")
    return p.join(p.groupBy("surname").agg(F.count(F.lit(1)).alias("n")), "surname")


def birth_centuries(t: Tables) -> DataFrame:
    year = F.nullif(F.regexp_extract(F.coalesce("birth_date", F.lit("")), "([0-9]{4})", 1), F.lit("")).cast("int")
    return t.persons.select((F.floor(year / 100) * 100).cast("int").alias("century")).filter("century is not null").groupBy("century").agg(F.count(F.lit(1)).alias("n"))


def orphaned_media(t: Tables, listed_only: bool = True) -> DataFrame:
    """Assets without a link; the listing also asks for the status 'unassigned'."""
    alone = t.media_assets.join(t.media_links.select(F.col("asset_id").alias("id")), "id", "left_anti")
    return alone.filter(F.col("status") == "unassigned") if listed_only else alone


def people_without_media(t: Tables) -> DataFrame:
    return t.persons.join(t.media_links.select(F.col("person_id").alias("id")), "id", "left_anti")


def asset_link_counts(t: Tables) -> DataFrame:
    """Every asset with its number of links and the status that follows from it."""
    links = t.media_links.groupBy(F.col("asset_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    n = F.coalesce("links", F.lit(0))
    return t.media_assets.join(links, "id", "left").select("id", n.alias("links"), F.when(n > 0, "assigned").otherwise("unassigned").alias("status"))


def person_media(t: Tables, person_id: int) -> DataFrame:
    mine = t.media_links.filter(F.col("person_id") == person_id).select(F.col("id").alias("link_id"), F.col("asset_id"))
    return mine.join(t.media_assets.withColumnRenamed("id", "asset_id"), "asset_id")


def sha_groups(t: Tables) -> DataFrame:
    """One asset per content hash: the first id and the number of files that hold it."""
    return t.media_assets.groupBy("sha256").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("files"))
