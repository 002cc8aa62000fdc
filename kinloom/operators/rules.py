"""Place normalisation rules: upsert, list, export, import and apply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import Tables
from ..sources.files import written
from .actions import Outcome, _replaced, name_places, stored

SCHEMA = "canonical string, variants array<string>, approved boolean, authority_source string, authority_id string, latitude double, longitude double, notes string"
_EXTRA = ("authority_source", "authority_id", "latitude", "longitude", "notes")


def _sorted_set(c):
    return F.array_sort(F.array_distinct(c), lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))


def upsert(rules: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rules by canonical name: variants are united (of several new rows too), an explicit approval wins, other fields keep what new
    rows leave out."""
    one = incoming.groupBy("canonical").agg(F.flatten(F.collect_list("variants")).alias("variants"), *[F.max(c).alias(c) for c in ("approved", *_EXTRA)])
    new = one.select("canonical", *[F.col(c).alias(f"_{c}") for c in ("variants", "approved", *_EXTRA)])
    empty = F.array().cast("array<string>")
    both = rules.join(new, "canonical", "full_outer")
    return both.select(
        "canonical", _sorted_set(F.concat(F.coalesce("variants", empty), F.coalesce("_variants", empty))).alias("variants"),
        F.coalesce("_approved", "approved", F.lit(False)).alias("approved"), *[F.coalesce(f"_{c}", c).alias(c) for c in _EXTRA],
    )


def listing(rules: DataFrame, approved: bool | None = None) -> DataFrame:
    some = rules if approved is None else rules.filter(F.col("approved") == approved)
    return some.orderBy("canonical")


def export(rules: DataFrame) -> DataFrame:
    """One JSON text of the approved rules, version 1."""
    place = F.when(F.col("authority_source").isNotNull() | F.col("authority_id").isNotNull(), F.struct(F.col("authority_source").alias("source"), F.col("authority_id").alias("id")))
    one = F.struct("canonical", "variants", place.alias("authority"), "latitude", "longitude", "notes")
    listed = rules.filter("approved").agg(F.array_sort(F.collect_list(F.struct("canonical", one.alias("rule")))).alias("r"))
    return listed.select(F.to_json(F.struct(F.lit(1).alias("version"), F.transform("r", lambda x: x["rule"]).alias("rules"))).alias("json"))


def import_json(rules: DataFrame, texts: DataFrame, column: str = "json") -> DataFrame:
    """Upsert of the rules in JSON texts; rules without a canonical name are passed over, approval defaults to true."""
    kind = "rules array<struct<canonical string, variants array<string>, approved boolean, authority struct<source string, id string>, latitude double, longitude double, notes string>>"
    r = texts.select(F.explode(F.from_json(column, kind)["rules"]).alias("r")).select("r.*").filter("trim(canonical) <> ''")
    new = r.select("canonical", "variants", F.coalesce("approved", F.lit(True)).alias("approved"), F.col("authority.source").alias("authority_source"), F.col("authority.id").alias("authority_id"), "latitude", "longitude", "notes")
    return upsert(rules, new)


def chosen_rules(rules: DataFrame, names: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The approved rules that apply_rules would use, by canonical name: its dry run."""
    some = rules.filter("approved")
    some = some if names is None else some.filter(F.col("canonical").isin(names))
    return some if limit is None else some.orderBy("canonical").limit(max(0, limit))


def failed_rules(some: DataFrame) -> DataFrame:
    """(canonical, error) of rules that cannot be applied: those without a name or without variants, blanks not counted."""
    return some.filter((F.col("canonical") == "") | (F.size("variants") == 0)).select("canonical", F.lit("canonical and variants are required").alias("error"))


def composed(named: DataFrame) -> DataFrame:
    """(variant, first, name) from (canonical, variant): the name that a text ends with when all rules run once, in order of canonical.

    A text takes the name of the first rule that has it as a variant; that name is then a text for the rules after this one.  So names
    are linked to the next rule, which always comes later: there are no cycles.  Links are doubled until they end, log2 of the longest
    chain times; each round is counted, because only chains of rules, not tables, tell how many are needed.
    """
    pairs = named.filter("variant <> canonical")
    after = pairs.select(F.col("variant").alias("name"), F.col("canonical").alias("next")).filter("next > name")
    links = after.join(named.select(F.col("canonical").alias("name")).distinct(), "name", "left_semi").groupBy("name").agg(F.min("next").alias("next"))
    while True:
        links = written(links, "rule-links")  # plans do not grow with the rounds
        twice = links.join(links.select(F.col("name").alias("next"), F.col("next").alias("then")), "next", "left")
        if twice.filter("then is not null").limit(1).count() == 0:
            break
        links = twice.select("name", F.coalesce("then", "next").alias("next"))
    first = pairs.groupBy("variant").agg(F.min("canonical").alias("first"))
    return first.join(links.select(F.col("name").alias("first"), "next"), "first", "left").select("variant", "first", F.coalesce("next", "first").alias("name"))


def apply_rules(t: Tables, rules: DataFrame, names: list[str] | None = None, limit: int | None = None) -> Outcome:
    """Every approved rule (or those of the names, or the first limit of them), as if applied one by one in order of canonical name.

    Places of persons and families that read as a variant take its canonical name, which later rules may name again; events keep their
    text and point to the place of the last rule that has it as a variant; canonical names without a place get one; a variant is
    registered with the first rule's place; and a rule's authority and coordinates fill what its place lacks.  Names and variants are
    trimmed.  A rule without name or variants changes nothing and is a row of the outcome's failed; the others are applied.
    """
    o = Outcome(t, action="applyRules", payload={"names": names, "limit": limit})
    trimmed = F.filter(F.transform("variants", lambda v: F.trim(v)), lambda v: v != "")
    chosen = chosen_rules(rules, names, limit)
    some = chosen.withColumns({"canonical": F.trim(F.coalesce("canonical", F.lit(""))), "variants": F.coalesce(trimmed, F.array().cast("array<string>"))})
    o.failed = failed_rules(some)
    some = some.filter((F.col("canonical") != "") & (F.size("variants") > 0))
    named = some.select("canonical", F.explode("variants").alias("variant")).distinct()
    ends = composed(named)
    last = named.groupBy("variant").agg(F.max("canonical").alias("canonical"))
    owner = named.groupBy("variant").agg(F.min("canonical").alias("canonical"))
    frames = name_places(t, ends.select("variant", F.col("name").alias("canonical")), o, events=last, owner=owner, places=some.select("canonical").distinct())
    extra = [c for c in ("authority_source", "authority_id", "latitude", "longitude") if c in rules.columns]
    if extra:
        more = some.groupBy(F.col("canonical").alias("name_canonical")).agg(*[F.min(c).alias(f"_{c}") for c in extra])
        p = frames["places"].join(more, "name_canonical", "left")
        lacking = reduce(Column.__or__, [F.col(c).isNull() & F.col(f"_{c}").isNotNull() for c in extra])
        o.before["places"] = p.filter(lacking).join(stored(t, "places").select("id"), "id", "left_semi").select(*frames["places"].columns)
        frames["places"] = p.select(*[F.coalesce(c, f"_{c}").alias(c) if c in extra else F.col(c) for c in frames["places"].columns])
    o.tables = _replaced(t, **frames)
    return o
