"""Reversible clean-up actions: pure functions from Tables to changed tables and an undo table of the rows as they were."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import canonical_timestamp, parse_date
from ..plans.tables import DERIVED, Tables
from .ids import add_rows


@dataclass
class Outcome:
    """Changed tables by name, and what undo needs: rows before the change and keys of rows the change made."""

    tables: Tables
    before: dict[str, DataFrame] = field(default_factory=dict)
    added: dict[str, DataFrame] = field(default_factory=dict)
    action: str = ""
    payload: dict = field(default_factory=dict)
    failed: DataFrame | None = None


def _replaced(t: Tables, **frames: DataFrame) -> Tables:
    known = {n: t.__dict__[n] for n in (*DERIVED, "date_normalizations", "places", "place_variants", "issues") if n in t.__dict__}
    return Tables(t.spark, t.sf_dir, **(known | frames))


#: Tables that a workspace may hold besides the derived ones, empty where it does not.
STORED = {
    "places": "id int, name_canonical string, authority_source string, authority_id string, latitude double, longitude double",
    "place_variants": "id int, place_id int, name_variant string",
    "date_normalizations": "id int, entity_type string, entity_id int, raw_value string, normalized string, precision string, qualifier string, confidence double, is_ambiguous boolean",
}


def stored(t: Tables, name: str) -> DataFrame:
    return t.__dict__[name] if name in t.__dict__ else t.spark.createDataFrame([], STORED[name])


def _resolve(t: Tables, o: Outcome, kinds: tuple, hit: Column) -> dict[str, DataFrame]:
    """Open issues of the kinds for which hit holds become resolved, where the tables hold issues."""
    if "issues" not in t.__dict__:
        return {}
    i = t.issues
    wanted = F.coalesce(F.col("issue_type").isin(*kinds) & (F.col("status") == "open") & hit, F.lit(False))
    o.before["issues"] = i.filter(wanted)
    return {"issues": _with(i, status=F.when(wanted, "resolved").otherwise(F.col("status")).alias("status"))}


def _swap(c: str, source: int, into: int) -> Column:
    return F.when(F.col(c) == source, F.lit(into)).otherwise(F.col(c)).cast("int").alias(c)


def _with(d: DataFrame, **changed: Column) -> DataFrame:
    return d.select(*[changed[c] if c in changed else F.col(c) for c in d.columns])


def undo(o: Outcome, table_key: dict[str, list[str]] | None = None) -> Tables:
    """The tables as they were: rows the action made or changed go, rows stored before it come back."""
    frames = {}
    for name, old in o.before.items():
        now = getattr(o.tables, name)
        key = (table_key or {}).get(name) or (["id"] if "id" in now.columns else now.columns)
        gone = old.select(*key)
        if name in o.added:
            gone = gone.unionByName(o.added[name].select(*key))
        frames[name] = now.join(gone.distinct(), key, "left_anti").unionByName(old)
    return _replaced(o.tables, **frames)


def _repoint(t: Tables, column_of: dict[str, tuple[str, ...]], source: int, into: int, o: Outcome) -> dict[str, DataFrame]:
    """Tables with source replaced by into in the named columns; rows that then repeat another are dropped."""
    out = {}
    for name, columns in column_of.items():
        d = getattr(t, name)
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.col(c) == source, F.lit(False))
        changed = _with(d, **{c: _swap(c, source, into) for c in columns})
        data = [c for c in d.columns if c != "id"]
        o.before[name] = d.filter(hit)
        if "id" not in d.columns:
            # a row that moves names into, so only rows that name it can be there already
            there = d.filter(reduce(Column.__or__, [F.col(c) == into for c in columns]))
            o.added[name] = _with(d.filter(hit), **{c: _swap(c, source, into) for c in columns}).join(there, data, "left_anti").distinct()
            out[name] = changed.distinct()
        elif name == "media_links":
            out[name] = _drop_collisions(d, changed, hit, data)
        else:
            out[name] = changed
    return out


def _drop_collisions(d: DataFrame, changed: DataFrame, hit: Column, data: list[str]) -> DataFrame:
    """Untouched rows and those changed rows that repeat none of them."""
    still = d.filter(~hit)
    moved = changed.join(d.filter(hit).select("id"), "id", "left_semi")
    other = still.select(*[F.col(c).alias(f"_{c}") for c in data])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in data]
    return still.unionByName(moved.join(other, on, "left_anti").select(*d.columns))


def merge_people(t: Tables, source: int, into: int, fill_missing: bool = True) -> Outcome:
    """Person source becomes part of into: links, spouses and edges point to into, repeats are dropped, the row goes with its notes.

    Open issues of duplicate persons that name either person are resolved.
    """
    o = Outcome(t, action="mergePeople", payload={"from": source, "into": into})
    frames = _repoint(t, {"events": ("person_id",), "media_links": ("person_id",), "families": ("husband_person_id", "wife_person_id"), "family_children": ("child_person_id",), "relationships": ("parent_person_id", "child_person_id")}, source, into, o)
    r = t.relationships
    hit = F.coalesce((F.col("parent_person_id") == source) | (F.col("child_person_id") == source), F.lit(False))
    swapped = {c: _swap(c, source, into) for c in ("parent_person_id", "child_person_id")}
    # an edge between the two persons would become one of a person to itself; edges are read once, moved or not
    between = hit & F.col("parent_person_id").isin(source, into) & F.col("child_person_id").isin(source, into)
    frames["relationships"] = _with(r.filter(~F.coalesce(between, F.lit(False))), **swapped).distinct()
    p = t.persons
    o.before["persons"] = p.filter(F.col("id").isin(source, into))
    if fill_missing:
        fields = [c for c in p.columns if c not in ("id", "xref")]
        spare = p.filter(F.col("id") == source).select(F.lit(into).alias("id"), *[F.col(c).alias(f"_{c}") for c in fields])
        p = p.join(spare, "id", "left").select(*[F.when(X.blank(F.col(c)), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in p.columns])
    frames["persons"] = p.filter(F.col("id") != source)
    own = F.coalesce(F.col("person_id") == source, F.lit(False))
    o.before["notes"], frames["notes"] = t.notes.filter(own), t.notes.filter(~own)
    frames |= _resolve(t, o, ("duplicate_person",), F.arrays_overlap("entity_ids", F.array(F.lit(source), F.lit(into))))
    o.tables = _replaced(t, **frames)
    return o


def merge_families(t: Tables, source: int, into: int) -> Outcome:
    """Family source becomes part of into: events, notes, links and children move, parent edges of into's spouses are added.

    Open issues of duplicate families that name either family are resolved.
    """
    o = Outcome(t, action="mergeFamilies", payload={"from": source, "into": into})
    own = [n for n in ("events", "notes", "media_links", "family_children") if "family_id" in getattr(t, n).columns]
    frames = _repoint(t, {n: ("family_id",) for n in own}, source, into, o)
    f = t.families
    o.before["families"] = f.filter(F.col("id") == source)
    frames["families"] = f.filter(F.col("id") != source)
    spouses = f.filter(F.col("id") == into).select(F.explode(F.array("husband_person_id", "wife_person_id")).alias("parent_person_id")).filter("parent_person_id is not null")
    kids = frames["family_children"].filter(F.col("family_id") == into).select("child_person_id")
    edges = spouses.withColumn("k", F.lit(1)).join(kids.withColumn("k", F.lit(1)), "k").select(F.col("parent_person_id").cast("int"), F.col("child_person_id").cast("int"), F.lit("parent").alias("rel_type"))  # two spouses at most
    new = edges.join(t.relationships, edges.columns, "left_anti").distinct()
    o.added["relationships"], o.before["relationships"] = new, t.relationships.limit(0)
    frames["relationships"] = t.relationships.unionByName(new)
    frames |= _resolve(t, o, ("duplicate_family", "duplicate_family_spouse_swap"), F.arrays_overlap("entity_ids", F.array(F.lit(source), F.lit(into))))
    o.tables = _replaced(t, **frames)
    return o


def dedupe_media_links(t: Tables, keep: list[int] | None = None) -> Outcome:
    """One link per (asset, person, family): the one named in keep, else the least id."""
    key = ["asset_id", "person_id", "family_id"]
    wanted = F.when(F.col("id").isin(keep or []), 0).otherwise(1)
    best = t.media_links.groupBy(*key).agg(F.min(F.struct(wanted.alias("w"), "id"))["id"].alias("id"))
    kept = t.media_links.join(best.select("id"), "id", "left_semi").select(*t.media_links.columns)
    gone = t.media_links.join(best.select("id"), "id", "left_anti").select(*t.media_links.columns)
    return Outcome(_replaced(t, media_links=kept), before={"media_links": gone}, action="dedupeMediaLinks")


def merge_media_assets(t: Tables, source: int, into: int) -> Outcome:
    o = Outcome(t, action="mergeMediaAssets", payload={"from": source, "into": into})
    o.before = {"media_links": t.media_links.filter(F.col("asset_id") == source), "media_assets": t.media_assets.filter(F.col("id") == source)}
    o.tables = _replaced(t, media_links=_with(t.media_links, asset_id=_swap("asset_id", source, into)), media_assets=t.media_assets.filter(F.col("id") != source))
    return o


def name_places(t: Tables, to: DataFrame, o: Outcome, events: DataFrame | None = None, owner: DataFrame | None = None, places: DataFrame | None = None) -> dict[str, DataFrame]:
    """Frames in which the places of to (variant, canonical; variants are distinct) are named.

    Persons and families that read exactly as a variant take the canonical name; events keep their text and point to its place (by the
    pairs of events, where they differ); canonical names (places) without a place get one, and variants that no place has yet are
    registered with it (by the pairs of owner).
    """
    events, owner = to if events is None else events, to if owner is None else owner
    canonical = to.select("canonical").distinct() if places is None else places
    frames = {}
    for name, columns in (("persons", ("birth_place", "death_place")), ("families", ("marriage_place",))):
        d = getattr(t, name)
        keep = d.columns
        for c in columns:
            d = d.join(to.select(F.col("variant").alias(c), F.col("canonical").alias(f"{c}_to")), c, "left")
        changes = [F.coalesce(F.col(f"{c}_to") != F.col(c), F.lit(False)) for c in columns]
        o.before[name] = d.filter(reduce(Column.__or__, changes)).select(*keep)
        frames[name] = d.select(*[F.coalesce(f"{c}_to", c).alias(c) if c in columns else F.col(c) for c in keep])
    places, variants = stored(t, "places"), stored(t, "place_variants")
    names = canonical.select(F.col("canonical").alias("name_canonical"))
    frames["places"] = add_rows(places, names.join(places.select("name_canonical"), "name_canonical", "left_anti"))
    ids = frames["places"].groupBy(F.col("name_canonical").alias("canonical")).agg(F.min("id").alias("place_id"))
    known = events.join(ids, "canonical")
    owned = owner.join(ids, "canonical")
    frames["place_variants"] = add_rows(variants, owned.select("place_id", F.col("variant").alias("name_variant")).join(variants.select("name_variant"), "name_variant", "left_anti"))
    e = t.events if "place_id" in t.events.columns else t.events.withColumn("place_id", F.lit(None).cast("int"))
    joined = e.join(known.select(F.col("variant").alias("place_raw"), F.col("place_id").alias("_to")), "place_raw", "left")
    o.before["events"] = joined.filter("_to is not null").select(*e.columns)
    frames["events"] = joined.select(*[F.coalesce("_to", c).alias(c) if c == "place_id" else F.col(c) for c in e.columns])
    for name, old in (("places", places), ("place_variants", variants)):
        o.before[name], o.added[name] = old.limit(0), frames[name].join(old.select("id"), "id", "left_anti")
    return frames


def normalize_places(t: Tables, canonical: str, variants: list[str]) -> Outcome:
    """name_places for one canonical name; open place issues that mention it or a variant are resolved."""
    o = Outcome(t, action="normalizePlaces", payload={"canonical": canonical, "variants": variants})
    to = t.spark.createDataFrame([(v, canonical) for v in dict.fromkeys(variants)], "variant string, canonical string")
    frames = name_places(t, to, o)
    said = reduce(Column.__or__, [F.col("explanation_json").contains(x) for x in [canonical, *variants] if x])
    frames |= _resolve(t, o, ("place_cluster", "place_similarity"), said)
    o.tables = _replaced(t, **frames)
    return o


def applicable_dates(normalized: DataFrame) -> DataFrame:
    """Normalised dates that may replace the text: certain, without qualifier."""
    return normalized.filter("normalized is not null and qualifier is null and not is_ambiguous and entity_id is not null")


def normalize_dates(t: Tables, normalized: DataFrame) -> Outcome:
    """Stores normalised dates, and brings them to persons and events.

    Stored rows of equal entity and raw value are replaced.  Persons take applicable dates where their text still reads as it
    did when it was normalised; events get the timestamp of the normalised date.
    """
    o = Outcome(t, action="normalizeDates")
    p = t.persons
    fit = applicable_dates(normalized).filter("entity_type = 'person'")
    for c in ("birth_date", "death_date"):
        new = fit.filter(F.col("field") == c).select(F.col("entity_id").alias("id"), F.col("raw_value").alias(c), F.col("normalized").alias(f"{c}_to"))
        p = p.join(new, ["id", c], "left")
    changed = F.coalesce(F.col("birth_date_to") != F.col("birth_date"), F.lit(False)) | F.coalesce(F.col("death_date_to") != F.col("death_date"), F.lit(False))
    o.before["persons"] = p.filter(changed).select(*t.persons.columns)
    out = p.select(*[F.coalesce(f"{c}_to", c).alias(c) if c in ("birth_date", "death_date") else F.col(c) for c in t.persons.columns])
    held, key = stored(t, "date_normalizations"), ["entity_type", "entity_id", "raw_value"]
    facts = ["normalized", "precision", "qualifier", "confidence", "is_ambiguous"]
    rows = normalized.groupBy(*key).agg(F.max(F.struct(*facts)).alias("f")).select(*key, "f.*")
    again = held.select("id", *key).join(rows, key).select(*held.columns)
    o.before["date_normalizations"] = held.join(again.select("id"), "id", "left_semi").select(*held.columns)
    all_ = add_rows(held.join(again.select("id"), "id", "left_anti").select(*held.columns).unionByName(again), rows.join(held.select(*key), key, "left_anti"))
    o.added["date_normalizations"] = all_.join(held.select("id"), "id", "left_anti").select(*held.columns)
    e = t.events if "date_canonical" in t.events.columns else t.events.withColumn("date_canonical", F.lit(None).cast("timestamp_ntz"))
    when = normalized.filter("entity_type = 'event'").groupBy(F.col("entity_id").alias("id")).agg(F.max(F.struct("raw_value", "normalized")).alias("n"))
    joined = e.join(when, "id", "left")
    o.before["events"] = joined.filter("n is not null").select(*e.columns)
    stamped = joined.withColumn("date_canonical", F.when(F.col("n").isNull(), F.col("date_canonical")).otherwise(canonical_timestamp(F.col("n.normalized"), F.col("date_canonical"))))
    o.tables = _replaced(t, persons=out, date_normalizations=all_, events=stamped.select(*e.columns))
    return o


def event_timestamps(events: DataFrame) -> DataFrame:
    """events with date_canonical from the normalised date."""
    d = events.withColumn("_n", parse_date(F.col("date_raw"))["normalized"])
    now = F.col("date_canonical") if "date_canonical" in events.columns else F.lit(None).cast("timestamp_ntz")
    return d.withColumn("date_canonical", canonical_timestamp(F.col("_n"), now)).drop("_n")


def standardize_fields(t: Tables, suggestions: DataFrame) -> Outcome:
    """Given names and surnames take their suggestions (rows of name_suggestions)."""
    s = suggestions.select("id", "given_to", "surname_to")
    before = t.persons.join(s.select("id"), "id", "left_semi").select(*t.persons.columns)
    p = t.persons.join(s, "id", "left")
    out = p.select(*[F.coalesce(f"{c}_to", c).alias(c) if c in ("given", "surname") else F.col(c) for c in t.persons.columns])
    return Outcome(_replaced(t, persons=out), before={"persons": before}, action="standardizeFields")


def clean_person(t: Tables, person_id: int | None = None) -> DataFrame:
    """(id, field, raw, cleaned, confidence): what cleaning dates and places would write; qualifiers do not stop it."""
    p = t.persons if person_id is None else t.persons.filter(F.col("id") == person_id)
    long = p.unpivot(["id"], ["birth_date", "death_date", "birth_place", "death_place"], "field", "raw").filter("raw <> ''")
    d = parse_date(F.col("raw"))
    is_date = F.col("field").endswith("date")
    long = long.withColumns({"d": F.when(is_date, d), "place": F.when(~is_date, X.norm_place(F.col("raw")))})
    cleaned = F.when(is_date & ~F.col("d.ambiguous"), F.col("d.normalized")).when(~is_date, F.nullif(F.col("place"), F.lit("")))
    return long.select("id", "field", "raw", cleaned.alias("cleaned"), F.when(is_date, F.col("d.confidence")).otherwise(0.65).alias("confidence")).filter("cleaned is not null and cleaned <> raw")


def apply_clean(t: Tables, person_id: int | None = None, min_confidence: float = 0.0) -> Outcome:
    """What clean_person shows, written to the persons."""
    o = Outcome(t, action="cleanPerson", payload={"id": person_id})
    fields = ["birth_date", "death_date", "birth_place", "death_place"]
    some = clean_person(t, person_id).filter(F.col("confidence") >= min_confidence)
    wide = some.groupBy("id").agg(*[F.max(F.when(F.col("field") == c, F.col("cleaned"))).alias(f"{c}_to") for c in fields])
    p = t.persons
    o.before["persons"] = p.join(wide.select("id"), "id", "left_semi").select(*p.columns)
    joined = p.join(wide, "id", "left")
    o.tables = _replaced(t, persons=joined.select(*[F.coalesce(f"{c}_to", c).alias(c) if c in fields else F.col(c) for c in p.columns]))
    return o


def enrich_place(places: DataFrame, found: DataFrame, force: bool = False) -> DataFrame:
    """places with authority and coordinates of found (by id) where they are missing, or everywhere with force."""
    columns = ["authority_source", "authority_id", "latitude", "longitude"]
    d = places.join(found.select("id", *[F.col(c).alias(f"_{c}") for c in columns]), "id", "left")
    take = lambda c: F.coalesce(f"_{c}", c) if force else F.coalesce(c, f"_{c}")
    return d.select(*[take(c).alias(c) if c in columns else F.col(c) for c in places.columns])
