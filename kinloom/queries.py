"""Named queries over the derived genealogy tables, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators import actions, analytics, graph, quality, records, rules, search
from .plans.tables import Tables, with_tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The rule set of the apply_rules queries.
RULES = "select * from values ('Nation 0, Africa', array('NATION_0, AFRICA', 'nation_0; AFRICA'), true), ('Nation 1, America', array('NATION_1, AMERICA', 'NATION_1,  AMERICA.'), true), ('Nowhere', array('NATION_2, ASIA'), false) as r(canonical, variants, approved)"


def query(name: str, sql: str | None = None, tables: tuple = ()):
    """Register a function of Tables under a name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_tables(sql, *tables) if tables else sql
        return f

    return put


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'))"


def ntext(x: str) -> str:
    return f"trim(lower(coalesce({x}, '')))"


def pkey(x: str) -> str:
    return norm(f"replace({x}, ';', ',')")


def place(x: str) -> str:
    v = f"regexp_replace(regexp_replace(replace(lower(coalesce({x}, '')), '.', ' '), '[;|]+', ',', 'g'), '[^a-z0-9, ]+', ' ', 'g')"
    for short, full in (("st", "street"), ("mt", "mount"), ("co", "county")):
        v = f"replace({v}, ' {short} ', ' {full} ')"
    return f"trim(regexp_replace({v}, ' +', ' ', 'g'))"


def y1(x: str) -> str:
    return rf"cast(nullif(regexp_extract(coalesce({x}, ''), '(1[5-9]\d\d|20\d\d)', 1), '') as int)"


def y2(x: str) -> str:
    return f"list_min(list_transform(regexp_extract_all(coalesce({x}, ''), '([0-9]{{4}})', 1), lambda y: cast(y as int)))"


def dec(y: str) -> str:
    return f"cast(floor({y} / 10.0) * 10 as int)"


PERSON = ("id", "given", "surname")

# ---- analytics -----------------------------------------------------------------------------------------------------------

_SERIES = f"""
select series, {dec('yr')} as "decade", count(*) as n from (
  select 'births' as series, {y2('birth_date')} as yr from t_persons union all
  select 'deaths', {y2('death_date')} from t_persons union all
  select 'marriages', {y2('marriage_date')} from t_families) s where yr > 0 group by 1, 2"""


@query("decade_timeseries", _SERIES, ("persons", "families"))
def _(t):
    return analytics.timeseries(t)


@query("decade_pivot", f"""
select "decade", cast(coalesce(sum(case when series = 'births' then n end), 0) as bigint) as births, cast(coalesce(sum(case when series = 'deaths' then n end), 0) as bigint) as deaths,
  cast(coalesce(sum(case when series = 'marriages' then n end), 0) as bigint) as marriages from ({_SERIES}) x group by 1""", ("persons", "families"))  # fmt: skip
def _(t):
    return analytics.decade_pivot(t)


@query("table_counts", """
select 'people' as name, count(*) as n from t_persons union all select 'families', count(*) from t_families union all select 'notes', count(*) from t_notes
union all select 'media_assets', count(*) from t_media_assets union all select 'media_links', count(*) from t_media_links""", ("persons", "families", "notes", "media_assets", "media_links"))  # fmt: skip
def _(t):
    return analytics.table_counts(t)


_COVER = {"birth_date": f"{y2('birth_date')} is not null", "death_date": f"{y2('death_date')} is not null"} | {c: f"trim(coalesce({c}, '')) <> ''" for c in ("birth_place", "death_place", "sex")}


@query("coverage_overview", " union all ".join(f"select '{k}' as field, count(case when {c} then 1 end) as known, count(*) as total, round_even(count(case when {c} then 1 end) / cast(greatest(count(*), 1) as double) * 100, 1) as pct from t_persons" for k, c in _COVER.items()), ("persons",))
def _(t):
    return analytics.coverage(t)


for _c, _name in (("surname", "top_surnames"), ("birth_place", "top_birth_places")):
    query(_name, f"select {_c} as value, count(*) as n from t_persons where {_c} is not null and {_c} <> '' group by 1 order by n desc, value limit 15", ("persons",))(lambda t, c=_c: analytics.top_values(t.persons, c))


@query("children_distribution", "select children, count(*) as families from (select family_id, count(*) as children from t_family_children group by 1) x group by 1", ("family_children",))
def _(t):
    return analytics.children_distribution(t)


@query("children_summary", "select round(avg(children), 2) as average, max(children) as largest, count(*) as families from (select family_id, count(*) as children from t_family_children group by 1) x", ("family_children",))
def _(t):
    return analytics.children_summary(t)


@query("exact_duplicates", f"""
select given, surname, birth_year, count(*) as n, array_to_string(list_sort(list(id))[1:25], ',') as ids
from (select id, {ntext('given')} as given, {ntext('surname')} as surname, {y2('birth_date')} as birth_year from t_persons) p
where given <> '' and surname <> '' and birth_year > 0 group by 1, 2, 3 having count(*) > 1 order by n desc, surname, given, birth_year limit 50""", ("persons",))  # fmt: skip
def _(t):
    return analytics.exact_duplicates(t).withColumn("ids", F.array_join("ids", ","))


_PAIRS = f"""select from_place, to_place, count(*) as n, min(id) as first_id from (select id, {pkey('birth_place')} as from_place, {pkey('death_place')} as to_place from t_persons) p
where from_place <> '' and to_place <> '' and from_place <> to_place group by 1, 2"""


@query("migration_pairs", _PAIRS + " order by n desc, first_id limit 20", ("persons",))
def _(t):
    return analytics.migration_pairs(t)


@query("migration_pairs_all", _PAIRS, ("persons",))
def _(t):
    return analytics.migration_pairs(t, None)


@query("sex_totals", "select count(*) as persons, count(case when sex = 'M' then 1 end) as male, count(case when sex = 'F' then 1 end) as female, count(case when coalesce(sex, 'U') = 'U' then 1 end) as \"unknown\" from t_persons", ("persons",))
def _(t):
    return analytics.sex_totals(t)


@query("surname_groups", "select coalesce(nullif(surname, ''), 'Unknown') as surname, count(*) as n, sha256(array_to_string(list_sort(list(id)), ',')) as members from t_persons group by 1", ("persons",))
def _(t):
    return analytics.surname_groups(t).select("surname", "n", F.sha2(F.array_join("ids", ","), 256).alias("members"))


@query("birth_centuries", "select cast(floor(y / 100.0) * 100 as int) as century, count(*) as n from (select cast(nullif(regexp_extract(coalesce(birth_date, ''), '([0-9]{4})', 1), '') as int) as y from t_persons) p where y is not null group by 1", ("persons",))
def _(t):
    return analytics.birth_centuries(t)


# ---- search and drill-down -----------------------------------------------------------------------------------------------

@query("people_search", "select id, given, surname from t_persons where given ilike '%RED%' or surname ilike '%RED%' order by surname nulls first, given nulls first, id limit 200", ("persons",))
def _(t):
    return search.people_search(t, "RED").select(*PERSON)


@query("full_name_search", "select id, given, surname from t_persons where contains(lower(concat_ws(' ', given, surname)), 'ring build')", ("persons",))
def _(t):
    return search.full_name_search(t, "Ring Build").select(*PERSON)


@query("people_by_ids", "select id, given, surname from t_persons where id in (3, 5, 8, 13)", ("persons",))
def _(t):
    return search.by_ids(t.persons, ["3", "5", "x", "8", 13]).select(*PERSON)


@query("person_summary", f"select id, given, surname, {y2('birth_date')} as birth_year, {y2('death_date')} as death_year from t_persons", ("persons",))
def _(t):
    return search.person_summary(t.persons).select(*PERSON, "birth_year", "death_year")


@query("paged_drilldown", "select id, given, surname from t_persons where lower(surname) = 'machinery' order by id limit 20 offset 20", ("persons",))
def _(t):
    return search.page(search.drilldown(t, "surname", surname=" Machinery ").orderBy("id"), 2, 20).select(*PERSON)



_DRILL = {
    "surname": ({"surname": "BUILDING"}, "lower(surname) = 'building'"),
    "birth_place": ({"place": "nation_3; europe"}, "lower(trim(birth_place)) = 'nation_3; europe'"),
    "birth_decade": ({"decade": 1900}, f"{dec(y2('birth_date'))} = 1900"),
    "death_decade": ({"decade": 1950}, f"{dec(y2('death_date'))} = 1950"),
    "marriage_decade": ({"decade": 1900}, f"id in (select unnest([husband_person_id, wife_person_id]) from t_families where {dec(y2('marriage_date'))} = 1900)"),
    "children_count": ({"children": 9}, "id in (select unnest([husband_person_id, wife_person_id]) from t_families where id in (select family_id from t_family_children group by 1 having count(*) = 9))"),
    "migration_pair": ({"from_place": "NATION_4; asia", "to_place": "nation_9,  ASIA"}, f"{pkey('birth_place')} = 'nation_4, asia' and {pkey('death_place')} = 'nation_9, asia'"),
}
for _k, (_f, _w) in _DRILL.items():
    query(f"drill_{_k}", f"select id, given, surname from t_persons where {_w}", ("persons", "families", "family_children") if "t_families" in _w else ("persons",))(lambda t, k=_k, f=_f: search.drilldown(t, k, **f).select(*PERSON))


@query("node_quality", """
select id, case when (trim(coalesce(given, '')) <> '' or trim(coalesce(surname, '')) <> '') and (trim(coalesce(birth_date, '')) <> '' or trim(coalesce(birth_place, '')) <> '') then 'high'
  when trim(coalesce(given, '')) <> '' or trim(coalesce(surname, '')) <> '' then 'medium' else 'low' end as quality from t_persons""", ("persons",))  # fmt: skip
def _(t):
    return search.node_quality(t.persons).select("id", "quality")


# ---- media ---------------------------------------------------------------------------------------------------------------

@query("orphaned_media", "select id from t_media_assets a where status = 'unassigned' and not exists (select 1 from t_media_links l where l.asset_id = a.id)", ("media_assets", "media_links"))
def _(t):
    return analytics.orphaned_media(t).select("id")


@query("people_without_media", "select id from t_persons p where not exists (select 1 from t_media_links l where l.person_id = p.id)", ("persons", "media_links"))
def _(t):
    return analytics.people_without_media(t).select("id")


@query("asset_link_counts", "select a.id, count(l.id) as links, case when count(l.id) > 0 then 'assigned' else 'unassigned' end as status from t_media_assets a left join t_media_links l on l.asset_id = a.id group by a.id", ("media_assets", "media_links"))
def _(t):
    return analytics.asset_link_counts(t)


@query("person_media", "select l.id as link_id, l.asset_id, a.sha256 from t_media_links l join t_media_assets a on a.id = l.asset_id where l.person_id = 10", ("media_assets", "media_links"))
def _(t):
    return analytics.person_media(t, 10).select("link_id", "asset_id", "sha256")


@query("sha_dedupe", "select sha256, min(id) as id, count(*) as files from t_media_assets group by 1", ("media_assets",))
def _(t):
    return analytics.sha_groups(t)


# ---- detectors -----------------------------------------------------------------------------------------------------------

def flat(d: DataFrame) -> DataFrame:
    return d.select("issue_type", "severity", "entity_type", F.array_join("entity_ids", ",").alias("ids"), "confidence", "impact_score")


def issue_sql(kind: str, severity: str, entity: str, ids: str, confidence: str, impact: str, source: str) -> str:
    return f"select '{kind}' as issue_type, {severity} as severity, {entity} as entity_type, {ids} as ids, cast({confidence} as double) as confidence, cast({impact} as double) as impact_score from {source}"


def _s(*names: str) -> str:
    return " || ',' || ".join(f"cast({n} as varchar)" for n in names)


_LIVES = f"(select id, {y1('birth_date')} as born, {y1('death_date')} as died from t_persons)"
_PC = f"(select r.parent_person_id as p, r.child_person_id as c, a.born as pb, a.died as pd, b.born as cb from t_relationships r join {_LIVES} a on a.id = r.parent_person_id left join {_LIVES} b on b.id = r.child_person_id) x"
_WED = f"(select f.id as f, p.id as p, {y1('f.marriage_date')} as wed, p.born, p.died from (select id, marriage_date, unnest([husband_person_id, wife_person_id]) as s from t_families) f join {_LIVES} p on p.id = f.s) x"
_REL = ("persons", "families", "family_children", "relationships")
_PLACEHOLDER = "('unknown', 'n/a', 'na', 'none')"
_ISSUES = {
    "orphan_event": ("'error'", "'event'", _s("id"), "0.9", "1", "t_events where person_id is null and family_id is null", ("events",)),
    "orphan_family": ("'warning'", "'family'", _s("id"), "0.85", "0.5", "t_families where husband_person_id is null and wife_person_id is null and id not in (select family_id from t_family_children)", ("families", "family_children")),
    "impossible_timeline": ("'error'", "'person'", _s("id"), "0.95", "1", f"{_LIVES} x where died < born", ("persons",)),
    "parent_child_age": ("'warning'", "'relationship'", _s("p", "c"), "0.8", "0.8", f"{_PC} where pb > cb - 12", _REL),
    "parent_child_death": ("'warning'", "'relationship'", _s("p", "c"), "0.85", "0.8", f"{_PC} where pd < cb", _REL),
    "marriage_too_early": ("'warning'", "'family'", _s("f", "p"), "0.8", "0.7", f"{_WED} where wed < born + 12", ("persons", "families")),
    "marriage_after_death": ("'warning'", "'family'", _s("f", "p"), "0.85", "0.7", f"{_WED} where wed > died", ("persons", "families")),
    "placeholder_name": ("'warning'", "'person'", _s("id"), "0.8", "0.2", f"t_persons where {norm('given')} in {_PLACEHOLDER} or {norm('surname')} in {_PLACEHOLDER}", ("persons",)),
    "duplicate_media_link": ("'info'", "'media_link'", "array_to_string(list_sort(list(id)), ',')", "0.9", "count(*)", "t_media_links group by asset_id, person_id, family_id having count(*) > 1", ("media_links",)),
}
for _k, (_sev, _ent, _i, _conf, _imp, _src, _tabs) in _ISSUES.items():
    query(_k, issue_sql(_k, _sev, _ent, _i, _conf, _imp, _src), _tabs)(lambda t, k=_k: flat(quality.DETECTORS[k](t)))

_COUPLE = f"(select id, husband_person_id as h, wife_person_id as w, least(husband_person_id, wife_person_id) as lo, greatest(husband_person_id, wife_person_id) as hi, {y1('marriage_date')} as y, {place('marriage_place')} as pl from t_families where husband_person_id is not null and wife_person_id is not null)"
_AGREE = "(case when a.y = b.y then 1 else 0 end + case when a.pl <> '' and a.pl = b.pl then 1 else 0 end)"
query("duplicate_family", issue_sql("duplicate_family", "'info'", "'family'", _s("a.id", "b.id"), f"round(0.7 + 0.15 * {_AGREE}, 2)", "1", f"{_COUPLE} a join {_COUPLE} b on a.lo = b.lo and a.hi = b.hi and a.id < b.id where {_AGREE} >= 1"), ("families",))(lambda t: flat(quality.duplicate_families(t)))
_NAMED = f"(select c.*, least(p.n, q.n) as n1, greatest(p.n, q.n) as n2 from {_COUPLE} c join (select id, trim({norm('given')} || ' ' || {norm('surname')}) as n from t_persons) p on p.id = c.h join (select id, trim({norm('given')} || ' ' || {norm('surname')}) as n from t_persons) q on q.id = c.w where p.n <> '' and q.n <> '')"
query("duplicate_family_swap", issue_sql("duplicate_family_spouse_swap", "'info'", "'family'", _s("a.id", "b.id"), f"round(0.6 + 0.15 * {_AGREE}, 2)", "1", f"{_NAMED} a join {_NAMED} b on a.n1 = b.n1 and a.n2 = b.n2 and a.id < b.id where {_AGREE} >= 1 and (a.lo <> b.lo or a.hi <> b.hi)"), ("persons", "families"))(lambda t: flat(quality.duplicate_families_swapped(t)))

_VALUES = """(select 0 as r, id, 0 as f, place_raw as value from t_events union all select 1, id, 0, birth_place from t_persons union all select 1, id, 1, death_place from t_persons)"""
_COUNTS = f"(select value, count(*) as n, min(r * 1e15 + cast(id as double) * 2 + f) as first, {place('value')} as norm from {_VALUES} v where value <> '' group by value)"


@query("place_clusters", f"""
select norm, count(*) as variants, cast(sum(n) as bigint) as refs, arg_min(value, -n * 1e17 + first) as canonical, string_agg(value || '=' || cast(n as varchar), '|' order by n desc, first) as listed
from {_COUNTS} c group by norm having count(*) > 1""", ("persons", "events"))  # fmt: skip
def _(t):
    listed = F.array_join(F.transform("listed", lambda x: F.concat(x["value"], F.lit("="), x["count"].cast("string"))), "|")
    return quality.place_variants(t).select("norm", "variants", "refs", "canonical", listed.alias("listed"))


_TITLE = r"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
_FLAT = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _suggest(c: str) -> tuple[str, str, str]:
    """(suggestion, trimmed?, recased?) for names of plain letters and spaces, as the derived tables have them."""
    f = _FLAT.format(x=c)
    t = _TITLE.format(x=f)
    recased = f"(({f} = upper({f}) or {f} = lower({f})) and {t} <> {f} and regexp_matches({f}, '[A-Za-z]'))"
    return f"case when {recased} then {t} else {f} end", f"{f} <> {c}", recased


def _name_sql() -> str:
    g, gt, gr = _suggest("given")
    s, st, sr = _suggest("surname")
    inner = f"select id, given, surname, {g} as g, {gt} as gt, {gr} as gr, {s} as s, {st} as st, {sr} as sr, {norm('given')} in {_PLACEHOLDER} as gp, {norm('surname')} in {_PLACEHOLDER} as sp from t_persons"
    mid = f"select id, given, surname, g, s, coalesce((gt or gr) and not gp, false) as gc, coalesce((st or sr) and not sp, false) as sc, gt, gr, st, sr from ({inner}) a"
    return f"""select id, case when gc then g end as given_to, case when sc then s end as surname_to,
  concat_ws(',', case when (gc and gr) or (sc and sr) then 'title_case' end, case when (gc and gt) or (sc and st) then 'trim_whitespace' end) as reasons,
  cast(gc as int) + cast(sc as int) as fields from ({mid}) b where gc or sc"""


@query("name_standardization", _name_sql(), ("persons",))
def _(t):
    return quality.name_suggestions(t).select("id", "given_to", "surname_to", F.array_join("reasons", ",").alias("reasons"), "fields")


def date_sql(raw: str) -> dict[str, str]:
    """The cascade for trimmed non-empty ASCII dates of years 1000 and later."""
    num = rf"regexp_matches({raw}, '^\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{3,4}}$')"
    a, b = (rf"try_cast(regexp_extract({raw}, '^(\d{{1,2}})[/-](\d{{1,2}})[/-]', {k}) as int)" for k in (1, 2))
    either = f"({num} and {a} between 1 and 12 and {b} between 1 and 12 and {a} <> {b})"
    rng = rf"regexp_matches({raw}, '(?i)\bBET\s+\d{{3,4}}\s+AND\s+\d{{3,4}}')"
    rv = rf"regexp_extract({raw}, '(?i)\bBET\s+(\d{{3,4}})\s+AND\s+(\d{{3,4}})', 1) || '/' || regexp_extract({raw}, '(?i)\bBET\s+(\d{{3,4}})\s+AND\s+(\d{{3,4}})', 2)"
    q = rf"lower(nullif(regexp_extract({raw}, '(?i)\b(ABT|ABOUT|BEF|AFT|EST|CALC|CIRCA|CA)\b', 1), ''))"
    parts = lambda p, y, m, d: f"try_cast(regexp_extract({raw}, '{p}', {y}) || '-' || lpad(regexp_extract({raw}, '{p}', {m}), 2, '0') || '-' || lpad(regexp_extract({raw}, '{p}', {d}), 2, '0') as date)"
    iso, sl, tu = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
    day = f"strftime(coalesce({parts(iso, 1, 2, 3)}, {parts(sl, 3, 2, 1)}, {parts(sl, 3, 1, 2)}, {parts(tu, 1, 2, 3)}), '%Y-%m-%d')"
    head = r"^([A-Za-z]{3,9}|\d{1,2})[ ,/]+(\d{3,4})"
    w = f"lower(regexp_extract({raw}, '{head}', 1))"
    mon = f"nullif(case when regexp_matches({w}, '^\\d') then try_cast({w} as int) else cast(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr({w}, 1, 3)) as int) end, 0)"
    my = f"lpad(regexp_extract({raw}, '{head}', 2), 4, '0') || '-' || lpad(cast({mon} as varchar), 2, '0')"
    y = f"cast({y1(raw)} as varchar)"
    pick = lambda *v: f"case when {either} then {v[0]} when {rng} then {v[1]} when {day} is not null then {v[2]} when {mon} is not null then {v[3]} when {y} is not null then {v[4]} else {v[5]} end"
    return {
        "normalized": pick("null", rv, day, my, y, "null"), "precision": pick("null", "'range'", "'day'", "'month'", "'year'", "null"), "qualifier": pick("null", "'between'", q, q, q, q),
        "confidence": f"cast({pick('0.0', '0.7', '0.95', '0.85', f'case when {q} is not null then 0.6 else 0.7 end', '0.0')} as double)", "is_ambiguous": pick("true", "false", "false", "false", "false", "true"),
    }


_DATES = "(select 'person' as entity_type, id as entity_id, 'birth_date' as field, birth_date as raw_value from t_persons union all select 'person', id, 'death_date', death_date from t_persons union all select 'event', id, 'date_raw', date_raw from t_events) d where raw_value <> ''"


@query("date_normalization", "select entity_type, entity_id, field, raw_value, " + ", ".join(f'{v} as "{k}"' for k, v in date_sql("raw_value").items()) + f" from {_DATES}", ("persons", "events"))
def _(t):
    return quality.date_normalizations(t)


_NAMEP = f"(select id, {norm('surname')} as l, {y1('birth_date')} as b, {y1('death_date')} as d, {norm('given')} || ' ' || {norm('surname')} as n, {place('birth_place')} as p from t_persons)"
_EXTRA = "(case when abs(a.b - b.b) <= 1 then 0.25 else 0 end + case when abs(a.d - b.d) <= 1 then 0.1 else 0 end + case when a.p <> '' and a.p = b.p then 0.15 else 0 end)"


@query("person_candidates", f"""
select a.id as id_a, b.id as id_b from {_NAMEP} a join {_NAMEP} b on a.l = b.l and coalesce(a.b, 0) = coalesce(b.b, 0) and a.id < b.id
where 2 * least(length(a.n), length(b.n)) >= 0.68 * (length(a.n) + length(b.n)) and {_EXTRA} + 0.5 >= 0.55""", ("persons",))  # fmt: skip
def _(t):
    return quality.person_candidates(t).select("id_a", "id_b")


def may_reach(a: str, b: str, least: float) -> str:
    times = lambda x, ch: f"(length({x}) - length(replace({x}, '{ch}', '')))"
    shared = " + ".join(f"least({times(a, ch)}, {times(b, ch)})" for ch in "abcdefghijklmnopqrstuvwxyz0123456789 ,")
    both = f"(length({a}) + length({b}))"
    return f"2 * least(length({a}), length({b})) >= {least} * {both} and 2 * ({shared}) >= {least} * {both}"


@query("place_candidates", f"""
select a.value as value_a, b.value as value_b from {_COUNTS} a join {_COUNTS} b on a.norm <> b.norm and a.norm <> '' and b.norm <> ''
and (lower(a.value) < lower(b.value) or (lower(a.value) = lower(b.value) and a.first < b.first)) where {may_reach('a.norm', 'b.norm', 0.8)}""", ("persons", "events"))  # fmt: skip
def _(t):
    return quality.place_candidates(t).select("value_a", "value_b")


_FILES = r"(select id, trim(regexp_replace(lower(regexp_replace(original_filename, '\.[^./]*$', '')), '[^a-z0-9]+', ' ', 'g')) as norm from t_media_assets)"


@query("asset_candidates", f"select a.id as id_a, b.id as id_b from {_FILES} a join {_FILES} b on substr(a.norm, 1, 4) = substr(b.norm, 1, 4) and a.id < b.id where {may_reach('a.norm', 'b.norm', 0.92)}", ("media_assets",))
def _(t):
    return quality.asset_candidates(t).select("id_a", "id_b")


@query("duplicate_people")
def _(t):
    return flat(quality.duplicate_people(t))


@query("place_similarity")
def _(t):
    return quality.similar_places(t).select("issue_type", "confidence", "impact_score", "explanation_json")


@query("duplicate_assets")
def _(t):
    return flat(quality.duplicate_media_assets(t))


@query("scan_counts")
def _(t):
    return quality.scan_counts(quality.run_detection(t))


@query("dq_summary")
def _(t):
    return quality.summary(quality.run_detection(t), quality.date_normalizations(t))


# ---- graph ---------------------------------------------------------------------------------------------------------------

_BFS = """
, e as (select parent_person_id as a, child_person_id as b from t_relationships union select child_person_id, parent_person_id from t_relationships),
d0 as (select 0 as id, 0 as distance), d1 as (select distinct e.b as id, 1 as distance from e join d0 on e.a = d0.id where e.b not in (select id from d0)),
d2 as (select distinct e.b as id, 2 as distance from e join d1 on e.a = d1.id where e.b not in (select id from d0) and e.b not in (select id from d1)),
s as (select * from d0 union all select * from d1 union all select * from d2)
"""
_GRAPH = ("persons", "families", "family_children", "relationships")


def _around(t: Tables) -> DataFrame:
    return graph.neighbourhood(t, t.spark.range(1).select(F.col("id").cast("int").alias("id")), 2)


@query("graph_bfs", _BFS + "select id, distance from s", _GRAPH)
def _(t):
    return _around(t)


@query("graph_edges", _BFS + """, f as (select * from t_families where husband_person_id in (select id from s) or wife_person_id in (select id from s))
select 'spouse_h_' || cast(id as varchar) as edge, 'person_' || cast(husband_person_id as varchar) as source, 'family_' || cast(id as varchar) as target, 'spouse' as kind from f where husband_person_id in (select id from s)
union all select 'spouse_w_' || cast(id as varchar), 'person_' || cast(wife_person_id as varchar), 'family_' || cast(id as varchar), 'spouse' from f where wife_person_id in (select id from s)
union all select 'child_' || cast(family_id as varchar) || '_' || cast(child_person_id as varchar), 'family_' || cast(family_id as varchar), 'person_' || cast(child_person_id as varchar), 'child'
from t_family_children where family_id in (select id from f) and child_person_id in (select id from s)""", _GRAPH)  # fmt: skip
def _(t):
    return graph.graph_edges(t, _around(t))


@query("graph_nodes", _BFS + """, f as (select * from t_families where husband_person_id in (select id from s) or wife_person_id in (select id from s))
select 'person_' || cast(id as varchar) as node, 'person' as kind, case when trim(concat_ws(' ', trim(given), trim(surname))) = '' then '(unnamed)' else trim(concat_ws(' ', trim(given), trim(surname))) end as label,
  case when (trim(coalesce(given, '')) <> '' or trim(coalesce(surname, '')) <> '') and (trim(coalesce(birth_date, '')) <> '' or trim(coalesce(birth_place, '')) <> '') then 'high'
  when trim(coalesce(given, '')) <> '' or trim(coalesce(surname, '')) <> '' then 'medium' else 'low' end as quality from t_persons where id in (select id from s)
union all select 'family_' || cast(id as varchar), 'family', coalesce(marriage_date, ''), null from f""", _GRAPH)  # fmt: skip
def _(t):
    return graph.graph_nodes(t, _around(t))


@query("tree_one_hop", """
select 'self' as role, id, given, surname from t_persons where id = 7 union all
select 'parent', id, given, surname from t_persons where id in (select parent_person_id from t_relationships where child_person_id = 7) union all
select 'child', id, given, surname from t_persons where id in (select child_person_id from t_relationships where parent_person_id = 7)""", _GRAPH)  # fmt: skip
def _(t):
    return graph.one_hop(t, 7)


@query("family_detail", """
select f.id, concat_ws(' ', h.given, h.surname) as husband, concat_ws(' ', w.given, w.surname) as wife, marriage_date, marriage_place,
  (select array_to_string(list_sort(list(child_person_id)), ',') from t_family_children where family_id = 5) as children, cast(0 as bigint) as media
from t_families f left join t_persons h on h.id = f.husband_person_id left join t_persons w on w.id = f.wife_person_id where f.id = 5""", ("persons", "families", "family_children"))  # fmt: skip
def _(t):
    return graph.family_detail(t, 5).withColumn("children", F.array_join("children", ",")).drop("notes")


@query("parent_edges", "select parent_person_id, child_person_id from t_relationships", _GRAPH)
def _(t):
    return graph.parent_edges(t)


@query("spouse_union", "select distinct id from (select husband_person_id as id from t_families union all select wife_person_id from t_families) x where id is not null", ("families",))
def _(t):
    return search._spouses(t.families)


# ---- actions -------------------------------------------------------------------------------------------------------------

@query("merge_people_families", """
select id, case when husband_person_id = 20 then 10 else husband_person_id end as husband_person_id, case when wife_person_id = 20 then 10 else wife_person_id end as wife_person_id from t_families""", ("families",))  # fmt: skip
def _(t):
    return actions.merge_people(t, 20, 10).tables.families.select("id", "husband_person_id", "wife_person_id")


@query("merge_people_edges", """
select distinct p as parent_person_id, c as child_person_id from (select case when parent_person_id = 20 then 10 else parent_person_id end as p, case when child_person_id = 20 then 10 else child_person_id end as c,
  parent_person_id = 20 or child_person_id = 20 as moved from t_relationships) x where not moved or p <> c""", _GRAPH)  # fmt: skip
def _(t):
    return actions.merge_people(t, 20, 10).tables.relationships.select("parent_person_id", "child_person_id")


@query("merge_people_undone", "select parent_person_id, child_person_id from t_relationships", _GRAPH)
def _(t):
    return actions.undo(actions.merge_people(t, 20, 10)).relationships.select("parent_person_id", "child_person_id")


@query("dedupe_media_links", "select min(id) as id, asset_id, person_id from t_media_links group by asset_id, person_id, family_id", ("media_links",))
def _(t):
    return actions.dedupe_media_links(t).tables.media_links.select("id", "asset_id", "person_id")


@query("normalize_places_effect", """
select id, case when birth_place in ('NATION_0, AFRICA', 'nation_0; AFRICA') then 'Nation Zero' else birth_place end as birth_place, case when death_place in ('NATION_0, AFRICA', 'nation_0; AFRICA') then 'Nation Zero' else death_place end as death_place from t_persons""", ("persons",))  # fmt: skip
def _(t):
    return actions.normalize_places(t, "Nation Zero", ["NATION_0, AFRICA", "nation_0; AFRICA"]).tables.persons.select("id", "birth_place", "death_place")


def _applied(c: str) -> str:
    d = date_sql(c)
    return f"case when {c} is not null and trim({c}) <> '' and ({d['normalized']}) is not null and ({d['qualifier']}) is null and not ({d['is_ambiguous']}) then {d['normalized']} else {c} end as {c}"


@query("normalize_dates_effect", f"select id, {_applied('birth_date')}, {_applied('death_date')} from t_persons", ("persons",))
def _(t):
    return actions.normalize_dates(t, quality.date_normalizations(t)).tables.persons.select("id", "birth_date", "death_date")


@query("standardize_fields_effect", f"select p.id, coalesce(x.given_to, given) as given, coalesce(x.surname_to, surname) as surname from t_persons p left join ({_name_sql()}) x on x.id = p.id", ("persons",))
def _(t):
    return actions.standardize_fields(t, quality.name_suggestions(t)).tables.persons.select("id", "given", "surname")


_CLEAN = " union all ".join(
    [f"select id, '{c}' as field, {c} as raw, {date_sql(c)['normalized']} as cleaned, {date_sql(c)['confidence']} as confidence from t_persons" for c in ("birth_date", "death_date")]
    + [f"select id, '{c}', {c}, nullif({place(c)}, ''), cast(0.65 as double) from t_persons" for c in ("birth_place", "death_place")]
)


@query("clean_person_preview", f"select * from ({_CLEAN}) x where raw <> '' and cleaned is not null and cleaned <> raw", ("persons",))
def _(t):
    return actions.clean_person(t)


@query("apply_rules_effect", """
select id, case when birth_place in ('NATION_0, AFRICA', 'nation_0; AFRICA') then 'Nation 0, Africa' when birth_place in ('NATION_1, AMERICA', 'NATION_1,  AMERICA.') then 'Nation 1, America' else birth_place end as birth_place,
  case when death_place in ('NATION_0, AFRICA', 'nation_0; AFRICA') then 'Nation 0, Africa' when death_place in ('NATION_1, AMERICA', 'NATION_1,  AMERICA.') then 'Nation 1, America' else death_place end as death_place from t_persons""", ("persons",))  # fmt: skip
def _(t):
    return rules.apply_rules(t, t.spark.sql(RULES)).tables.persons.select("id", "birth_place", "death_place")


@query("delete_persons_effect", "select id, person_id from t_events where person_id is null or person_id not in (3, 4)", ("events",))
def _(t):
    return records.delete_persons(t, [3, 4]).events.select("id", "person_id")


@query("unlink_media_effect", "select a.id, case when exists (select 1 from t_media_links l where l.asset_id = a.id and l.id not in (1, 2, 3)) then 'assigned' else 'unassigned' end as status from t_media_assets a", ("media_assets", "media_links"))
def _(t):
    return records.unlink_media(t, [1, 2, 3]).media_assets.select("id", "status")


@query("link_media_effect", "select asset_id, person_id from t_media_links union all select 3, 1400 union all select 5, 1401", ("media_links",))
def _(t):
    new = t.spark.sql("select * from values (3, 1400, cast(null as int)), (5, 1401, null), (5, 1401, null), (7, null, null) as x(asset_id, person_id, family_id)")
    return records.link_media(t, new.unionByName(t.media_links.select("asset_id", "person_id", "family_id"))).media_links.select("asset_id", "person_id")


@query("graph_find", "select id, given, surname from t_persons where contains(lower(concat_ws(' ', given, surname)), 'widget') or cast(id as varchar) = 'widget'", ("persons",))
def _(t):
    return records.graph_find(t, "Widget").select(*PERSON)


@query("issue_page", f"""
select 'placeholder_name' as issue_type, (select count(*) from t_events where person_id is null and family_id is null) + row_number() over (order by id) as id, cast(0.8 as double) as confidence
from t_persons where {norm('given')} in {_PLACEHOLDER} or {norm('surname')} in {_PLACEHOLDER} order by 2 desc limit 50""", ("persons", "events"))  # fmt: skip
def _(t):
    found = quality.number_issues(quality.run_detection(t, ["orphan_event", "placeholder_name", "impossible_timeline"]))
    return records.list_issues(found, "placeholder_name", page=1).select("issue_type", "id", "confidence")


@query("applicable_dates", "select entity_id, field, \"normalized\" from (select entity_type, entity_id, field, " + ", ".join(f'{v} as "{k}"' for k, v in date_sql("raw_value").items()) + f" from {_DATES}) x where normalized is not null and qualifier is null and not is_ambiguous", ("persons", "events"))
def _(t):
    return actions.applicable_dates(quality.date_normalizations(t)).select("entity_id", "field", "normalized")


@query("confidence_buckets", f"select case when c >= 0.9 then 'High' when c >= 0.75 then 'Medium' else 'Low' end as bucket, count(*) as n from (select {date_sql('raw_value')['confidence']} as c from {_DATES}) x group by 1", ("persons", "events"))
def _(t):
    return quality.date_normalizations(t).groupBy(search.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# ---- scalar functions ----------------------------------------------------------------------------------------------------

@query("scalar_normalizers", f"""
select id, {norm('given')} as norm_name, {place('birth_place')} as norm_place, {pkey('birth_place')} as place_key, {ntext('surname')} as norm_text, {y1('birth_date')} as first_year, {y2('birth_date')} as least_year from t_persons""", ("persons",))  # fmt: skip
def _(t):
    p = t.persons
    c = F.col
    return p.select("id", X.norm_name(c("given")).alias("norm_name"), X.norm_place(c("birth_place")).alias("norm_place"), X.place_key(c("birth_place")).alias("place_key"), X.norm_text(c("surname")).alias("norm_text"), X.first_year(c("birth_date")).alias("first_year"), X.least_year(c("birth_date")).alias("least_year"))


@query("media_file_names", r"select id, trim(regexp_replace(lower(regexp_replace(original_filename, '\.[^./]*$', '')), '[^a-z0-9]+', ' ', 'g')) as norm_filename, lower(path) as norm_path, 'image/jpeg' as mime from t_media_assets", ("media_assets",))
def _(t):
    c = F.col
    return t.media_assets.select("id", X.norm_filename(c("original_filename")).alias("norm_filename"), X.normalize_path(F.concat(F.lit("C:\\"), F.replace("path", F.lit("/"), F.lit("\\")))).alias("norm_path"), X.mime_of(c("original_filename")).alias("mime"))


from . import source_queries  # noqa: E402, F401  registers more of them


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
