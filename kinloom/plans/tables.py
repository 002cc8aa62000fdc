"""Genealogy tables derived from the star-schema test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
_MON = "case m " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(MONTHS, 1)) + " end"
_S = "cast({} as varchar(12))".format

BASE = ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")

SQL = {
    "persons": f"""
select id, '@I' || {_S('id')} || '@' as xref,
  case when id % 97 = 0 then null when id % 7 = 0 then upper(p_name) when id % 11 = 0 then p_name || ' ' else p_name end as given,
  case when id % 89 = 0 then 'Unknown' when id % 3 = 0 then c_mktsegment
       else substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) end as surname,
  case id % 3 when 0 then 'M' when 1 then 'F' else null end as sex,
  case id % 10
    when 0 then {_S('y')} || '-' || lpad({_S('m')}, 2, '0') || '-' || lpad({_S('dd')}, 2, '0')
    when 1 then {_S('dd')} || '/' || {_S('m')} || '/' || {_S('y')}
    when 2 then {_MON} || ' ' || {_S('y')}
    when 3 then 'ABT ' || {_S('y')}
    when 4 then 'BET ' || {_S('y')} || ' AND ' || {_S('y + 5')}
    when 5 then {_S('dd')} || ' ' || {_MON} || ' ' || {_S('y')}
    when 6 then 'unknown' when 7 then null when 8 then {_S('y')}
    else {_S('m')} || '/' || {_S('dd')} || '/' || {_S('y')} end as birth_date,
  case id % 4 when 0 then n_name || ', ' || r_name when 1 then lower(n_name) || '; ' || r_name
              when 2 then n_name || ',  ' || r_name || '.' else null end as birth_place,
  case when id % 4 = 0 then null when id % 50 = 1 then {_S('y - 5')} else {_S('y + 20 + id % 70')} end as death_date,
  case when id % 5 = 0 then null else 'NATION_' || {_S('(c_nationkey + id) % 25')} || ', ' || r_name end as death_place
from (select cast(c_custkey as int) as id, c_mktsegment, c_nationkey, p_name, n_name, r_name,
        cast(1850 + (c_custkey * 37) % 150 as int) as y, cast(1 + c_custkey % 12 as int) as m, cast(1 + c_custkey % 28 as int) as dd
      from {{customer}} join {{nation}} on c_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey
      join {{part}} on p_partkey = c_custkey) b""",
    "families": f"""
select cast(o_orderkey as int) as id, '@F' || {_S('o_orderkey')} || '@' as xref,
  case when o_orderkey % 211 = 0 then null else cast(o_custkey as int) end as husband_person_id,
  case when o_orderkey % 13 = 0 or o_orderkey % 211 = 0 then null
       else cast((o_custkey + 1 + o_orderkey % 3) % (select count(*) from {{customer}}) as int) end as wife_person_id,
  {_S('year(o_orderdate) - 90')} as marriage_date,
  case o_orderkey % 4 when 0 then 'NATION_' || {_S('o_custkey % 25')} || ', EUROPE' when 1 then 'nation_' || {_S('o_custkey % 25')} || ';  EUROPE.'
                      when 2 then null else 'NATION_' || {_S('o_custkey % 25')} || ', ASIA' end as marriage_place
from {{orders}}""",
    "family_children": """
select distinct cast(l_orderkey as int) as family_id, cast(l_partkey % (select count(*) from {customer}) as int) as child_person_id
from {lineitem} where l_orderkey % 211 <> 0""",
    "events": f"""
select cast(event_id as int) as id, event_type, case when event_id % 101 = 0 then null else cast(user_id as int) end as person_id,
  cast(null as int) as family_id,
  case event_id % 5 when 0 then {_S('year(ts)')} || '-' || lpad({_S('month(ts)')}, 2, '0') || '-' || lpad({_S('day(ts)')}, 2, '0')
       when 1 then {_S('day(ts)')} || '/' || {_S('month(ts)')} || '/' || {_S('year(ts)')} when 2 then {_S('year(ts)')}
       when 3 then 'ABT ' || {_S('year(ts)')} else null end as date_raw,
  case when event_id % 9 = 0 then null when event_id % 2 = 0 then 'NATION_' || {_S('user_id % 25')} || ', AFRICA'
       else 'Nation_' || {_S('user_id % 25')} || ' , Africa' end as place_raw
from {{events_raw}}""",
    "media_assets": f"""
select cast(doc_id as int) as id, {{sha256}} as sha256, source || '_' || {_S('doc_id')} || '.jpg' as original_filename,
  'media/' || source || '/' || {_S('doc_id')} || '.jpg' as path, cast(n_chars as int) as size_bytes,
  case when doc_id % 2 = 0 then 'unassigned' else 'assigned' end as status
from {{documents}}""",
    "media_links": """
select cast(doc_id as int) as id, cast(doc_id as int) as asset_id, cast(doc_id % 150 as int) as person_id, cast(null as int) as family_id from {labels}
union all
select cast(1000000 + doc_id as int), cast(doc_id as int), cast(doc_id % 150 as int), cast(null as int) from {labels} where doc_id % 10 = 0""",
    "notes": """
select cast(conv_id * 100 + turn as int) as id, case when conv_id % 5 = 4 then null else cast(conv_id as int) end as person_id,
  case when conv_id % 5 = 4 then cast(conv_id as int) else null end as family_id, text as note_text from {conversations}""",
}
SQL["relationships"] = """
select distinct parent_person_id, child_person_id, 'parent' as rel_type from (
  select husband_person_id as parent_person_id, child_person_id from {families} f join {family_children} c on f.id = c.family_id
  union all
  select wife_person_id, child_person_id from {families} f join {family_children} c on f.id = c.family_id) u
where parent_person_id is not null"""
DERIVED = ("persons", "families", "family_children", "events", "media_assets", "media_links", "notes", "relationships")
_NEEDS = {
    "persons": ("customer", "nation", "region", "part"), "families": ("orders", "customer"), "family_children": ("lineitem", "customer"), "events": ("events_raw",),
    "media_assets": ("documents",), "media_links": ("labels",), "notes": ("conversations",), "relationships": ("families", "family_children"),
}


class Tables:
    """The derived tables as DataFrames, each built when first asked for.  Pass frames by name to replace any of them."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, **frames: DataFrame):
        self.spark, self.sf_dir = spark, sf_dir
        self.__dict__.update(frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVED:
            need = {n: getattr(self, n) for n in _NEEDS[name]}
            sql = SQL[name].replace("{sha256}", "sha2(text, 256)")
            found = self.spark.sql(sql, **need)
        elif name in (*BASE, "events_raw"):
            found = self.spark.read.parquet(f"{self.sf_dir}/{name.removesuffix('_raw')}.parquet")
        else:
            raise AttributeError(name)
        self.__dict__[name] = found
        return found

    @cached_property
    def empty(self) -> DataFrame:
        return self.spark.range(0).drop("id")


def with_tables(body: str, *names: str) -> str:
    """DuckDB SQL: body after common table expressions for the derived tables it names."""
    wanted = [n for n in DERIVED if n in names or (n in ("families", "family_children") and "relationships" in names)]
    parts = []
    for n in wanted:
        need = {x: ("events" if x == "events_raw" else x) for x in _NEEDS[n]}
        # a derived table may not hide the raw table it reads, so derived names get a prefix
        need = {x: (f"t_{v}" if v in DERIVED and v != "events" else v) for x, v in need.items()}
        parts.append(f"t_{n} as ({SQL[n].replace('{sha256}', 'sha256(text)').format(**need)})")
    return "with " + ",\n".join(parts) + "\n" + body
