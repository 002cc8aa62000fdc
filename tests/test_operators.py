import hashlib
import json
import os
import random
import shutil
import sqlite3
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinloom.operators import actions, graph, quality, records, rules, search
from kinloom.plans.tables import DERIVED, Tables
from kinloom.sources import files, genealogy_db
from kinloom.sources.gedcom import gedcom_lines, import_families, parse, read_gedcom, split_lines, upsert
from kinloom.streaming.watch import current_assets, register_stream, upsert_assets, watch_media

PERSON = "id int, xref string, given string, surname string, sex string, birth_date string, birth_place string, death_date string, death_place string"
FAMILY = "id int, xref string, husband_person_id int, wife_person_id int, marriage_date string, marriage_place string"


def tables(spark, persons=(), families=(), children=(), relationships=(), events=(), assets=(), links=()):
    make = spark.createDataFrame
    p = [(i, f"@I{i}@", g, s, None, b, bp, d, None) for i, g, s, b, bp, d in persons]
    return Tables(
        spark, persons=make(p, PERSON), families=make([(i, f"@F{i}@", h, w, d, pl) for i, h, w, d, pl in families], FAMILY),
        family_children=make(list(children), "family_id int, child_person_id int"), relationships=make([(a, b, "parent") for a, b in relationships], "parent_person_id int, child_person_id int, rel_type string"),
        events=make([(i, "birth", p_, f, d, pl) for i, p_, f, d, pl in events], "id int, event_type string, person_id int, family_id int, date_raw string, place_raw string"),
        media_assets=make([(i, str(i), n, n, z, "unassigned") for i, n, z in assets], "id int, sha256 string, original_filename string, path string, size_bytes int, status string"),
        media_links=make(list(links), "id int, asset_id int, person_id int, family_id int"), notes=make([], "id int, person_id int, note_text string"),
    )


def found(d):
    return sorted((tuple(r["entity_ids"]), r["confidence"], r["impact_score"]) for r in d.collect())


def test_duplicate_people(spark):
    t = tables(spark, [(1, "John", "Sample", "1980", None, None), (2, "Jon", "Sample", "1980", None, None), (3, "Zoe", "Sample", "1985", None, None)])
    r = quality.duplicate_people(t).collect()
    assert [(x["entity_ids"], x["confidence"]) for x in r] == [([1, 2], 0.73)]
    assert json.loads(r[0]["explanation_json"])["name_similarity"] == 0.95


def test_field_standardization(spark):
    t = tables(spark, [(1, "JOHN", "DOE ", None, None, None), (2, "Ann", "Lee", None, None, None), (3, "UNKNOWN", "Lee", None, None, None)])
    assert found(quality.field_standardization(t)) == [((1,), 0.8, 2.0)]


def test_places(spark):
    t = tables(spark, [(1, "A", "B", None, "Boston, Massachusett", None)], events=[(1, 1, None, None, "Boston, Massachusetts"), (2, 1, None, None, "boston,  massachusetts")])
    s = quality.similar_places(t).collect()
    assert {x["confidence"] for x in s} == {0.98} and len(s) == 2
    c = quality.place_variants(t).collect()
    assert len(c) == 1 and c[0]["canonical"] == "Boston, Massachusetts"


def test_families(spark):
    people = [(1, "James", "Smith", None, None, None), (2, "Julia", "Smith", None, None, None), (3, "James", "Smith", None, None, None), (4, "Julia", "Smith", None, None, None)]
    t = tables(spark, people, [(1, 1, 2, "1920", "Town"), (2, 2, 1, "1920", "Town"), (3, 3, 4, "1920", "Town")])
    assert found(quality.duplicate_families(t)) == [((1, 2), 1.0, 1.0)]
    assert found(quality.duplicate_families_swapped(t)) == [((1, 3), 0.9, 1.0), ((2, 3), 0.9, 1.0)]


def test_media(spark):
    t = tables(spark, assets=[(1, "family_photo.jpg", 2048), (2, "family photo.JPG", 2050)], links=[(1, 1, 5, None), (2, 1, 5, None), (3, 2, 5, None)])
    assert found(quality.duplicate_media_assets(t)) == [((1, 2), 0.99, 1.0)]
    assert found(quality.duplicate_media_links(t)) == [((1, 2), 0.9, 2.0)]
    o = actions.dedupe_media_links(t)
    assert sorted(r["id"] for r in o.tables.media_links.collect()) == [1, 3]
    assert sorted(r["id"] for r in actions.undo(o).media_links.collect()) == [1, 2, 3]
    kept = actions.dedupe_media_links(t, keep=[2]).tables.media_links
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]
    merged = actions.merge_media_assets(t, 2, 1).tables
    assert {r["asset_id"] for r in merged.media_links.collect()} == {1}


def test_integrity(spark):
    people = [(1, "P", "A", "2000", None, "2001"), (2, "C", "A", "2003", None, None), (3, "S", "B", "2000", None, "2005"), (4, "n/a", "X", None, None, None), (5, "T", "X", "1990", None, "1980")]
    t = tables(spark, people, [(1, None, None, "1990", None), (2, 3, None, "1995", None), (3, 3, None, "2010", None)], [], [(1, 2)], [(1, None, None, None, None)])
    assert found(quality.young_parents(t)) == [((1, 2), 0.8, 0.8)]
    assert found(quality.late_children(t)) == [((1, 2), 0.85, 0.8)]
    assert found(quality.orphan_families(t)) == [((1,), 0.85, 0.5)]
    assert found(quality.early_marriages(t)) == [((2, 3), 0.8, 0.7), ((3, 3), 0.8, 0.7)]
    assert found(quality.late_marriages(t)) == [((3, 3), 0.85, 0.7)]
    assert found(quality.orphan_events(t)) == [((1,), 0.9, 1.0)]
    assert found(quality.placeholder_names(t)) == [((4,), 0.8, 0.2)]
    assert found(quality.impossible_timelines(t)) == [((5,), 0.95, 1.0)]
    every = quality.run_detection(t)
    numbered = quality.number_issues(every).collect()
    assert sorted(r["id"] for r in numbered) == list(range(1, len(numbered) + 1))
    s = quality.summary(every, quality.date_normalizations(t)).first()
    assert s["integrity_warnings"] == 9 and 0 < s["data_quality_score"] < 100


def test_merge_people_and_undo(spark):
    t = tables(spark, [(1, "A", None, None, None, None), (2, "A", "B", "1900", None, None), (3, "C", "B", None, None, None)], [(1, 2, None, None, None), (2, 1, 2, None, None)], [(1, 2), (1, 1)], [(1, 3), (2, 3), (1, 2)], [(1, 2, None, None, None)], [], [(1, 9, 2, None), (2, 9, 1, None)])
    o = actions.merge_people(t, 2, 1)
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert [r["surname"] for r in o.tables.persons.filter("id = 1").collect()] == ["B"]
    assert rows(o.tables.relationships) == [(1, 3, "parent")]
    assert rows(o.tables.media_links) == [(2, 9, 1, None)]
    assert rows(o.tables.family_children) == [(1, 1)]
    back = actions.undo(o)
    for name in ("persons", "families", "family_children", "relationships", "events", "media_links"):
        assert rows(getattr(back, name)) == rows(getattr(t, name)), name


def test_merge_families_and_dates(spark):
    t = tables(spark, [(1, "A", "X", "4/13/1881", "Town.", "abt 1980"), (2, "B", "X", None, None, None)], [(1, 1, None, None, None), (2, 1, None, None, None)], [(2, 2)], [])
    o = actions.merge_families(t, 2, 1)
    assert [tuple(r) for r in o.tables.family_children.collect()] == [(1, 2)]
    assert [tuple(r) for r in o.tables.relationships.collect()] == [(1, 2, "parent")]
    assert actions.undo(o).relationships.count() == 0 and actions.undo(o).families.count() == 2
    n = actions.normalize_dates(t, quality.date_normalizations(t)).tables.persons.filter("id = 1").first()
    assert (n["birth_date"], n["death_date"]) == ("1881-04-13", "abt 1980")
    clean = {r["field"]: r["cleaned"] for r in actions.clean_person(t, 1).collect()}
    assert clean == {"birth_date": "1881-04-13", "death_date": "1980", "birth_place": "town"}


def test_rules(spark):
    base = spark.createDataFrame([("Boston", ["boston ma"], False, None, None, None, None, None)], rules.SCHEMA)
    new = spark.createDataFrame([("Boston", ["Bostn"], True, "gaz", "7", 1.0, 2.0, None)], rules.SCHEMA)
    up = rules.upsert(base, new)
    r = up.first()
    assert (r["variants"], r["approved"], r["authority_id"]) == (["Bostn", "boston ma"], True, "7")
    text = rules.export(up)
    assert json.loads(text.first()[0])["rules"][0]["authority"] == {"source": "gaz", "id": "7"}
    again = rules.import_json(base, text).first()
    assert again["variants"] == ["Bostn", "boston ma"] and again["approved"]
    t = tables(spark, [(1, "A", "B", None, "Bostn", None)])
    o = rules.apply_rules(t, up)
    assert o.tables.persons.first()["birth_place"] == "Boston"
    assert actions.undo(o).persons.first()["birth_place"] == "Bostn"


def test_rules_in_order(spark):
    """Against the plain fold: one rule after the other, in order of names."""
    r = random.Random(3)
    for k in range(4):
        names = [f"n{i:02}" for i in range(30)]
        made = {r.choice(names): r.sample(names, r.randrange(0, 4)) for _ in range(20)} if k else {f"n{i:02}": [f"n{i - 1:02}"] for i in range(1, 30)}
        frame = spark.createDataFrame([(c, [f" {v} " for v in vs] + [" "], True, None, None, None, None, None) for c, vs in made.items()] + [("  ", ["n01"], True, *[None] * 5), ("off", ["n02"], False, *[None] * 5)], rules.SCHEMA)
        t = tables(spark, [(i, "a", "b", None, n, None) for i, n in enumerate([*names, "other", None])], events=[(i, None, None, None, n) for i, n in enumerate(names)])
        o = rules.apply_rules(t, frame)
        text, place = {n: n for n in names}, dict.fromkeys(names)
        for c in sorted(made):
            for n in names:
                text[n] = c if text[n] in made[c] else text[n]
                place[n] = c if n in made[c] else place[n]
        assert {x["id"]: x["birth_place"] for x in o.tables.persons.collect()} == dict(enumerate([*[text[n] for n in names], "other", None]))
        by = {x["id"]: x["name_canonical"] for x in o.tables.places.collect()}
        assert [by.get(x["place_id"]) for x in o.tables.events.orderBy("id").collect()] == [place[n] for n in names]
        assert sorted(x["canonical"] for x in o.failed.collect()) == sorted(["", *[c for c, v in made.items() if not v]]) and sorted(by.values()) == sorted(c for c, v in made.items() if v)
        assert {x["id"]: x["birth_place"] for x in actions.undo(o).persons.collect()} == dict(enumerate([*names, "other", None]))


def test_pairs_of_hot_keys(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", f"v{i}") for i in range(300)]
    d = spark.createDataFrame(rows, "id int, k string, v string")
    want = sorted((i, j, k, v, w) for i, k, v in rows for j, l, w in rows if k == l and i < j)
    for block in (1, 7, 50, 1000):
        met = quality.block_pairs(d, ["k"], "id", block)
        assert sorted(tuple(r) for r in met.select("id_a", "id_b", "k", "v_a", "v_b").collect()) == want
    assert quality.block_pairs(d.limit(0), ["k"], "id").count() == 0


def test_prefix_index_loses_no_pair(spark):
    r = random.Random(6)
    words = ["".join(r.choice("eeeeaaaittonsrhldcumfpgwybvkxjqz \u00e9") for _ in range(r.randrange(1, 14))) for _ in range(150)]
    words = sorted({*words, *("".join(r.sample(w, len(w)))[: r.randrange(1, 20)] for w in words)})
    common = lambda x, y: sum((Counter(x) & Counter(y)).values())
    for least in (0.8, 0.6):
        index = quality.prefix_index(spark.createDataFrame([(w,) for w in words], "norm string"), least)
        met = {(x["norm_a"], x["norm_b"]) for x in quality.block_pairs(index, ["token"], "norm", 40).collect()}
        want = {(x, y) for x in words for y in words if x.encode() < y.encode() and 2 * common(x, y) >= least * (len(x) + len(y))}
        assert want <= met
        assert least < 0.8 or len(met) < 0.5 * len(words) * (len(words) - 1) / 2  # so many pairs are never made


def test_numbers_of_issues(spark):
    t = tables(spark, [(i, f"Ann{i % 4}", "Lee", "1900", None, None) for i in range(60)])
    found = quality.run_detection(t, ["duplicate_person", "placeholder_name"])
    got = quality.number_issues(found, 5).orderBy("id").collect()
    plain = sorted((x["rank"], x["entity_ids"], x["explanation_json"]) for x in found.collect())
    assert [x["id"] for x in got] == list(range(6, 6 + len(plain))) and [(x["entity_ids"], x["explanation_json"]) for x in got] == [x[1:] for x in plain]


def test_walk(spark):
    r = random.Random(8)
    edges = {(r.randrange(80), r.randrange(80)) for _ in range(70)} | {(i, i + 1) for i in range(100, 112)} | {(5, 5)}
    t = tables(spark, [(i, "a", "b", None, None, None) for i in range(120)], relationships=sorted(edges))
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for roots, depth in (([3, 100], 4), ([103], 9), ([119], 2), ([], 3), ([5, 5], 0)):
        want, last = dict.fromkeys(roots, 0), set(roots)
        for k in range(1, min(depth, 5) + 1):
            last = {b for a in last for b in near.get(a, ())} - set(want)
            want |= dict.fromkeys(last, k)
        got = graph.neighbourhood(t, spark.createDataFrame([(x,) for x in roots], "id int"), depth)
        assert {x["id"]: x["distance"] for x in got.collect()} == want and got.count() == len(want)


def test_drilldown_and_pages(spark):
    t = tables(spark, [(1, "Ann", "Smith", "1980", "Berlin ", None), (2, "Bob", "SMITH", "1981", "berlin", None), (3, "Cid", "Garcia", None, None, None)], [(1, 1, 3, "15 MAY 2005", None)], [(1, 2)])
    n = lambda k, **f: search.drilldown(t, k, **f).count()
    assert n("surname", surname="smith") == 2 and n("birth_place", place="Berlin") == 2 and n("marriage_decade", decade=2000) == 2
    assert n("children_count", children=1) == 2 and n("nothing") == 0 and n("surname") == 0 and n("duplicate_cluster", ids=["1", "x"]) == 1
    assert search.page(t.persons.orderBy("id"), 2, 2).count() == 1


def test_graph(spark):
    t = tables(spark, [(i, "P", str(i), None, None, None) for i in range(1, 6)], [(1, 1, 2, None, None)], [(1, 3)], [(1, 3), (2, 3), (3, 4), (4, 5)])
    seen = {r["id"]: r["distance"] for r in graph.neighbourhood(t, spark.createDataFrame([(1,)], "id int"), 2).collect()}
    assert seen == {1: 0, 3: 1, 2: 2, 4: 2}
    edges = {r["edge"] for r in graph.graph_edges(t, spark.createDataFrame([(1,), (3,)], "id int")).collect()}
    assert edges == {"spouse_h_1", "child_1_3"}
    assert {r["role"] for r in graph.one_hop(t, 3).collect()} == {"self", "parent", "child"}


GED = """0 HEAD
0 @I1@ INDI
1 NAME John /Doe/
1 SEX M
1 BIRT
2 DATE 1 JAN 1900
2 PLAC Town
1 RESI
2 DATE 1950
1 NOTE first
2 NOTE second
0 @I2@ INDI
1 NAME Jane
2 SURN Roe
junk
0 @I3@ INDI
1 NAME Baby /Doe/
0 @F1@ FAM
1 HUSB @I1@
1 WIFE @I9@
1 CHIL @I3@
1 MARR
2 DATE 1925
0 TRLR
"""


def test_gedcom(spark, tmp_path):
    (tmp_path / "a.ged").write_text(GED.replace("\n", "\r\n"))
    g = read_gedcom(spark, str(tmp_path / "a.ged"))
    p = {r["xref"]: r for r in g.persons.collect()}
    assert len(p) == 3 and (p["@I1@"]["given"], p["@I1@"]["surname"], p["@I1@"]["birth_date"], p["@I1@"]["notes"]) == ("John", "Doe", "1950", ["first", "second"])
    assert (p["@I2@"]["given"], p["@I2@"]["surname"]) == ("Jane", "Roe")
    f = g.families.first()
    assert (f["husb"], f["children"], f["marriage_date"]) == ("@I1@", ["@I3@"], "1925")
    t = tables(spark, [(4, "Old", "One", None, None, None)])
    persons = upsert(t.persons, g.persons)
    assert sorted(r["id"] for r in persons.collect()) == [4, 5, 6, 7]
    fams, kids, rel = import_families(g, persons, t.families, t.family_children)
    assert fams.first()["wife_person_id"] is None and kids.count() == 1 and rel.count() == 1
    assert parse(split_lines(spark.createDataFrame([], "file string, value string"))).persons.count() == 0


def test_gedcom_file_of_many_splits(spark, tmp_path):
    r, out = random.Random(4), ["0 HEAD", "1 CHAR UTF-8"]
    for i in range(3000):
        out += [f"0 @I{r.randrange(1500)}@ INDI" if i % 5 else f"0 @F{i}@ FAM", f"1 NAME Name{i} /Last{r.randrange(9)}/"]
        out += r.sample(["1 BIRT", f"2 DATE {1800 + i % 200}", "2 PLAC Town, \u00c5land", "1 DEAT", f"1 NOTE n{i}", "0 no record line", "", "junk", f"1 HUSB @I{i}@", f"1 CHIL @I{i + 1}@", "1 MARR", "0\tTRLR", "1 SEX F"], r.randrange(0, 9))
    for name, end in (("unix", "\n"), ("dos", "\r\n"), ("mac", "\r")):
        text = end.join(out)
        (tmp_path / f"{name}.ged").write_bytes(text.encode())
        whole = parse(split_lines(spark.createDataFrame([(name, text)], "file string, value string")))
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        try:
            assert gedcom_lines(spark, str(tmp_path / f"{name}.ged")).rdd.getNumPartitions() > 20
            split = read_gedcom(spark, str(tmp_path / f"{name}.ged"))
            for a, b in ((split.persons, whole.persons), (split.families, whole.families)):
                assert sorted(map(str, a.drop("file").collect())) == sorted(map(str, b.drop("file").collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def make_db(path):
    con = sqlite3.connect(path)
    con.executescript("""create table PersonTable(PersonID integer, Given text, Surname text, Sex text, BirthDate text, BirthPlace text, Notes text);
insert into PersonTable values (1,'Ann','Lee','F','1900','Town',' '),(2,'Bob','Lee','M',null,null,'x'),(3,'Cid','Lee','M',null,null,null);
create table Relationships(ParentID integer, ChildID integer); insert into Relationships values (1,3),(2,3);
create table MediaLocations(MediaID integer, Path text, OriginalName text, Description text); insert into MediaLocations values (1,'a/b.jpg','b.jpg','d'),(2,'c.jpg',null,null);
create table MediaAssociations(MediaID integer, OwnerType text, OwnerID integer); insert into MediaAssociations values (1,'person',1),(2,'0',2),(2,'source',9);""")
    con.commit()
    con.close()


def test_genealogy_db(spark, tmp_path):
    make_db(tmp_path / "x.rmtree")
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.write(tmp_path / "x.rmtree", "family/inner.rmtree")
    for name in ("x.rmtree", "y.zip"):
        cells = genealogy_db.open_databases(spark, str(tmp_path / name))
        p = {r["xref"]: r for r in genealogy_db.persons(cells).collect()}
        assert set(p) == {"rmtree:1", "rmtree:2", "rmtree:3"} and p["rmtree:1"]["notes"] is None and p["rmtree:1"]["birth_date"] == "1900"
        assert genealogy_db.relationships(cells).count() == 2
        places, links = genealogy_db.media(cells)
        assert places.count() == 2 and links.count() == 2
    assert genealogy_db.fingerprint(spark, str(tmp_path / "x.rmtree")).first()["fingerprint"]
    with pytest.raises(ValueError):
        genealogy_db.database_bytes(b"nothing")
    with pytest.raises(Exception, match="more than the 100 that are allowed"):
        genealogy_db.open_databases(spark, str(tmp_path / "x.rmtree"), largest=100)


def test_database_in_pieces(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "big db.rmtree")
    con.executescript("""create table NameTable(OwnerID integer primary key, Surname text, Givn text, Photo blob); create table Keyed(IndiID text primary key, DeathDate text) without rowid;
create table Other(a); create table Empty(PersonID, FName);""")
    con.executemany("insert into NameTable values (?, ?, ?, ?)", [(i * 7 - 5000, f"s{i}", None, b"x" * 3000) for i in range(2000)])
    con.executemany("insert into Keyed values (?, ?)", [(f"k{i}", "1900") for i in range(30)])
    con.commit()
    con.close()
    db = genealogy_db.open_databases(spark, str(tmp_path / "big db.rmtree"), piece=100)
    d = genealogy_db.persons(db)
    names = next(x for x in db.tables if x.name == "nametable")
    pieces = names.pieces(100)
    assert len(pieces) == 20 and pieces[0][2] == -5000 and pieces[-1][3] == 1999 * 7 - 5000 and all(a[3] + 1 == b[2] for a, b in zip(pieces, pieces[1:]))
    assert db.frame([names], ["surname"], ["s"]).rdd.getNumPartitions() == 20
    got = {r["source_id"]: (r["surname"], r["given"], r["death_date"]) for r in d.collect()}
    assert len(got) == 2030 and got["-5000"] == ("s0", None, None) and got["k3"] == (None, None, "1900")
    data = (tmp_path / "big db.rmtree").read_bytes()
    at = data.rindex(b"x" * 2000)
    (tmp_path / "broken.rmtree").write_bytes(data[: at // 4096 * 4096 - 8192] + b"\xff" * 4096 + data[at // 4096 * 4096 - 4096 :])
    found = {r["name"]: r["error"] for r in genealogy_db.layouts(spark, str(tmp_path / "broken.rmtree")).collect()}
    assert found["keyed"] is None or found["nametable"]  # a damaged table is named, and none of its rows is taken
    assert any(found.values()) and {x.name for x in genealogy_db.open_databases(spark, str(tmp_path / "broken.rmtree")).tables} == {k for k, v in found.items() if not v}


def test_import_of_two_files(spark, tmp_path):
    for name, edge in (("a", "insert into Parents values (1, 2)"), ("b", "")):
        con = sqlite3.connect(tmp_path / f"{name}.rmtree")
        con.executescript(f"create table Persons(PersonID, XRef, Given); insert into Persons values (1, '{name}1', 'x'), (2, '{name}2', 'y'); create table Parents(ParentID, ChildID); {edge};")
        con.commit()
        con.close()
    db = genealogy_db.open_databases(spark, str(tmp_path))
    places, links = genealogy_db.media(db)
    out = records.import_database(tables(spark), genealogy_db.persons(db), genealogy_db.relationships(db), places, links)
    by = {r["id"]: r["xref"] for r in out.persons.collect()}
    assert sorted(by.values()) == ["a1", "a2", "b1", "b2"] and [(by[r[0]], by[r[1]]) for r in out.relationships.collect()] == [("a1", "a2")]


def test_media_files(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    for name, content in (("a.jpg", b"1"), ("sub/b.png", b"2"), ("sub/c.jpg", b"1"), ("d.txt", b"3")):
        (folder / name).write_bytes(content)
    got = files.scan_media(spark, str(folder))
    assert got.count() == 2 and files.register(got, got).count() == 0
    wanted = spark.createDataFrame([(1, "s1", "x"), (2, None, r"C:\M\b.png"), (3, None, "none.gif")], "key int, sha256 string, path string")
    assets = spark.createDataFrame([(7, "s1", "p/q.jpg", None), (8, "s2", "m/B.png", None)], "id int, sha256 string, path string, source_path string")
    m = {r["key"]: (r["asset_id"], r["matched_by"]) for r in files.match_media(wanted, assets).collect()}
    assert m == {1: (7, "sha256"), 2: (8, "path"), 3: (None, None)}
    files.write_csv(spark.createDataFrame([('a "b"', 1), (None, 2)], "x string, y int").coalesce(1), str(tmp_path / "csv"))
    body = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert body == b'x,y\r\n"a ""b""",1\r\n,2\r\n'
    files.write_snapshot({"t": spark.range(3)}, str(tmp_path / "snap"))
    assert files.read_snapshot(spark, str(tmp_path / "snap"), "t").count() == 3 and files.read_snapshot(spark, str(tmp_path / "snap"), "u").count() == 0
    files.write_csv(spark.createDataFrame([], "x string, y int"), str(tmp_path / "none"))
    assert b"".join(x.read_bytes() for x in (tmp_path / "none").glob("part-*")) == b"x,y\r\n"
    types = tmp_path / "types"
    types.mkdir()
    for k, e in enumerate(files.MEDIA):
        (types / f"f{k}.{e.upper() if k % 2 else e}").write_bytes(b"x" * (k + 1) * 300_000)
    seen = {r["original_filename"].rsplit(".", 1)[1].lower(): (r["mime_type"], r["size_bytes"], r["sha256"]) for r in files.scan_media(spark, str(types)).collect()}
    assert len(seen) == 14 and seen["mp4"][0] == "video/mp4" and seen["heic"][0] == "image/heic" and all(m.split("/")[0] in ("image", "video", "application") and "octet" not in m for m, _, _ in seen.values())
    assert all(h == hashlib.sha256(b"x" * n).hexdigest() for _, n, h in seen.values())


def test_watch(spark, tmp_path):
    folder, table, ck, state = (str(tmp_path / x) for x in ("in", "assets", "ck", "state"))
    (tmp_path / "in" / "sub").mkdir(parents=True)

    def put(name, content, at):
        (tmp_path / "in" / name).write_bytes(content)
        os.utime(tmp_path / "in" / name, (at, at))

    def step():
        q = register_stream(watch_media(spark, folder, state), table, ck, once=True)
        q.awaitTermination(120)
        assert q.exception() is None
        return {r["original_filename"]: r for r in current_assets(spark, table).collect()}

    put("a.jpg", b"1", 1000)
    put("sub/b.MP4", b"2", 1000)
    put("c.txt", b"3", 1000)
    one = step()
    assert set(one) == {"a.jpg", "b.MP4"} and one["a.jpg"]["sha256"] == hashlib.sha256(b"1").hexdigest() and one["b.MP4"]["mime_type"] == "video/mp4"
    batches = sorted(os.listdir(table))
    assert step() == one and sorted(os.listdir(table)) == batches  # a restart repeats nothing
    put("a.jpg", b"changed", 2000)  # a changed file at the same path
    put("old.png", b"4", 5)  # a new file with an old time
    put("copy.png", b"2", 3000)  # a known content
    two = step()
    assert set(two) == {"a.jpg", "b.MP4", "old.png"} and two["a.jpg"]["id"] == one["a.jpg"]["id"] and two["a.jpg"]["sha256"] == hashlib.sha256(b"changed").hexdigest()
    upsert_assets(spark.createDataFrame([("s", "p/n.jpg", "n.jpg", "image/jpeg", 1)], "sha256 string, path string, original_filename string, mime_type string, size_bytes long"), table, 50)
    shutil.copytree(f"{table}/batch=50", f"{table}/batch=51")
    os.remove(f"{table}/batch=51/_SUCCESS")  # a batch that did not finish does not count
    assert current_assets(spark, table).count() == 4 and current_assets(spark, table, 50).count() == 3


def test_durable_log(spark, tmp_path):
    t = frozen(tables(spark, [(i, f"g{i}", "Lee", "1900", f"p{i}", None) for i in range(1, 7)], relationships=[(1, 3), (2, 4)]))
    path = str(tmp_path / "log")
    assert records.logged_actions(spark, path).count() == 0
    first = actions.merge_people(t, 2, 1)
    records.write_action(path, first, 1, "ann")
    second = actions.normalize_places(frozen(first.tables), "Town", ["p5", "p6"])
    records.write_action(path, second, 2)
    records.write_action(path, second, 2)  # once more after a crash: still one
    shutil.copytree(f"{path}/action_id=2", f"{path}/action_id=3")
    os.remove(f"{path}/action_id=3/_SUCCESS")  # half an action
    said = lambda: sorted((r["action_id"], r["action_type"], r["applied_by"]) for r in records.logged_actions(spark, path).filter("kind = 'log'").collect())
    assert said() == [(1, "mergePeople", "ann"), (2, "normalizePlaces", None)]
    back = frozen(records.undo_action(second.tables, path, 1))  # the older one
    assert {r["id"]: r["birth_place"] for r in back.persons.collect()} == {1: "p1", 2: "p2", 3: "p3", 4: "p4", 5: "Town", 6: "Town"}
    assert sorted(tuple(r)[:2] for r in back.relationships.collect()) == [(1, 3), (2, 4)] and said() == [(2, "normalizePlaces", None)]
    with pytest.raises(ValueError):
        records.undo_action(t, path, 1)
    assert {r["birth_place"] for r in records.undo_action(second.tables, path, 2).persons.filter("id > 4").collect()} == {"p5", "p6"} and said() == []


def frozen(t):
    """The tables with their rows computed once."""
    return Tables(t.spark, **{n: t.spark.createDataFrame(getattr(t, n).collect(), getattr(t, n).schema) for n in DERIVED})


def test_records(spark, tmp_path):
    t = tables(spark, [(4, "Ann", "Lee", None, None, None)], assets=[(1, "c.jpg", 5)])
    new = spark.createDataFrame([(" ", " ", "x"), ("Bob", "", "y"), ("Bob", "", "y")], "given string, surname string, sex string")
    added = records.add_persons(t, new).persons
    assert sorted(r["id"] for r in added.collect()) == [4, 5, 6] and added.filter("given = 'Bob'").first()["surname"] is None
    up = records.update_persons(t, spark.createDataFrame([(4, "Anna", "")], "id int, given string, surname string")).persons.first()
    assert (up["given"], up["surname"]) == ("Anna", "Lee")
    make_db(tmp_path / "x.rmtree")
    cells = genealogy_db.open_databases(spark, str(tmp_path / "x.rmtree"))
    for _ in range(2):  # a second import changes nothing
        t = frozen(t)
        t = records.import_database(t, genealogy_db.persons(cells), genealogy_db.relationships(cells), *genealogy_db.media(cells))
    t = frozen(t)
    assert (t.persons.count(), t.relationships.count(), t.media_assets.count(), t.media_links.count()) == (4, 2, 2, 2)
    assert {r["status"] for r in t.media_assets.collect()} == {"assigned"}
    assert records.unlink_media(t, [r["id"] for r in t.media_links.collect()]).media_assets.filter("status = 'assigned'").count() == 0
    assert records.delete_persons(t, [4]).persons.count() == 3 and records.graph_find(t, "4").count() == 1
    log = records.log_action(spark.createDataFrame([], records.LOG), actions.merge_people(t, 5, 4), "me")
    assert json.loads(records.list_actions(log).first()["payload_json"]) == {"from": 5, "into": 4}
    persons = spark.createDataFrame([(1, "@I1@", "Ann", "Lee"), (2, "rmtree:8", "Bob", "Lee"), (3, None, "Cid", "Lee")], "id int, xref string, given string, surname string")
    a = spark.createDataFrame([(1, "@I1@", None), (2, "8", None), (3, "x", "cid  LEE"), (4, "y", "nobody")], "media_id int, owner_id string, owner_name string")
    loc = spark.createDataFrame([(1, "p/a.jpg", "s1"), (2, "q/b.jpg", None), (3, "z/b.jpg", None)], "media_id int, path string, sha256 string")
    assets = spark.createDataFrame([(7, "s1", "x.jpg", None), (8, "s2", "q/B.jpg", None)], "id int, sha256 string, path string, source_path string")
    got = {r["media_id"]: (r["person_id"], r["asset_id"], r["apply"]) for r in records.legacy_links(a, loc, persons, assets).collect()}
    assert got == {1: (1, 7, True), 2: (2, 8, True), 3: (3, 8, False), 4: (None, None, False)}
    files.link_report(records.legacy_links(a, loc, persons, assets), str(tmp_path / "report"))


def test_places_and_event_times(spark):
    places = spark.createDataFrame([(1, "A", None, None, None, 2.0), (2, "B", "x", "1", 1.0, 1.0)], "id int, name_canonical string, authority_source string, authority_id string, latitude double, longitude double")
    found = spark.createDataFrame([(1, "gaz", "7", 5.0, 6.0), (2, "gaz", "8", 5.0, 6.0)], "id int, authority_source string, authority_id string, latitude double, longitude double")
    kept = {r["id"]: tuple(r)[2:] for r in actions.enrich_place(places, found).collect()}
    assert kept == {1: ("gaz", "7", 5.0, 2.0), 2: ("x", "1", 1.0, 1.0)}
    assert {tuple(r)[2:] for r in actions.enrich_place(places, found, force=True).collect()} == {("gaz", "7", 5.0, 6.0), ("gaz", "8", 5.0, 6.0)}
    events = spark.createDataFrame([(1, "13/4/1881"), (2, "MAR 1881"), (3, "unknown"), (4, "BET 1900 AND 1910")], "id int, date_raw string")
    got = {r["id"]: r["date_canonical"] and str(r["date_canonical"])[:10] for r in actions.event_timestamps(events).collect()}
    assert got == {1: "1881-04-13", 2: "1881-03-01", 3: None, 4: None}
    issues = spark.createDataFrame([("duplicate_person", "open", [1, 2]), ("place_cluster", "open", [1]), ("duplicate_person", "open", [3])], "issue_type string, status string, entity_ids array<int>")
    from kinloom.operators.records import resolve_issues

    assert sorted(r["status"] for r in resolve_issues(issues, ["duplicate_person"], [1]).collect()) == ["open", "open", "resolved"]


def test_several_rows_of_one_key(spark):
    old = spark.createDataFrame([(3, "@A@", "Ann")], "id int, xref string, given string")
    new = spark.createDataFrame([("@A@", "Old", "1.ged"), ("@A@", "New", "2.ged"), ("@B@", "Bob", "1.ged"), ("@B@", "Bob", "1.ged")], "xref string, given string, file string")
    got = sorted(tuple(r) for r in upsert(old, new).collect())
    assert got == [(3, "@A@", "New"), (4, "@B@", "Bob")]


def test_placeholders_become_files(spark):
    assets = spark.createDataFrame([(1, "missing1", "a.jpg", None, 0), (2, "s2", "b.jpg", "", 5), (3, "s3", "c.jpg", "c", 6)], "id int, sha256 string, original_filename string, path string, size_bytes long")
    found = spark.createDataFrame([("s1", "in/a.jpg", "a.jpg", "image/jpeg", 9), ("s2", "in/x.jpg", "x.jpg", "image/jpeg", 5), ("s9", "in/n.jpg", "n.jpg", "image/jpeg", 7)], "sha256 string, path string, original_filename string, mime_type string, size_bytes long")
    changed, new = files.register_media(assets, found)
    assert sorted(tuple(r) for r in changed.collect()) == [(1, "s1", "a.jpg", "in/a.jpg", 9), (2, "s2", "b.jpg", "in/x.jpg", 5), (3, "s3", "c.jpg", "c", 6)]
    assert [r["sha256"] for r in new.collect()] == ["s9"]


def test_distances_on_a_cycle(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 8) for i in range(8)] + [(20, 21)], "parent_person_id int, child_person_id int")
    roots = spark.createDataFrame([(0,)], "id int")
    got = {r["id"]: r["distance"] for r in graph.neighbourhood(Tables(spark, relationships=edges), roots, 3).collect()}
    assert got == {0: 0, 1: 1, 7: 1, 2: 2, 6: 2, 3: 3, 5: 3}
    plan = graph.neighbourhood(Tables(spark, relationships=edges), roots, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") <= 15
