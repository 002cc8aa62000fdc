import re
from collections import Counter
from difflib import SequenceMatcher

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from kinloom import queries as genealogy
from kinloom.operators import quality
from kinloom.plans.tables import Tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if pd.isna(x):
        return "NULL"
    if isinstance(x, float):
        return str(int(x)) if float(x).is_integer() else str(round(x, 9))
    return str(x)


def rows(d):
    d = d[sorted(d.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in d.itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(genealogy.ORACLES))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = genealogy.queries()[name](spark, sf_dir).toPandas(), con.execute(genealogy.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(genealogy.QUERIES) - set(genealogy.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert genealogy.queries()[name](spark, sf_dir).count() > 0


# ---- queries that need a similarity SQL does not have, against plain Python ---------------------------------------------------

def squeeze(x):
    return " ".join((x or "").lower().split())


def place_norm(x):
    v = re.sub(r"[^a-z0-9, ]+", " ", re.sub(r"[;|]+", ",", (x or "").lower().replace(".", " ")))
    for short, full in ((" st ", " street "), (" mt ", " mount "), (" co ", " county ")):
        v = v.replace(short, full)
    return re.sub(" +", " ", v).strip()


def first_year(x):
    found = re.search(r"1[5-9]\d\d|20\d\d", x or "")
    return int(found.group()) if found else None


def same(a, b):
    return a is not None and b is not None and abs(a - b) <= 1


def similar(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def test_duplicate_people(spark, sf_dir):
    people = [(r["id"], squeeze(r["given"]) + " " + squeeze(r["surname"]), squeeze(r["surname"]), first_year(r["birth_date"]), first_year(r["death_date"]), place_norm(r["birth_place"])) for r in Tables(spark, sf_dir).persons.collect()]
    want = set()
    for a in people:
        for b in people:
            if a[0] < b[0] and a[2] == b[2] and a[3] == b[3] and (sim := similar(a[1], b[1])) >= 0.68:
                score = 0.5 * sim + 0.25 * same(a[3], b[3]) + 0.1 * same(a[4], b[4]) + 0.15 * (a[5] != "" and a[5] == b[5])
                if score >= 0.55:
                    want.add((f"{a[0]},{b[0]}", round(score, 2)))
    assert {(r["ids"], r["confidence"]) for r in genealogy.queries()["duplicate_people"](spark, sf_dir).collect()} == want


def test_similar_places(spark, sf_dir):
    t = Tables(spark, sf_dir)
    met = [r["place_raw"] for r in t.events.orderBy("id").collect()] + [x for r in t.persons.orderBy("id").collect() for x in (r["birth_place"], r["death_place"])]
    counts = Counter(x for x in met if x)
    values = sorted(counts, key=str.lower)
    want = Counter()
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            x, y = place_norm(a), place_norm(b)
            if x and y and x != y and (sim := similar(x, y)) >= 0.8:
                want[(round(sim, 2), float(counts[a] + counts[b]))] += 1
    got = Counter((r["confidence"], r["impact_score"]) for r in quality.similar_places(t).collect())
    assert got == want and sum(want.values()) > 0


def test_duplicate_assets(spark, sf_dir):
    name = lambda f: re.sub("[^a-z0-9]+", " ", re.sub(r"\.[^./]*$", "", f).lower()).strip()
    m = [(r["id"], name(r["original_filename"]), r["size_bytes"]) for r in Tables(spark, sf_dir).media_assets.collect()]
    want = set()
    for a in m:
        for b in m:
            if a[0] < b[0] and a[1][:4] == b[1][:4] and (sim := similar(a[1], b[1])) >= 0.92:
                near = a[2] and b[2] and abs(a[2] - b[2]) / max(a[2], b[2]) <= 0.02
                want.add((f"{a[0]},{b[0]}", round(min(0.99, sim + (0.1 if near else 0)), 2)))
    assert {(r["ids"], r["confidence"]) for r in genealogy.queries()["duplicate_assets"](spark, sf_dir).collect()} == want
