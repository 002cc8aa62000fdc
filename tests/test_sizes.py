"""Rows of a group, a task or a file do not grow with the tables."""

import difflib
import pickle
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinloom import queries as genealogy
from kinloom import source_queries
from kinloom.operators import actions, quality, records
from kinloom.plans.tables import Tables
from kinloom.sources import files, gedcom, genealogy_db
from kinloom.streaming import watch

from .test_entry import TABLES, rows


def same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return rows(genealogy.queries()[name](spark, sf_dir).toPandas()) == rows(con.execute(genealogy.ORACLES[name]).df())


def test_gedcom_texts_of_stretches(spark):
    d = spark.range(20_000)
    texts = source_queries._texts(d, F.concat(F.lit("\n0 @I"), F.col("id").cast("string"), F.lit("@ INDI")), "id")
    assert texts.count() == 4 * 5 and texts.agg(F.max(F.length("value"))).first()[0] < 50_000
    assert source_queries.parsed(texts).persons.select("file", "xref").distinct().count() == 20_000


@pytest.mark.parametrize("name", ["gedcom_families", "database_layout", "database_relationships", "database_two_files_edges", "database_two_files_links"])
def test_many_stretches(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(source_queries, "STRETCH", 60)
    t = Tables(spark, sf_dir)
    assert name.startswith("gedcom") or (source_queries.two_files(t) if "two" in name else source_queries.database_files(t)).count() > 6
    assert same_as_sql(spark, sf_dir, name)


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


def test_similar_forms(spark):
    """Strings of all lengths round SHORT, near and far: no pair that a ratio of 0.92 allows is lost."""
    r = random.Random(1)
    some = set()
    for _ in range(60):
        s = "head" + "".join(r.choice("01a ") for _ in range(r.choice((3, 5, 8, 9, 14, 15, 16, 17, 18, 21, 30))))
        for _ in range(6):
            k = r.randrange(4, len(s))
            some |= {s, s[:k] + s[k + 1 :], s[:k] + r.choice("01a") + s[k:], s[:k] + "b" + s[k + 1 :]}
            s = r.choice(sorted(some, key=len)[-20:]) if r.random() < 0.1 else s[:k] + s[k + 1 :] if len(s) > 8 else s
    want = {(a, b) for a in some for b in some if a < b and 2 * common(a, b) >= 0.92 * (len(a) + len(b)) - 1e-9}
    got = {(x["form_a"], x["form_b"]) for x in quality.similar_forms(spark.createDataFrame([(x,) for x in some], "form string"), 0.92).collect()}
    assert want <= got and len(want) > 100
    short = {(a, b) for a, b in got if max(len(a), len(b)) <= quality.SHORT}
    assert short <= want  # no pair is made in vain


def test_names_are_compared_once(spark, monkeypatch):
    """200 persons of two names make four pairs of names, which few calls compare, and 19,900 pairs of persons."""
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        calls.add(len(a))
        return pd.Series([1.0] * len(a))

    monkeypatch.setattr(quality, "ratio", counted)
    persons = spark.range(200).selectExpr("cast(id as int) as id", "concat('x', id % 2) as given", "'Doe' as surname", "'1900' as birth_date", "cast(null as string) as death_date", "'' as birth_place")
    found = quality.duplicate_people(Tables(spark, persons=persons))
    assert found.select(F.array_join("entity_ids", ",")).distinct().count() == 19_900
    assert 0 < calls.value <= 12


def test_person_pairs_in_parts(spark, monkeypatch):
    """Groups cut into parts give each pair once, by birth years, places and neighbouring death years."""
    monkeypatch.setattr(quality, "BLOCK", 3)
    some = [(i, "x" if i % 4 else "xy", "Doe", "1900" if i % 3 == 0 else None, str(1950 + i % 7) if i % 5 else None, f"p{i % 2}" if i % 11 else "") for i in range(90)]
    persons = spark.createDataFrame(some, "id int, given string, surname string, birth_date string, death_date string, birth_place string")
    t = Tables(spark, persons=persons)
    assert quality._person_groups(t)[0].filter("parts > 1").count() > 0
    close = lambda a, b: a is not None and b is not None and abs(int(a) - int(b)) <= 1
    want = sorted((a[0], b[0]) for a in some for b in some if a[0] < b[0] and a[3] == b[3] and (a[3] or close(a[4], b[4]) or (a[5] and a[5] == b[5])))
    assert sorted((r["id_a"], r["id_b"]) for r in quality.person_candidates(t).collect()) == want


def test_undo_rows_are_made_once(spark):
    """Undo from a log reads its rows once, however many tables the action changed."""
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(a: pd.Series) -> pd.Series:
        calls.add(len(a))
        return a

    edges = spark.createDataFrame([(1, 2, "parent"), (3, 2, "parent"), (1, 3, "parent"), (4, 5, "parent"), (3, 1, "parent")], "parent_person_id int, child_person_id int, rel_type string")
    persons = spark.createDataFrame([(i, f"n{i}") for i in range(1, 6)], "id int, given string")
    none = {"events": "id int, person_id int", "notes": "id int, person_id int", "media_links": "id int, asset_id int, person_id int, family_id int", "families": "id int, husband_person_id int, wife_person_id int", "family_children": "family_id int, child_person_id int"}
    t = Tables(spark, relationships=edges, persons=persons, **{k: spark.createDataFrame([], v) for k, v in none.items()})
    done = actions.merge_people(t, 3, 1)
    pairs = lambda d: sorted((r["parent_person_id"], r["child_person_id"]) for r in d.collect())
    assert pairs(done.tables.relationships) == [(1, 2), (4, 5)]
    log = records.undo_rows(done, 7)
    n = log.count()
    back = records.undo_logged(done.tables, log.withColumn("row_json", counted("row_json")), 7)
    assert pairs(back.relationships) == pairs(edges) and back.persons.count() == 5
    assert calls.value == n


def test_database_files_are_written_by_their_tasks(spark, sf_dir, tmp_path, monkeypatch):
    """Files never travel between tasks as values, and a task holds a batch of a file's rows at a time."""
    t, most = Tables(spark, sf_dir), spark.sparkContext.accumulator(0)
    real = source_queries._database

    def counted(path, batches, tables):
        def seen():
            for b in batches:
                most.add(1 if b.num_rows > 50 else 0)
                yield b

        return real(path, seen(), tables)

    monkeypatch.setattr(source_queries, "_database", counted)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        made = {r["path"]: r["size"] for r in source_queries.database_files(t, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert made and all((tmp_path / path).stat().st_size == size for path, size in made.items())
    assert most.value == 0 and max(made.values()) > 8000


def test_a_task_gets_its_own_pieces_only():
    """The reader that goes to every task does not grow with the tables."""
    size = lambda n: len(pickle.dumps(genealogy_db.DatabaseReader([genealogy_db.Pieces([("f", "t", 0, 9)])] * n, ["a"], None, ["file", "a"])))
    assert size(1) == size(1000)
    reader = genealogy_db.DatabaseReader([genealogy_db.Pieces([("f", "t", 0, 9)])] * 5, ["a"], None, ["file", "a"])
    assert len(reader.partitions()) == 5


def test_many_files_make_larger_tasks(spark, tmp_path, monkeypatch):
    """Tasks of a scan and of a watch do not grow in number with the files, and every file is read once."""
    folder, state = tmp_path / "media", tmp_path / "state"
    folder.mkdir()
    for k in range(200):
        (folder / f"{k}.jpg").write_text(str(k))
    monkeypatch.setattr(files, "TASKS", 2)
    monkeypatch.setattr(watch, "TASKS", 2)
    assert files.media_files(spark, str(folder)).rdd.getNumPartitions() == 2
    assert files.scan_media(spark, str(folder)).count() == 200
    reader = watch.FolderReader(str(folder), str(state), ["jpg"])
    parts = reader.partitions({"listing": 0}, reader.latestOffset())
    assert len(parts) == 2 and len({p for part in parts for p, _ in part.files}) == 200


def test_files_of_a_batch_are_read_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(a: pd.Series) -> pd.Series:
        calls.add(len(a))
        return a

    some = [(f"s{k}", f"p/{k}.jpg", f"{k}.jpg", "image/jpeg", k) for k in range(30)]
    found = spark.createDataFrame(some, "sha256 string, path string, original_filename string, mime_type string, size_bytes long").withColumn("sha256", counted("sha256"))
    watch.upsert_assets(found, str(tmp_path / "assets"), 0)
    assert watch.current_assets(spark, str(tmp_path / "assets")).count() == 30
    assert calls.value == 30


@pytest.mark.parametrize("name", ["media_scan_types", "watch_registration"])
def test_files_of_equal_ids_stay_apart(spark, tmp_path, monkeypatch, name):
    """Documents that share an id are files of their own, also where their contents come to one folder; null and empty texts are equal."""
    monkeypatch.setattr(source_queries, "STRETCH", 20)
    some = [(k % 40, None if k % 9 == 0 else "" if k % 11 == 0 else f"text {k % 150}") for k in range(300)] + [(7, "longer " * 500), (7, "short")]
    (tmp_path / "in").mkdir()
    d = spark.createDataFrame(some, "doc_id long, text string")
    d.toPandas().to_parquet(tmp_path / "in/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/in/documents.parquet'")
    want = con.execute(genealogy.ORACLES[name]).df()
    assert len(want) > 40
    assert rows(genealogy.queries()[name](spark, str(tmp_path / "in")).toPandas()) == rows(want)


def test_a_scan_lists_in_tasks(spark, tmp_path):
    """The driver holds no list of the folder's files; hidden ones are passed over, empty ones are not."""
    for k in range(60):
        at = tmp_path / f"d{k % 3}" / ("e" if k % 2 else "")
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{k}.jpg").write_text("" if k == 5 else str(k))
    (tmp_path / "_gone").mkdir()
    for hidden in ("_gone/a.jpg", ".b.jpg", "d0/_c.jpg"):
        (tmp_path / hidden).write_text("x")
    (tmp_path / "_k=1.jpg").write_text("kept")
    found = files.media_files(spark, str(tmp_path))
    assert not [f for f in found.inputFiles() if f.endswith(".jpg")]
    assert {r["path"].rsplit("/", 1)[1] for r in found.collect()} == {f"{k}.jpg" for k in range(60)} | {"_k=1.jpg"}
    assert files.media_files(spark, f"{tmp_path}/d*").count() == 60
    assert {r["path"].rsplit("/", 1)[1] for r in files.media_files(spark, str(tmp_path), recursive=False).collect()} == {"_k=1.jpg"}


def test_an_import_reads_its_texts_once(spark):
    """Texts are taken apart in one step (records and their beginnings), however often the import asks for families; lines are not dealt
    once more to find the events of their records."""
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(a: pd.Series) -> pd.Series:
        calls.add(len(a))
        return a

    part = "0 @F{0}@ FAM\n1 HUSB @I{0}@\n1 MARR\n", "2 DATE {0}\n1 CHIL @I1{0}@\n"  # an event and a record go on in the next text
    texts = spark.createDataFrame([("f", 2 * k + j, x.format(k)) for k in range(10, 30) for j, x in enumerate(part)], "file string, block long, value string")
    persons = spark.createDataFrame([(int(f"{a}{k}"), f"@I{a}{k}@") for k in range(10, 30) for a in ("", 1)], "id int, xref string")
    none = spark.createDataFrame([], "id int, xref string, husband_person_id int, wife_person_id int, marriage_date string, marriage_place string")
    lines = gedcom.split_lines(texts.withColumn("value", counted("value")))
    families, _, edges = gedcom.import_families(gedcom.parse(lines), persons, none, spark.createDataFrame([], "family_id int, child_person_id int"))
    assert sorted((r["parent_person_id"], r["child_person_id"]) for r in edges.collect()) == [(k, 100 + k) for k in range(10, 30)]
    assert sorted(r["marriage_date"] for r in families.collect()) == [str(k) for k in range(10, 30)]
    assert calls.value <= 2 * 40
    plan = gedcom.parse(gedcom.split_lines(texts)).families._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 5


def test_names_that_begin_differently_are_similar(spark):
    """No pair of a ratio of 0.92 is lost for its first characters, its length or its letters; candidates by SQL still begin alike."""
    names = ["img 20200101 12", "mg 20200101 12", "xmg 20200101 12", "imgs 20200101 12", "the summer house by the lake 1950", "he summer house by the lake 1950", "a summer house by the lake 1950", "summer house by the lake 1950"]
    names += ["scan of the old family book page 17 b", "scan of the old family book page 18 b", "can of the old family book page 17 b"]
    similar = {(a, b) for a in names for b in names if a < b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.92}
    assets = spark.createDataFrame([(k, f"{n}.jpg", 100) for k, n in enumerate(sorted(names))], "id int, original_filename string, size_bytes int")
    got = {tuple(sorted(names)[i] for i in r["entity_ids"]) for r in quality.duplicate_media_assets(Tables(spark, media_assets=assets)).collect()}
    assert got == similar and any(a[:4] != b[:4] and len(a) <= 20 for a, b in similar) and any(a[:4] != b[:4] and len(a) > 20 for a, b in similar)
    strange = ["äöü" * 5 + "ßéè" * 4 + "x" * k for k in range(2)]
    assert quality.similar_forms(spark.createDataFrame([(x,) for x in strange], "form string"), 0.92).count() == 1
    heads = {(sorted(names)[r["id_a"]], sorted(names)[r["id_b"]]) for r in quality.asset_candidates(Tables(spark, media_assets=assets)).collect()}
    assert heads and all(a[:4] == b[:4] for a, b in heads)


def test_edges_of_files_are_dealt_once_for_their_parents(spark, sf_dir):
    """An import deals edges by file and parent and persons by file and id once each, for telling repeats and for the joins."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = source_queries.imported_two(Tables(spark, sf_dir)).relationships._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert 0 < plan.count("Exchange hashpartitioning") <= 9
