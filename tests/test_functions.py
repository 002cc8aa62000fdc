from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kinloom.functions import text as X
from kinloom.functions.dates import canonical_timestamp, parse_date
from kinloom.functions.similarity import can_reach, ratio

DATES = [
    (None, (None, None, None, 0.0, False)), ("  ", (None, None, None, 0.0, False)), ("3/4/1881", (None, None, None, 0.0, True)), ("3-4-1881", (None, None, None, 0.0, True)),
    ("BET 1900 AND 1910", ("1900/1910", "range", "between", 0.7, False)), ("BET 1 JAN 1900 AND 1910", ("1900", "year", None, 0.7, False)), ("CA. 1850", ("1850", "year", "ca", 0.6, False)),
    ("Before 1900", ("1900", "year", None, 0.7, False)), ("13/4/1881", ("1881-04-13", "day", None, 0.95, False)), ("4/13/1881", ("1881-04-13", "day", None, 0.95, False)),
    ("4/4/1881", ("1881-04-04", "day", None, 0.95, False)), ("1881-3-4", ("1881-03-04", "day", None, 0.95, False)), ("MAR 1881", ("1881-03", "month", None, 0.85, False)),
    ("Mayor 1850", ("1850-05", "month", None, 0.85, False)), ("99 1881", ("1881-99", "month", None, 0.85, False)), ("MAR 188", ("0188-03", "month", None, 0.85, False)),
    ("Mar 18812", ("1881-03", "month", None, 0.85, False)), ("1 JAN 1980", ("1980", "year", None, 0.7, False)), ("ABT MAR 1881", ("1881", "year", "abt", 0.6, False)),
    ("13-4-1881", ("1881", "year", None, 0.7, False)), ("1450", (None, None, None, 0.0, True)), ("unknown", (None, None, None, 0.0, True)), ("About 1900", ("1900", "year", "about", 0.6, False)),
]


def values(spark, expr, inputs):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r["o"] for r in d.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_date_cascade(spark):
    got = values(spark, parse_date, [d for d, _ in DATES])
    assert [tuple(g) for g in got] == [e for _, e in DATES]


@pytest.mark.parametrize("f, cases", [
    (X.norm_name, {None: "", "  John \t Doe ": "john doe", "": ""}),
    (X.collapse_spaces, {None: None, " a  b ": "a b"}),
    (X.case_state, {"ABC 1": "upper", "abc": "lower", "Abc": None, "12": None}),
    (X.title_case, {"DOE": "Doe", "mcdonald o'neil-SMITH": "McDonald O'Neil-Smith", "mc": "Mc"}),
    (X.norm_place, {"St. Louis; MO": "st louis, mo", "Port St. Lucie": "port street lucie", None: "", "Springfield; IL ": "springfield, il"}),
    (X.place_key, {"A;  B ": "a, b", None: ""}),
    (X.norm_filename, {"family photo.JPG": "family photo", "family_photo.jpg": "family photo", ".hidden": "hidden", None: ""}),
    (X.normalize_path, {r"C:\Users\Me\Media\Photo.JPG": "users/me/media/photo.jpg", "//a//b": "a/b"}),
    (X.first_year, {"1450 and 1560": 1560, "x": None, "21881": 1881}),
    (X.least_year, {"1450 and 1360": 1360, "x": None, None: None}),
    (X.mime_of, {"a.PNG": "image/png", "a": "application/octet-stream"}),
])
def test_normalizers(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_suggestions(spark):
    got = values(spark, X.suggest_name, ["JOHN", "DOE ", "Ann", None, ""])
    assert [(g[0], g[1]) for g in got] == [("John", ["title_case"]), ("Doe", ["trim_whitespace", "title_case"]), ("Ann", []), (None, []), ("", [])]


def test_canonical_timestamp(spark):
    d = spark.createDataFrame([("1881-04-13",), ("1881-99",), ("1881",), ("18",), ("1900/1910",)], "n string")
    got = [r[0] for r in d.select(canonical_timestamp(F.col("n"), F.lit("2000-01-01").cast("timestamp_ntz"))).collect()]
    assert [g and g.year for g in got] == [1881, None, 1881, None, 2000]


def test_ratio_and_its_bound(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("john sample", "jon sample"), ("", "a"), ("abc", "abc"), ("a" * 30, "a")]
    d = spark.createDataFrame(pairs, "a string, b string")
    for r in d.select("a", "b", ratio("a", "b").alias("r"), can_reach(F.col("a"), F.col("b"), 0.68).alias("may")).collect():
        want = SequenceMatcher(None, r["a"], r["b"]).ratio() if r["a"] and r["b"] else 0.0
        assert r["r"] == want
        assert r["may"] or want < 0.68
