"""Normalisers of names, places, files and years as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that stand for no name (fixed values).
PLACEHOLDERS = ("unknown", "n/a", "na", "none")
BLANKS = r"(?U)\s+"


def collapse_spaces(x: Column) -> Column:
    """White space runs become one space, the ends are trimmed; null stays null."""
    return F.trim(F.regexp_replace(x, BLANKS, " "))


def norm_name(x: Column) -> Column:
    return collapse_spaces(F.lower(F.coalesce(x, F.lit(""))))


def norm_text(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)^\s+|\s+$", "")


def place_key(x: Column) -> Column:
    return norm_name(F.replace(F.coalesce(x, F.lit("")), F.lit(";"), F.lit(",")))


def norm_place(x: Column) -> Column:
    """Lower case, marks to spaces, ; and | to commas, and the short words st, mt and co spelt out inside the name."""
    v = F.replace(F.lower(F.coalesce(x, F.lit(""))), F.lit("."), F.lit(" "))
    v = F.regexp_replace(F.regexp_replace(v, "[;|]+", ","), "[^a-z0-9, ]+", " ")
    for short, full in (("st", "street"), ("mt", "mount"), ("co", "county")):
        v = F.replace(v, F.lit(f" {short} "), F.lit(f" {full} "))
    return F.trim(F.regexp_replace(v, " +", " "))


def norm_filename(x: Column) -> Column:
    stem = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?<=[^/])(?<![./])\.[^./]*$", "")
    return F.trim(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", " "))


def normalize_path(x: Column) -> Column:
    v = F.regexp_replace(F.translate(F.trim(F.coalesce(x, F.lit(""))), "\\", "/"), "/+", "/")
    return F.lower(F.regexp_replace(F.regexp_replace(v, "^[A-Za-z]:", ""), "^/+", ""))


def case_state(x: Column) -> Column:
    """'upper' or 'lower' where all letters agree, else null."""
    letters = F.regexp_replace(x, r"\P{L}", "")
    agree = lambda c, name: F.when((F.length(letters) > 0) & (letters == c), name)
    return F.coalesce(agree(F.upper(letters), "upper"), agree(F.lower(letters), "lower"))


def _cap(w: Column) -> Column:
    low = F.lower(w)
    plain = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1_000_000))
    scots = F.concat(F.lit("Mc"), F.upper(F.substring(low, 3, 1)), F.substring(low, 4, 1_000_000))
    return F.when(low.rlike(r"^mc\p{L}"), scots).otherwise(plain)


def title_case(x: Column) -> Column:
    piece = lambda p: F.array_join(F.transform(F.split(p, "'", -1), _cap), "'")
    token = lambda t: F.array_join(F.transform(F.split(t, "-", -1), piece), "-")
    return F.array_join(F.transform(F.split(collapse_spaces(x), " ", -1), token), " ")


def suggest_name(x: Column) -> Column:
    """struct(suggestion, reasons): what to change a name to and why; no reasons where it is fine, null or empty."""
    flat = collapse_spaces(x)
    titled = title_case(x)
    recase = case_state(flat).isNotNull() & (titled != flat)
    reasons = F.array_compact(F.array(F.when(flat != x, F.lit("trim_whitespace")), F.when(recase, F.lit("title_case"))))
    some = x.isNotNull() & (x != "")
    return F.struct(
        F.when(some & recase, titled).when(some, flat).otherwise(x).alias("suggestion"),
        F.when(some, reasons).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )


def first_year(x: Column) -> Column:
    """The first run that reads 1500 to 2099, as data-quality rules use it."""
    return F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), r"(1[5-9]\d\d|20\d\d)", 1), F.lit("")).cast("int")


def least_year(x: Column) -> Column:
    """The least of all four-digit runs, as analytics use it."""
    return F.array_min(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("([0-9]{4})"), F.lit(1)), lambda y: y.cast("int")))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def blank(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) == ""


def mime_of(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    known = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "pdf": "application/pdf", "heic": "image/heic", "mp4": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo", "mkv": "video/x-matroska"}
    out = F.lit("application/octet-stream")
    for k, v in known.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def full_name(given: Column, surname: Column) -> Column:
    name = F.trim(F.concat_ws(" ", F.trim(F.coalesce(given, F.lit(""))), F.trim(F.coalesce(surname, F.lit("")))))
    return F.when(name == "", "(unnamed)").otherwise(name)


def short_label(value: Column, most: int) -> Column:
    """The trimmed value, cut to so many characters with an ellipsis as the last."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.length(v) <= most, v).otherwise(F.concat(F.left(v, F.lit(max(1, most - 1))), F.lit("…")))


def life_span(birth: Column, death: Column) -> Column:
    """The two dates with a dash between, ? for one that is missing, nothing where both are."""
    b, d = (F.trim(F.coalesce(x, F.lit(""))) for x in (birth, death))
    known = lambda x: F.when(x == "", "?").otherwise(x)
    return F.when((b == "") & (d == ""), "").otherwise(F.concat(known(b), F.lit(" – "), known(d)))


def node_lines(given: Column, surname: Column) -> Column:
    """The lines of a person's label: both names, or one line of what there is."""
    g, s = short_label(given, 14), short_label(surname, 14)
    return F.when((g != "") & (s != ""), F.array(g, s)).otherwise(F.array(short_label(full_name(given, surname), 18)))
