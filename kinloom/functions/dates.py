"""The date cascade as one native expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_year

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _found(raw: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(raw, pattern, group), F.lit(""))


def _result(normalized: Column, precision: str | None, qualifier: Column, confidence: Column | float, ambiguous: bool) -> Column:
    return F.struct(
        normalized.alias("normalized"), F.lit(precision).cast("string").alias("precision"), qualifier.alias("qualifier"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).cast("double").alias("confidence"), F.lit(ambiguous).alias("ambiguous"),
    )


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: expressions that are long and used often would outgrow generated code."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _parts(raw: Column) -> Column:
    """What the rules look for in a trimmed date, as one struct."""
    numeric = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-][0-9]{3,4}$"
    between = r"(?i)\bBET\s+([0-9]{3,4})\s+AND\s+([0-9]{3,4})"
    iso = F.when(raw.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_timestamp(raw, F.lit("yyyy-M-d")))
    slashed = F.when(
        raw.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.coalesce(F.try_to_timestamp(raw, F.lit("d/M/yyyy")), F.try_to_timestamp(raw, F.lit("M/d/yyyy")))
    )
    turned = F.when(raw.rlike(r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), F.try_to_timestamp(raw, F.lit("yyyy/M/d")))
    head = r"^([A-Za-z]{3,9}|[0-9]{1,2})[ ,/]+([0-9]{3,4})"
    return F.struct(
        raw.alias("raw"), _found(raw, numeric, 1).cast("int").alias("a"), _found(raw, numeric, 2).cast("int").alias("b"),
        _found(raw, between, 1).alias("start"), _found(raw, between, 2).alias("end"),
        F.lower(_found(raw, r"(?i)\b(ABT|ABOUT|BEF|AFT|EST|CALC|CIRCA|CA)\b")).alias("qualifier"),
        F.date_format(F.coalesce(iso, slashed, turned), "yyyy-MM-dd").alias("day"),
        F.lower(_found(raw, head, 1)).alias("word"), _found(raw, head, 2).alias("year"), first_year(raw).alias("only"),
    )


def _decide(p: Column) -> Column:
    none, word, qualifier = F.lit(None).cast("string"), p["word"], p["qualifier"]
    place = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.substring(word, 1, 3))
    month = F.nullif(F.when(word.rlike("^[0-9]"), F.try_to_number(word, F.lit("99")).cast("int")).otherwise(place.cast("int")), F.lit(0))
    joined = F.concat(F.lpad(p["year"], 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))
    return (
        F.when(p["raw"] == "", _result(none, None, none, 0.0, False))
        .when(p["a"].between(1, 12) & p["b"].between(1, 12) & (p["a"] != p["b"]), _result(none, None, none, 0.0, True))
        .when(p["start"].isNotNull(), _result(F.concat(p["start"], F.lit("/"), p["end"]), "range", F.lit("between"), 0.7, False))
        .when(p["day"].isNotNull(), _result(p["day"], "day", qualifier, 0.95, False))
        .when(month.isNotNull(), _result(joined, "month", qualifier, 0.85, False))
        .when(p["only"].isNotNull(), _result(p["only"].cast("string"), "year", qualifier, F.when(qualifier.isNotNull(), 0.6).otherwise(0.7), False))
        .otherwise(_result(none, None, qualifier, 0.0, True))
    )


def parse_date(value: Column) -> Column:
    """struct(normalized, precision, qualifier, confidence, ambiguous) of a free-form date.

    The first rule that fits wins: blank, two plausible day/month orders, BET..AND ranges, full dates, month and year,
    a year alone, and at last unknown (ambiguous).  Day precision covers years from 1000.
    """
    raw = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)^\s+|\s+$", "")
    return bind(raw, lambda r: bind(_parts(r), _decide))


def canonical_timestamp(normalized: Column, current: Column) -> Column:
    """Start of the normalised day, month or year; null where it is short or no date; other lengths keep the current value."""
    n = F.length(F.coalesce(normalized, F.lit("")))
    parsed = F.when(n == 10, F.try_to_timestamp(normalized, F.lit("yyyy-MM-dd"))).when(n == 7, F.try_to_timestamp(normalized, F.lit("yyyy-MM"))).when(n == 4, F.try_to_timestamp(normalized, F.lit("yyyy")))
    return F.when(n.isin(4, 7, 10), parsed.cast("timestamp_ntz")).when(n < 4, F.lit(None).cast("timestamp_ntz")).otherwise(current)
