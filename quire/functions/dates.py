"""Date strings, with two-digit years expanded by hand: 69 is the pivot of a whole date, 50 that of one found inside a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _made(year: Column, month: Column, day: Column) -> Column:
    """A date, null if there is no such day."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when((year >= 1) & (year <= 9999), F.try_to_date(text, "yyyy-MM-dd"))


def _numbers(value: Column, pattern: str) -> tuple[Column, Column, Column]:
    return tuple(F.regexp_extract(value, pattern, i).try_cast("int") for i in (1, 2, 3))


def _pivot(year: Column, at: int) -> Column:
    return F.when(year < at, year + 2000).otherwise(year + 1900)


def parsed(value: Column) -> Column:
    """The first of seven forms that the whole value has: m/d/Y, m-d-Y, Y-m-d, m/d/y, m-d-y, Month d, Y and Mon d, Y."""
    m, d, y = _numbers(value, r"^(\d{1,2})/(\d{1,2})/(\d{4})$")
    m2, d2, y2 = _numbers(value, r"^(\d{1,2})-(\d{1,2})-(\d{4})$")
    y3, m3, d3 = _numbers(value, r"^(\d{4})-(\d{1,2})-(\d{1,2})$")
    m4, d4, y4 = _numbers(value, r"^(\d{1,2})[/](\d{1,2})[/](\d{2})$")
    m5, d5, y5 = _numbers(value, r"^(\d{1,2})-(\d{1,2})-(\d{2})$")
    name = F.regexp_replace(value, r"\s+", " ")
    named = F.when(name.rlike(r"(?i)^[a-z]{3,9} \d{1,2}, \d{4}$"), F.coalesce(F.try_to_date(F.initcap(name), "MMMM d, yyyy"), F.try_to_date(F.initcap(name), "MMM d, yyyy")))
    return F.coalesce(_made(y, m, d), _made(y2, m2, d2), _made(y3, m3, d3), _made(_pivot(y4, 69), m4, d4), _made(_pivot(y5, 69), m5, d5), named)


def canonical_date(value: Column) -> Column:
    """yyyy-MM-dd of a whole date, else of the first m/d/y inside the value, else the value."""
    inside = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})"
    m, d, y = _numbers(value, inside)
    length = F.length(F.regexp_extract(value, inside, 3))
    found = _made(F.when(length == 2, _pivot(y, 50)).otherwise(y), m, d)
    return F.coalesce(F.date_format(parsed(value), "yyyy-MM-dd"), F.date_format(found, "yyyy-MM-dd"), value)


def valid_date(value: Column, as_of: Column) -> Column:
    """Null unless the value is a date from 1900 to the end of the fifth year from ``as_of``."""
    d = parsed(F.trim(value))
    return F.when((d >= F.make_date(F.lit(1900), F.lit(1), F.lit(1))) & (d <= F.make_date(F.year(as_of) + 5, F.lit(12), F.lit(31))), d)


def years_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / 365.25
