"""Fields that extraction missed or got wrong, read again from the whole text of a document.

Every scan gives one struct of a field, or null where it has nothing to say. All of them are column expressions over one
row per job, so a job costs one pass and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import digits, strip

READ = "TEMPLATE_OCR"
#: What a job's ``fields`` map holds, and what the scans return.
CANDIDATE = "struct<value: string, confidence: double, method: string>"
FIELD = f"struct<value: string, confidence: double, method: string, candidates: array<{CANDIDATE}>>"

# The forms that the scans look for.
SERVICE_CODE = r"(?U)\b([A-Z]\d{4}[A-Z]?)\b"
DATE_RANGE = r"(?U)(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})\s*[-–]+\s*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"
SERVICE_DATES = r"(?iU)(?:Service|Authorization)\s+dates?\s*:?\s*(\d{1,2}/\d{1,2}/\d{4})\s*[-–]+\s*(\d{1,2}/\d{1,2}/\d{4})"
UNITS = r"(?iU)(?:units?|visits?)\s+(?:authorized|approved|requested)\s*:?\s*(\d+)"
REFERENCE = r"(?iU)Reference\s*#\s*:?\s*([A-Za-z0-9]{5,25})"
MEMBER_NAME = r"(?iUd)^Member\s+Name\s*:?\s*(.+)"
NAME_ENDS = r"(?iUd)\s+(?:Requesting|Servicing|Ordering|Attending|Referring|Primary)\s+Provider.*$"
FOLLOWING_MEMBER = r"(?iU)following\s+member\s*:[ \t]*\n\s*([^\n]+)"


def _value(fields: Column, key: str) -> Column:
    """The value of a field, null if it is absent or empty."""
    return F.nullif(fields[key]["value"], F.lit(""))


def _found(key: str, value: Column, confidence, evidence: Column, method=READ) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(key).alias("field_key"), value.alias("value"), as_column(confidence).cast("double").alias("confidence"), as_column(method).alias("method"), evidence.alias("evidence"))


def _first(text: Column, pattern: str) -> Column:
    """The first match as a whole, null if there is none. Its groups are read from it again."""
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def service_code(fields: Column, codes: Column) -> Column:
    """The first procedure code of the text, where the field has none; the first three different ones are the evidence."""
    seen = F.concat(F.lit("OCR scan: "), F.array_join(F.slice(codes, 1, 3), " "))
    return F.when(_value(fields, "service_code").isNull() & (F.size(codes) > 0), _found("service_code", F.get(codes, F.lit(0)), 0.65, seen))


def expiration_of_range(fields: Column, ranges: Column) -> Column:
    """The end of the first range that starts on the known effective date, where the expiration is missing."""
    start = digits(_value(fields, "auth_effective_date"))
    one = F.get(F.filter(ranges, lambda m: digits(F.regexp_extract(m, DATE_RANGE, 1)) == start), F.lit(0))
    missing = _value(fields, "auth_effective_date").isNotNull() & _value(fields, "auth_expiration_date").isNull()
    return F.when(missing & one.isNotNull(), _found("auth_expiration_date", F.regexp_extract(one, DATE_RANGE, 2), 0.70, F.concat(F.lit("OCR range: "), one)))


def service_dates(fields: Column, one: Column) -> tuple[Column, Column]:
    """Effective date and, where it is missing too, expiration, from the first labelled range, if no effective date is known."""
    known = one.isNotNull() & _value(fields, "auth_effective_date").isNull()
    seen = F.concat(F.lit("OCR: "), one)
    start = F.when(known, _found("auth_effective_date", F.regexp_extract(one, SERVICE_DATES, 1), 0.65, seen))
    return start, F.when(known & _value(fields, "auth_expiration_date").isNull(), _found("auth_expiration_date", F.regexp_extract(one, SERVICE_DATES, 2), 0.65, seen))


def units(fields: Column, one: Column) -> Column:
    """The first stated number of units or visits, if it is from 1 to 9999 and the field is missing."""
    n = F.regexp_extract(one, UNITS, 1)
    return F.when(_value(fields, "units_requested").isNull() & n.rlike(r"^0*[1-9]\d{0,3}$"), _found("units_requested", n, 0.65, F.concat(F.lit("OCR: "), one)))


def prior_auth_number(fields: Column, one: Column) -> Column:
    """A replacement of a number that cannot be one: its first fitting candidate, else a reference number, else null (cleared).

    A number cannot be one if it has a blank, fewer than five characters, or a hyphen and little confidence from the model.
    """
    field = fields["prior_auth_number"]
    v = F.coalesce(strip(field["value"]), F.lit(""))
    unsure = v.contains("-") & (F.coalesce(field["confidence"], F.lit(0.0)) < 0.5) & F.coalesce(field["method"] == "LAYOUTLM", F.lit(False))
    wrong = field.isNotNull() & (v.contains(" ") | (F.length(v) < 5) | unsure)

    def fits(c):
        s = strip(c["value"])
        return F.coalesce(~s.contains(" ") & ~s.contains("-") & (F.length(s) >= 5) & (s != v), F.lit(False))

    other = F.get(F.filter(field["candidates"], fits), F.lit(0))
    sure = F.coalesce(F.nullif(other["confidence"], F.lit(0.0)), F.lit(0.65))
    read = _found("prior_auth_number", F.regexp_extract(one, REFERENCE, 1), 0.65, F.concat(F.lit("OCR: "), one))
    none = F.lit(None).cast("string")
    taken = _found("prior_auth_number", other["value"], sure, none, F.coalesce(other["method"], F.lit(READ)))
    return F.when(wrong, F.when(other.isNotNull(), taken).when(one.isNotNull(), read).otherwise(_found("prior_auth_number", none, F.lit(None), none, none)))


def _before_digits(value: Column) -> Column:
    return strip(F.regexp_replace(value, r"(?Us)\s*\d.*$", ""))


def _named(value: Column) -> Column:
    """Null if under three characters or without a letter."""
    return F.when((F.length(value) >= 3) & value.rlike(r"\p{L}"), value)


def labelled_name(text: Column) -> Column:
    """The first name on a line that starts with its label, and the line; null if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x.rlike(MEMBER_NAME))

    def named(x):
        said = _before_digits(F.regexp_replace(F.regexp_extract(x, MEMBER_NAME, 1), NAME_ENDS, ""))
        return F.struct(_named(strip(F.regexp_replace(said, "^,+|,+$", ""))).alias("name"), x.alias("line"))

    return F.get(F.filter(F.transform(lines, named), lambda x: x["name"].isNotNull()), F.lit(0))


def following_name(text: Column) -> Column:
    """The name on the line after "following member:", null if there is none."""
    return _named(_before_digits(F.regexp_replace(strip(F.regexp_extract(text, FOLLOWING_MEMBER, 1)), ",+$", "")))


def patient_name(fields: Column, line: Column, follows: Column, cleared: Column) -> Column:
    """The name after "following member:", which outranks a different one; where there is none, a candidate or a labelled name.

    ``cleared``: the field as it was before it was taken for somebody else's name, null if it was not. Its first candidate
    that differs from it, and whose words are not all words of the provider's name, is taken.
    """
    words = lambda c: F.array_remove(F.split(F.regexp_replace(F.lower(c), "[^a-z]", " "), " +"), "")
    now, provider = _value(fields, "patient_name"), words(F.coalesce(_value(fields, "provider_name"), F.lit("")))

    def own(c):
        s, w = strip(c["value"]), words(c["value"])
        theirs = (F.size(w) > 0) & (F.size(provider) > 0) & (F.size(F.array_except(w, provider)) == 0)
        return F.coalesce((s != "") & ~theirs & ~s.eqNullSafe(cleared["value"]), F.lit(False))

    none = F.lit(None).cast("string")
    other = F.get(F.filter(cleared["candidates"], own), F.lit(0))
    sure = F.coalesce(F.nullif(other["confidence"], F.lit(0.0)), F.lit(0.60))
    taken = F.when(other.isNotNull(), _found("patient_name", strip(other["value"]), sure, none, F.coalesce(other["method"], F.lit(READ))))
    read = F.when(line.isNotNull(), _found("patient_name", line["name"], 0.60, F.concat(F.lit("OCR: "), line["line"])))
    missing = F.when(now.isNull(), F.coalesce(taken, read))

    standing = F.coalesce(missing["value"], now, F.lit(""))
    return F.when(follows.isNotNull() & (F.upper(standing) != F.upper(follows)), _found("patient_name", follows, 0.85, F.concat(F.lit("OCR: following member: "), follows))).otherwise(missing)


def recoveries(jobs: DataFrame) -> DataFrame:
    """One row for each field that is read again: job_id, field_key, value, confidence, method, evidence.

    ``jobs``: job_id, text (of all pages), scanned (text of the active pages and loose tokens, for codes), ``fields``
    (map of key to ``FIELD``) and ``cleared_name`` (a ``FIELD`` or null). Null texts and absent fields find nothing. A
    null value says that the field is to be removed.
    """
    text = F.coalesce("text", F.lit(""))
    read = jobs.select(  # each pattern runs once over a text; what it finds is used several times below
        "job_id", "fields", "cleared_name", F.array_distinct(F.regexp_extract_all(F.coalesce("scanned", F.lit("")), F.lit(SERVICE_CODE), F.lit(1))).alias("codes"),
        F.regexp_extract_all(text, F.lit(DATE_RANGE), F.lit(0)).alias("ranges"), _first(text, SERVICE_DATES).alias("dates"), _first(text, UNITS).alias("units"),
        _first(text, REFERENCE).alias("reference"), labelled_name(text).alias("line"), following_name(text).alias("follows"),
    )
    fields, of = F.col("fields"), F.col
    start, end = service_dates(fields, of("dates"))
    scans = F.array(
        service_code(fields, of("codes")), expiration_of_range(fields, of("ranges")), start, end, units(fields, of("units")),
        prior_auth_number(fields, of("reference")), patient_name(fields, of("line"), of("follows"), of("cleared_name")),
    )
    return read.select("job_id", F.inline(F.array_compact(scans)))
