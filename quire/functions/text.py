"""String functions: emptiness, canonical forms, masks of OCR text, file names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions.dates import canonical_date

SPACES = r"(?U)\s+"


def is_blank_strict(value: Column) -> Column:
    """Null or the empty string; a blank counts as a value."""
    return value.isNull() | (value == "")


def is_blank_trim(value: Column) -> Column:
    """Null, empty, or nothing but white space."""
    return value.isNull() | ~value.rlike(r"(?U)\S")


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def squeeze(value: Column) -> Column:
    """White space runs to one blank, and none at either end."""
    return F.trim(F.regexp_replace(value, SPACES, " "))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def canonical_phone(value: Column) -> Column:
    d = digits(value)
    ten = F.when(F.length(d) == 10, d).when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10))
    return F.coalesce(F.concat(F.lit("("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4)), value)


def canonical_ssn(value: Column) -> Column:
    d = digits(value)
    return F.when(F.length(d) == 9, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4))).otherwise(value)


def canonical_npi(value: Column) -> Column:
    d = digits(value)
    return F.when(F.length(d) == 10, d).otherwise(value)


def canonical_member_id(value: Column, payer: Column) -> Column:
    """Upper case without blanks and dashes; two payers have a form of their own, which the result keeps."""
    plain = F.upper(F.regexp_replace(value, r"[\s\-]", ""))
    anthem = F.regexp_extract(plain, r"^([A-Z]{3}\d{9,})", 1)
    united = F.regexp_extract(plain, r"^(\d{9,11})$", 1)
    return F.when((payer == "ANTHEM") & (anthem != ""), anthem).when((payer == "UNITED_HEALTH") & (united != ""), united).otherwise(plain)


def canonicalize(value: Column, kind: Column, payer: Column) -> Column:
    """The canonical form of a value of a kind (date, phone, ssn, member_id, npi, else text); null and empty give ''."""
    v = strip(value)
    out = (
        F.when(kind == "date", canonical_date(v)).when(kind == "phone", canonical_phone(v)).when(kind == "ssn", canonical_ssn(v))
        .when(kind == "member_id", canonical_member_id(v, payer)).when(kind == "npi", canonical_npi(v)).otherwise(squeeze(v))
    )
    return F.when(is_blank_strict(value), "").otherwise(out)


def comparison_key(value: Column, kind: Column, payer: Column) -> Column:
    """What two values that mean the same share."""
    return F.regexp_replace(F.lower(canonicalize(value, kind, payer)), "[^a-z0-9]", "")


def field_kind(key: Column) -> Column:
    k = F.lower(key)
    has = lambda *words: F.lit(False) if not words else _any(k, words)
    return F.when(has("date", "dob"), "date").when(has("phone", "fax"), "phone").when(has("ssn", "social"), "ssn").when(has("npi"), "npi").otherwise("text")


def _any(value: Column, words: tuple[str, ...]) -> Column:
    out = value.contains(words[0])
    for w in words[1:]:
        out = out | value.contains(w)
    return out


def clean_ocr_text(value: Column) -> Column:
    """Control characters out, white space runs to one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"\s+", " "))


def ocr_fold(value: Column, one: str = "l") -> Column:
    """Lower case with the digits OCR takes for letters; ``one`` is what 1 becomes."""
    return F.translate(F.lower(value), "01", "o" + one)


def strip_label(value: Column, label: str) -> Column:
    """``value`` without a leading label, once."""
    return F.trim(F.regexp_replace(value, "(?i)^\\s*(?:" + label + ")\\s*[:#|=.\\-]*\\s*", ""))


def inline_value(value: Column) -> Column:
    """What follows the first colon, pipe or hash; '' if there is none."""
    return F.trim(F.regexp_extract(value, r"^[^:|#]*[:|#](.*)$", 1))


def storage_key(tenant: Column, at: Column, sha: Column, name: Column) -> Column:
    return F.concat_ws("/", tenant, F.date_format(at, "yyyy/MM/dd"), F.concat_ws("_", F.substring(sha, 1, 8), name))


def magic_type(content: Column) -> Column:
    """The MIME type that a file's first bytes name, null if none or if there are fewer than 16."""
    starts = lambda h: F.substring(F.hex(content), 1, len(h)) == h
    kind = F.when(starts("25504446"), "application/pdf").when(starts("49492A00") | starts("4D4D002A"), "image/tiff").when(starts("89504E470D0A1A0A"), "image/png").when(starts("FFD8FF"), "image/jpeg")
    return F.when(F.octet_length(content) >= 16, kind)


@F.pandas_udf(StringType())
def sanitized_name(names: pd.Series) -> pd.Series:
    """A safe file name: NFKC, base name, no dots in a row, odd characters to _, at most 255 with the ending kept."""
    import re

    def one(name):
        base = re.split(r"[/\\]", unicodedata.normalize("NFKC", name or ""))[-1].replace("..", "")
        base = re.sub(r"\s+", "_", re.sub(r"[^\w.\- ]", "_", base)).strip("_. ")
        if len(base) > 255:
            stem, dot, end = base.rpartition(".")
            base = stem[: 255 - len(end) - 1] + dot + end if dot else base[:255]
        return base or "unnamed_fax"

    return names.map(one, na_action=None)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))
