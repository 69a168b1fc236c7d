"""Field validation (H11-H16) and checks across fields (H33-H38, N6). Messages are codes; '' or an empty array means none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.dates import parsed, valid_date
from quire.functions.text import digits, field_kind, is_blank_trim

# The fields that must be there where a payer has no list of its own.
DEFAULT_REQUIRED = ("member_id", "patient_name", "date_of_birth", "prior_auth_number")


def phone_ok(value: Column) -> Column:
    d = digits(value)
    return (F.length(d) == 10) | ((F.length(d) == 11) & d.startswith("1"))


def ssn_ok(value: Column) -> Column:
    d = digits(value)
    return (F.length(d) == 9) & (F.substring(d, 1, 3) != "000") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def npi_ok(value: Column) -> Column:
    """Ten digits with a plain Luhn sum."""
    d = digits(value)
    return (F.length(d) == 10) & F.call_function("luhn_check", d)


def errors(key: Column, value: Column, as_of: Column, required=DEFAULT_REQUIRED) -> Column:
    """Error codes of a value by the kind its key names."""
    kind = field_kind(key)
    bad = (
        F.when((kind == "date") & valid_date(value, as_of).isNull(), "INVALID_DATE").when((kind == "phone") & ~phone_ok(value), "INVALID_PHONE")
        .when((kind == "ssn") & ~ssn_ok(value), "INVALID_SSN").when((kind == "npi") & ~npi_ok(value), "INVALID_NPI")
    )
    missing = F.when(key.isin(*required), "REQUIRED")
    return F.array_compact(F.array(F.when(is_blank_trim(value), missing).otherwise(bad)))


def date_order(effective: Column, expiration: Column) -> Column:
    a, b = parsed(F.trim(effective)), parsed(F.trim(expiration))
    return F.when(b < a, "ERROR").when(b == a, "WARNING").otherwise("")


def decision_consistency(decision: Column, reason: Column, units: Column) -> Column:
    d = F.upper(decision)
    return F.when((d == "DENIED") & is_blank_trim(reason), "DENIED_WITHOUT_REASON").when((d == "APPROVED") & is_blank_trim(units), "APPROVED_WITHOUT_UNITS").otherwise("")


def dob_in_past(dob: Column, as_of: Column) -> Column:
    return F.when(parsed(F.trim(dob)) >= as_of, "ERROR").otherwise("")


def bad_codes(value: Column, pattern: str) -> Column:
    """The codes of a list that do not have the form."""
    return F.filter(F.split(value, r"[,;\s]+", -1), lambda x: (x != "") & ~x.rlike(pattern))


def same_digits(a: Column, b: Column, least: int = 1) -> Column:
    return (digits(a) == digits(b)) & (F.length(digits(a)) >= least)


def prose(value: Column, words: int = 4) -> Column:
    return F.size(F.array_remove(F.split(value, r"\s+", -1), "")) > words
