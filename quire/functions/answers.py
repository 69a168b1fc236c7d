"""What a model's answer is worth for its field (H24): a cleaned value, or null for an answer that cannot be one; and the
checks on prose and prior decisions beside it (H34, H38, H40)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.dates import parsed, years_between
from quire.functions.text import canonical_phone, digits

# Words that no field value has, and words that name a field.
PROSE = ("verification", "eligibility", "contractual", "please", "https", "available", "benefits", "coverage", "guidelines", "department", "sincerely", "seriously", "information", "services", "medical", "language", "people", "free", "provide", "address", "contact", "regarding", "original", "documents", "return", "above")
LABELS = ("memberid", "member", "subscriber", "enrollee", "provider", "authorization", "phone", "fax", "date", "name", "npi")
MEMBER_REJECT = ("date span", "review", "next", "authorization", "span", "member", "phone", "provider", "enrollee", "plan id", "subscriber", "medicaid")
ORGANIZATIONS = ("llc", "inc", "corp", "ltd", "healthcare", "clinical", "services", "hospital", "medical", "center", "health", "caresource", "molina", "anthem", "humana", "buckeye", "amerihealth", "paramount", "promedica", "aetna", "unitedhealth")
PROVIDER_REJECT = ("sincerely", "seriously", "dear", "regards", "attention", "department", "yours truly", "location address", "service location", "risk your", "physical health", "coverage", "benefits", "eligibility", "please contact", "free language", "authorization", "authorized", "mycare hours", "customer care", "menu option")
PAYER_NAMES = ("caresource", "molina healthcare", "anthem", "humana", "buckeye health", "amerihealth", "paramount advantage", "promedica", "aetna", "unitedhealth", "united health")
DATE = r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}"
PHONE = r"^\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}$"
TOLL_FREE = r"^1[\s\-.]?8\d{2}[\s\-.]?\d{3}[\s\-.]?\d{4}$"


def _count(text: Column, words: tuple[str, ...]) -> Column:
    low, out = F.lower(text), F.lit(0)
    for w in words:
        out = out + F.when(low.contains(w), 1).otherwise(0)
    return out


def _bare(word: Column, around: str) -> Column:
    return F.regexp_replace(word, f"^[{around}]+|[{around}]+$", "")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+", -1), "")


def _joined(words: Column) -> Column:
    return F.nullif(F.array_join(words, " "), F.lit(""))


def date_answer(value: Column, last: bool) -> Column:
    found = F.regexp_extract_all(value, F.lit(DATE), F.lit(0))
    return F.try_element_at(found, F.lit(-1 if last else 1))


def codes_answer(value: Column, pattern: str) -> Column:
    codes = F.transform(_words(value), lambda w: F.upper(_bare(w, r"()\[\]{}.,;: ")))
    return _joined(F.filter(codes, lambda c: c.rlike(pattern)))


def npi_answer(value: Column) -> Column:
    return F.when(F.length(digits(value)) == 10, digits(value)).otherwise(F.nullif(F.regexp_extract(value, r"\d{10}", 0), F.lit("")))


def phone_answer(value: Column) -> Column:
    plain = F.trim(F.regexp_replace(value, r"(?i)^(?:phone|fax|tel|ph)[:\s#]*", ""))
    shaped = canonical_phone(plain)
    return F.when(shaped.rlike(r"^\(\d{3}\) \d{3}-\d{4}$"), shaped)


def number_answer(value: Column) -> Column:
    """An authorization number: what follows a hash if it has digits; no phone, no prose; the first run of id-like words."""
    after = F.trim(F.regexp_extract(value, r"^[^#]*#(.*)$", 1))
    v = F.when(after.rlike(r"\d"), after).otherwise(value)
    d = digits(v)
    phone = v.rlike(PHONE) | v.rlike(TOLL_FREE) | ((F.length(d) == 11) & d.rlike("^1(800|866|877|888|855|844|833)"))
    parts = F.transform(_words(v), lambda w: _bare(w, r"()\[\]{}.,;:"))
    good = lambda p: p.rlike(r"\d") & p.rlike(r"^[A-Za-z0-9\-#]+$") & (F.length(p) >= 3)
    stop = F.array_position(F.transform(parts, lambda p: ~good(p)), True)
    lead = F.when(stop == 0, parts).otherwise(F.slice(parts, F.lit(1), (F.greatest(stop, F.lit(1)) - 1).cast("int")))
    return F.when((F.length(value) <= 35) & v.rlike(r"\d") & ~phone & (_count(v, PROSE) == 0), _joined(lead))


def member_answer(value: Column) -> Column:
    v = F.trim(F.regexp_replace(value, r"^[#:=\s]+", ""))
    ids = F.filter(F.transform(_words(v), lambda w: _bare(w, r"#:=()\[\]{}.,;")), lambda p: p.rlike(r"\d"))
    return F.when((F.length(v) <= 30) & (_count(v, MEMBER_REJECT) == 0) & (_count(v, PROSE) == 0), F.get(ids, 0))


def patient_answer(value: Column) -> Column:
    v = F.trim(F.regexp_replace(value, r"(?i)^(?:O|To|From|rom|Attn)[:\s]+", ""))
    for pattern in (r"^" + DATE + r"\s+", r"\s+" + DATE + r".*$", r"^\d{6,}\s+"):
        v = F.regexp_replace(v, pattern, "")
    v = F.trim(v)
    dated = v.rlike(r"(?i)^(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},?\s+\d{4}$")
    label = F.exists(F.split(v, r"[\s,]+"), lambda w: F.lower(F.regexp_replace(w, "[:,#]+$", "")).isin(*LABELS))
    return F.when((F.length(value) >= 2) & (F.length(v) >= 2) & ~dated & ~label & (_count(v, ORGANIZATIONS) == 0) & (_count(v, PROSE) < 2), v)


def provider_answer(value: Column) -> Column:
    v = F.trim(F.regexp_replace(value, r"(?i)^(?:O|To|From|rom|Attn)[:\s]+", ""))
    v = F.trim(F.regexp_replace(v, r"(?i)^(?:Company|Provider|Name|Facility)[:\s]+", ""))
    site = F.lower(v).endswith(".com") & (F.size(_words(v)) == 1)
    return F.when((F.length(value) >= 3) & F.length(v).between(3, 80) & (_count(v, PROVIDER_REJECT + PAYER_NAMES) == 0) & ~site, v)


def clean_answer(key: Column, value: Column) -> Column:
    """The cleaned answer of a field, null if it is none."""
    k, v = F.lower(key), F.trim(value)
    units = _joined(F.regexp_extract_all(v, F.lit(r"\d+"), F.lit(0)))
    out = (
        F.when(k.isin("patient_dob", "auth_effective_date", "next_review_date"), date_answer(v, False)).when(k == "auth_expiration_date", date_answer(v, True))
        .when(k.isin("service_code", "cpt_code", "hcpc_code"), codes_answer(v, r"^[A-Z]\d{3,4}$|^\d{5}$")).when(k.isin("provider_npi", "npi"), npi_answer(v))
        .when(k.isin("provider_phone", "provider_fax"), phone_answer(v)).when(k.isin("prior_auth_number", "reference_number"), number_answer(v)).when(k == "member_id", member_answer(v))
        .when(k == "patient_name", patient_answer(v)).when(k == "provider_name", provider_answer(v)).when(k == "diagnosis_code", codes_answer(v, r"^[A-Z]\d{2,4}(?:\.\d{0,2})?$"))
        .when(k == "units_requested", F.when((F.length(v) <= 25) & (_count(v, PROSE) == 0), units)).otherwise(F.when((F.length(v) <= 100) & (_count(v, PROSE) < 3), v))
    )
    return F.when(F.length(F.coalesce(v, F.lit(""))) > 0, out)


def dob_from_review(review: Column, as_of: Column, years: int = 18) -> Column:
    """A review date so long ago that it is a date of birth."""
    d = parsed(F.trim(review))
    return F.when(years_between(as_of, d) >= years, d)
