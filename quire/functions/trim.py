"""Values and tokens cut to what their field can hold (H21, H22), and values inside a label's own token.

Digits are those of ASCII. Null values stay null; a value that cannot be one is empty, a list of tokens that cannot be one
has none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What may stand before a value in its own text, by field.
LABEL_PREFIX = {
    "member_id": r"(?:member\s*(?:id|#|number|plan\s*id)|medicaid\s*id|subscriber\s*id|plan\s*id|id\s*#?|enrollee\s*id)\s*[:=\s]+",
    "patient_dob": r"(?:member\s*date\s*of\s*birth|date\s*of\s*birth|patient\s*(?:date\s*of\s*birth|dob)|dob|birth\s*date)\s*[:=\s]+",
    "patient_name": r"(?:member\s*name|patient\s*name|subscriber\s*name|patient|member|name)\s*[:=\s]+",
    "provider_name": r"(?:servicing\s*provider\s*(?:name)?|requesting\s*provider\s*(?:name)?|provider\s*(?:name)?|facility\s*(?:name)?|treating\s*provider)\s*[:=.,\s]+",
    "prior_auth_number": r"(?:authorization\s*(?:number|#|no\.?)|auth\s*(?:number|#|no\.?)|reference\s*(?:number|#)|prior\s*auth\s*(?:number|#)?)\s*[:=\s]+",
}
NAME_IS_LABEL = r"(?i)^(?:date\s*of\s*birth|dateofbirth|dob|member\s*(?:id|dob|name)|auth(?:orization)?|prior\s*auth|health\s*plan|provider|service\s*code|diagnosis|hcpc|npi)\b"
PROVIDER_IS_LABEL = r"(?i)^(?:servicing\s*provider\s*name|provider\s*name|requesting\s*provider|facility\s*name)[.:,\s]*$"
DATE = r"(?:\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\d{4}[/\-]\d{1,2}[/\-]\d{1,2})"
RANGE = rf"^{DATE}(?:[- ]*(?:to|through|-)\s*{DATE})?$"
BETWEEN = ("to", "-", "through", "thru")
PHONE = r"^[\d\(\)\-\.\s]{7,"
# Words that no value of the field has.
MEMBER_HAS_NOT = ("date span", "review", "next", "authorization", "span", "member", "phone", "provider", "enrollee", "plan id", "subscriber", "medicaid")
AUTH_HAS_NOT = ("verification", "eligibility", "contractual", "please", "https")
AUTH_TOKEN_HAS_NOT = ("member dob", "member name", "date of birth", "member number")
UNITS_HAVE_NOT = ("above", "return", "original", "documents", "address", "guidelines", "available", "benefits", "please", "verification")
NAME_WORD_IS_NOT = ("memberid", "member", "subscriber", "enrollee", "provider", "authorization", "phone", "fax")
NAME_PROSE = ("seriously", "risk", "health", "life", "explain", "approval", "denial", "sincerely", "department", "please", "contact", "regarding", "information", "services", "coverage", "benefits", "medical", "language", "people", "free", "provide", "address")
PROVIDER_HAS_NOT = ("sincerely", "seriously", "dear", "regards", "attention", "department", "yours truly", "location address", "service location", "risk your", "physical health", "coverage", "benefits", "eligibility", "please contact", "free language")

DATE_FIELDS = ("patient_dob", "auth_effective_date", "auth_expiration_date", "next_review_date")
AUTH_FIELDS, CODE_FIELDS, NPI_FIELDS = ("prior_auth_number", "reference_number"), ("service_code", "cpt_code", "hcpc_code"), ("provider_npi", "npi")
_DIGIT, _AROUND = "[0-9]", r"()\[\]{}.,;:"


def _bare(word: Column, around: str = _AROUND) -> Column:
    return F.regexp_replace(word, f"^[{around}]+|[{around}]+$", "")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+", -1), "")


def _leading(words: Column, ok) -> Column:
    """The words before the first one that is not ``ok``."""
    stop = F.array_position(F.transform(words, ok), F.lit(False))
    return F.slice(words, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(words)).cast("int"))


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


def _or_else(found: Column, value: Column) -> Column:
    return F.when(F.length(found) > 0, found).otherwise(value)


def _identifier(value: Column) -> Column:
    after = F.trim(F.regexp_extract(value, r"^[^#]*#(.*)$", 1))
    v = F.when(value.contains("#") & after.rlike(_DIGIT), after).otherwise(value)
    words = _words(v)
    ids = _leading(words, lambda w: _bare(w).rlike(_DIGIT) & _bare(w).rlike(r"^[A-Za-z0-9\-#]+$") & (F.length(_bare(w)) >= 3))
    return F.when(F.size(words) > 6, "").when(F.size(words) > 1, _or_else(F.array_join(ids, " "), v)).otherwise(v)


def _date(key: Column, value: Column) -> Column:
    dates = F.regexp_extract_all(value, F.lit(f"({DATE})"), F.lit(1))
    one = F.when(key.contains("expir"), F.try_element_at(dates, F.lit(-1))).otherwise(F.get(dates, 0))
    span = (key == "next_review_date") & value.rlike(r"(?i)date\s*span")
    return F.when(span, "").otherwise(F.coalesce(one, value))


def _member(value: Column) -> Column:
    bare = F.filter(F.transform(_words(value), lambda w: _bare(w, "#:=" + _AROUND)), lambda w: w.rlike(_DIGIT))
    return F.coalesce(F.get(bare, 0), F.get(_words(value), 0), value)


def _codes(value: Column) -> Column:
    """Codes from the first word on; H read as 11 before four digits is put right."""
    fixed = F.transform(_words(value), lambda w: F.when(_bare(w).rlike("^11[0-9]{4}$"), F.concat(F.lit("H"), F.substring(_bare(w), 3, 4))).otherwise(w))
    codes = _leading(fixed, lambda w: _bare(w).rlike(_DIGIT) & _bare(w).rlike(r"^[A-Za-z0-9.\-]{1,10}$"))
    return _or_else(F.array_join(codes, " "), value)


def _patient(value: Column) -> Column:
    name = value
    for around in (r"^\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\s+", r"\s+\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}.*$", r"^\d{6,}\s+", r"^\[+"):
        name = F.regexp_replace(name, around, "")
    name = F.trim(name)
    return F.when(name.rlike(NAME_IS_LABEL), "").otherwise(_or_else(name, value))


def _provider(value: Column) -> Column:
    name = F.trim(F.regexp_replace(value, "[:.]+$", ""))
    return F.when(name.rlike(PROVIDER_IS_LABEL), "").otherwise(name)


def without_label(key: Column, value: Column) -> Column:
    """``value`` without the label of its field before it; empty if there is nothing else."""
    out = value
    for field, label in LABEL_PREFIX.items():
        out = F.when(key == field, F.trim(F.regexp_replace(value, "(?i)^" + label, ""))).otherwise(out)
    return out


def trimmed(key: Column, value: Column) -> Column:
    """``value`` cut to what its field can hold."""
    k = F.lower(key)
    v = without_label(k, value)
    return (
        F.when(k.isin(*AUTH_FIELDS), _identifier(v)).when(k.contains("date") | (k == "patient_dob"), _date(k, v)).when(k == "member_id", _member(v))
        .when(k.isin(*CODE_FIELDS), _codes(v)).when(k.isin(*NPI_FIELDS), _or_else(F.regexp_extract(v, r"\d{10}", 0), v))
        .when(k == "patient_name", _patient(v)).when(k == "provider_name", _provider(v)).otherwise(v)
    )


def _text(token: Column) -> Column:
    return F.trim(token["text"])


def _dates_only(tokens: Column) -> Column:
    """Dates and what joins them; of a token that holds dates among other things only the first two."""

    def one(t: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(_text(t), ",+$", ""), ":+$", "")
        dates = F.regexp_extract_all(text, F.lit(f"({DATE})"), F.lit(1))
        gap = F.trim(F.regexp_extract(text, f"{DATE}(.*?){DATE}", 1))
        both = F.concat(F.get(dates, 0), F.when(gap.isin("-", "to", "through", "thru"), gap).otherwise("-"), F.get(dates, 1))
        inner = t.withField("text", F.when(F.size(dates) > 1, both).otherwise(F.get(dates, 0)))
        return F.when(text.rlike(RANGE) | F.lower(text).isin(*BETWEEN), t).when(F.size(dates) > 0, inner)

    return F.filter(F.transform(tokens, one), lambda t: t.isNotNull())


def _first_phone(tokens: Column) -> Column:
    phones = F.filter(tokens, lambda t: _text(t).rlike(PHONE + "}"))
    cut = lambda t: F.when(F.length(_text(t)) > 16, t.withField("text", F.trim(F.regexp_extract(_text(t), PHONE + "15}", 0)))).otherwise(t)
    return F.transform(F.slice(phones, 1, 1), cut)


def filtered(field: str, tokens: Column) -> Column:
    """The tokens (an array with ``text``) that can be part of a value of ``field``; all or none where the whole decides."""
    none = F.slice(tokens, 1, 0)
    joined = lambda ts: F.array_join(F.transform(ts, _text), " ")
    whole = joined(tokens)
    keep = lambda bad: F.when(bad, none).otherwise(tokens)
    if field in DATE_FIELDS:
        return _dates_only(tokens)
    if field == "member_id":
        rest = F.filter(tokens, lambda t: ~_text(t).rlike(RANGE))
        text = joined(rest)
        return F.when(F.length(text).between(4, 30) & text.rlike(_DIGIT) & ~_has(text, MEMBER_HAS_NOT), rest).otherwise(none)
    if field == "provider_npi":
        return F.filter(tokens, lambda t: _text(t).rlike(r"^\d{10}$"))
    if field == "prior_auth_number":
        return keep((F.length(whole) > 30) | _has(whole, AUTH_HAS_NOT) | F.exists(tokens, lambda t: _has(t["text"], AUTH_TOKEN_HAS_NOT)))
    if field == "units_requested":
        return keep((F.length(whole) > 25) | ~whole.rlike(_DIGIT) | _has(whole, UNITS_HAVE_NOT))
    if field == "diagnosis_code":
        return F.filter(tokens, lambda t: _text(t).rlike(r"^[A-Z]\d"))
    if field == "service_code":
        return F.filter(tokens, lambda t: F.exists(_words(_text(t)), lambda w: _bare(w).rlike(r"^[A-Z0-9.]{3,7}$") & _bare(w).rlike(_DIGIT)))
    if field == "patient_name":
        parts = F.array_remove(F.split(whole, r"[\s,]+", -1), "")
        label = F.exists(parts, lambda w: F.regexp_replace(F.lower(w), "[:,#]+$", "").isin(*NAME_WORD_IS_NOT))
        prose = F.size(F.filter(F.array(*map(F.lit, NAME_PROSE)), lambda w: F.contains(F.lower(whole), w))) >= 2
        letters = F.aggregate(parts, F.lit(0), lambda n, w: n + F.length(w))
        return keep((F.size(parts) < 1) | (F.length(whole) < 2) | label | prose | ((F.size(parts) > 3) & (letters > 8 * F.size(parts))))
    if field == "provider_name":
        return keep((F.size(_words(whole)) < 2) | _has(whole, PROVIDER_HAS_NOT))
    if field in ("provider_phone", "provider_fax"):
        return _first_phone(tokens)
    return tokens


def filtered_by(key: Column, tokens: Column) -> Column:
    """``filtered`` where the field is a column."""
    out = tokens
    for field in (*DATE_FIELDS, "member_id", "provider_npi", "prior_auth_number", "units_requested", "diagnosis_code", "service_code", "patient_name", "provider_name", "provider_phone", "provider_fax"):
        out = F.when(key == field, filtered(field, tokens)).otherwise(out)
    return out


def after_label(token: Column, label: str) -> Column:
    """What follows a label that runs into its value ('DOB11/2/80'), also with o and l read as digits; null if no value does."""
    fold = lambda c: F.translate(F.lower(c), "01", "ol")
    clean, text = label.rstrip(":").rstrip("#").strip(), F.trim(token)
    found = []
    for at in (F.locate(clean.lower(), F.lower(text)), F.instr(fold(text), F.lit(clean.lower().translate(str.maketrans("01", "ol"))))):
        rest = F.trim(F.substring(text, at + len(clean), F.length(text)))
        found.append(F.when((at > 0) & rest.rlike(r"^[0-9/(\-]"), rest))
    return F.coalesce(*found)
