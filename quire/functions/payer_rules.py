"""A payer's own rules for its fields, as the rules file states them: validation (H15) and canonical forms (H9).

``rules`` maps a payer to its ``field_validations`` and ``canonicalization``, both by field key, as read from the file. They
become one CASE over payer and key, so no join and no lookup per row is needed; a file has some ten payers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import strip

Rules = Mapping[str, Mapping[str, Mapping[str, Mapping]]]
#: The parts of a date format that mean something; all else stands for itself, a two-digit year too.
PARTS = {"YYYY": r"(\d{4})", "MM": r"(\d{1,2})", "DD": r"(\d{1,2})"}


def by_format(value: Column, form: str) -> Column:
    """The date that a whole value is in a format of YYYY, MM and DD, null if it is none."""
    order = sorted((p for p in PARTS if p in form), key=form.index)
    if len(order) < 3:
        return F.lit(None).cast("date")
    pattern = "".join("\\" + c if not c.isalnum() else c for c in form)
    for part, group in PARTS.items():
        pattern = pattern.replace(part, group)
    number = {p: F.regexp_extract(value, f"^{pattern}$", i + 1).try_cast("int") for i, p in enumerate(order)}
    return F.try_to_date(F.format_string("%04d-%02d-%02d", number["YYYY"], number["MM"], number["DD"]), "yyyy-MM-dd")


def in_format(day: Column, form: str) -> Column:
    return F.date_format(day, form.replace("YYYY", "yyyy").replace("DD", "dd"))


def _one_field(value: Column, rule: Mapping, effective: Column, as_of: Column) -> Column:
    found, form = [], rule.get("format")
    if rule.get("regex"):
        found.append(F.when(~value.rlike("^(?:" + rule["regex"] + ")"), "PATTERN"))
    if rule.get("min_length"):
        found.append(F.when(F.length(value) < rule["min_length"], "TOO_SHORT"))
    if rule.get("max_length"):
        found.append(F.when(F.length(value) > rule["max_length"], "TOO_LONG"))
    if rule.get("validate_not_future") and form:
        found.append(F.when(by_format(value, form) > as_of, "IN_FUTURE"))
    if rule.get("validate_after_effective") and form:
        found.append(F.when(by_format(value, form) <= by_format(effective, form), "NOT_AFTER_EFFECTIVE"))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def rule_errors(payer: Column, key: Column, value: Column, effective: Column, as_of: Column, rules: Rules) -> Column:
    """Error codes of a value by its payer's rules, in their order; none where there is no rule. A null value has none."""
    none = F.array().cast("array<string>")
    out = none
    for p, of in sorted(rules.items()):
        for k, rule in sorted(of.get("field_validations", {}).items()):
            out = F.when((payer == p) & (key == k), _one_field(value, rule, effective, as_of)).otherwise(out)
    return F.when(value.isNull(), none).otherwise(out)


def _one_form(value: Column, rule: Mapping) -> Column:
    out = strip(value) if rule.get("trim", True) else value
    out = F.upper(out) if rule.get("uppercase") else out
    out = F.lower(out) if rule.get("lowercase") else out
    for flag, pattern in (("remove_spaces", " "), ("remove_dashes", "-"), ("remove_special", "[^a-zA-Z0-9]")):
        out = F.regexp_replace(out, pattern, "") if rule.get(flag) else out
    if rule.get("standard_format") and rule.get("accept_formats"):
        days = F.coalesce(*(by_format(out, f) for f in rule["accept_formats"]))
        out = F.coalesce(in_format(days, rule["standard_format"]), out)
    return out


def rule_canonical(payer: Column, key: Column, value: Column, rules: Rules) -> Column:
    """The canonical form of a value by its payer's rule for the key, else, for keys in _date, by its rule for dates, else stripped."""
    out = strip(value)
    for p, of in sorted(rules.items()):
        forms = of.get("canonicalization", {})
        if "dates" in forms:
            out = F.when((payer == p) & key.endswith("_date"), _one_form(value, forms["dates"])).otherwise(out)
        for k, rule in sorted(forms.items()):
            out = F.when((payer == p) & (key == k), _one_form(value, rule)).otherwise(out)
    return out
