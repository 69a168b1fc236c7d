"""From scored fields to a decision: who the payer is, why a person should look, and whether one must."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import rules as R
from quire.functions import validators as V

#: A template match of this score is trusted, so template and model need not agree.
TRUSTED_TEMPLATE = 0.85
UNKNOWN = "UNKNOWN"


def payer_of(hint: Column, keyword: Column, template: Column) -> Column:
    """A template match names the payer; else the hint, if it is a known one; else what keywords say."""
    known = lambda c: F.when(c != UNKNOWN, c)
    return F.coalesce(template, known(hint), known(keyword), F.lit(UNKNOWN))


def review_reasons(fields: DataFrame, jobs: DataFrame) -> DataFrame:
    """Up to eight ``reasons`` a job, in their order.

    ``fields``: job_id, field_key, place (order within the job), w (weighted confidence), critical, sources, agree.
    ``jobs``: job_id, overall, missing_critical, failures, penalty (of its own pages).
    """
    low = F.when(F.col("w") < 0.70, F.struct("place", F.concat(F.lit("LOW_CONF_"), F.upper("field_key")).alias("reason")))
    of = fields.groupBy("job_id").agg(
        F.max((F.col("sources") > 1) & ~F.col("agree") & F.col("critical")).alias("conflict"),
        F.transform(F.array_sort(F.collect_list(low)), lambda x: x["reason"]).alias("low"),
    )
    j = jobs.join(of, "job_id", "left")
    named = F.array(
        F.when(F.col("overall") < 0.70, "LOW_CONFIDENCE"), F.when(F.col("missing_critical") > 0, "MISSING_CRITICAL_FIELDS"), F.when(F.col("failures") > 0, "VALIDATION_FAILED"),
        F.when(F.col("penalty") > 0.05, "LOW_OCR_QUALITY"), F.when(F.col("conflict"), "SOURCE_CONFLICT"),
    )
    every = F.concat(F.array_compact(named), F.coalesce("low", F.array().cast("array<string>")))
    return j.select(*jobs.columns, F.slice(every, 1, 8).alias("reasons"))


def needs_review(fields: DataFrame, jobs: DataFrame, thresholds: DataFrame, disagreements: DataFrame, finalize: float = 0.90) -> DataFrame:
    """``jobs`` with ``needs_review``, from its score, its critical fields and what template and model disagree on.

    ``fields`` as for ``review_reasons`` with ``failed``; ``thresholds``: payer, field_key, least; ``jobs`` with payer and
    template_score; ``disagreements``: job_id, field_key. A critical field fails below its payer's threshold, at most
    0.65, or below 0.50 where the payer is unknown; a payer without a threshold of its own has 0.70.
    """
    payers = jobs.select("job_id", "payer")
    f = fields.where("critical").join(payers, "job_id").join(thresholds, ["payer", "field_key"], "left")
    least = F.when(F.col("payer") == UNKNOWN, 0.50).otherwise(F.least(F.coalesce("least", F.lit(0.70)), F.lit(0.65)))
    bad = f.groupBy("job_id").agg(F.max((F.col("failed") & (F.col("w") < 0.85)) | (F.col("w") < least)).alias("bad"))
    apart = disagreements.groupBy("job_id").agg(F.count("*").alias("apart"))
    j = jobs.join(bad, "job_id", "left").join(apart, "job_id", "left")
    disagree = (F.coalesce("apart", F.lit(0)) > 0) & (F.coalesce("template_score", F.lit(0.0)) < TRUSTED_TEMPLATE)
    needs = (F.col("overall") < finalize) | (F.col("missing_critical") > 0) | F.coalesce("bad", F.lit(False)) | disagree
    return j.select(*jobs.columns, needs.alias("needs_review"))


def final_route(jobs: DataFrame, min_flags: int = 1) -> DataFrame:
    """``jobs`` with the last word on ``needs_review``, ``reasons`` that it adds, and ``status``.

    Asks in this order: the score (``needs_review``), fields that contradict each other (``consistent``), an unknown payer,
    an unknown document type, and, only if nothing has spoken so far, the number of flagged fields (``n_flags``).
    """
    cross, payer, kind = ~F.col("consistent"), F.col("payer") == UNKNOWN, F.col("doc_type") == UNKNOWN
    before = F.col("needs_review") | cross | payer | kind
    flagged = ~before & (F.col("n_flags") >= min_flags) & (F.col("n_flags") > 0)
    more = F.array_compact(F.array(F.when(cross, "CROSS_FIELD_INCONSISTENCY"), F.when(payer, "UNKNOWN_PAYER"), F.when(kind, "UNKNOWN_DOC_TYPE"), F.when(flagged, "HITL_LOW_CONFIDENCE_FIELDS")))
    out = jobs.withColumns({"needs_review": before | flagged, "reasons": F.concat("reasons", more)})
    return out.withColumn("status", F.when(F.col("needs_review"), "NEEDS_REVIEW").otherwise("COMPLETED"))


# The forms of codes, and the fields that hold dates.
DIAGNOSIS, PROCEDURE = r"(?i)^[A-Z]\d{2}(\.\d{1,4})?$", r"(?i)^(\d{5}|[A-Z]\d{4})$"


def cross_field(wide: DataFrame, as_of: Column) -> DataFrame:
    """The nine checks of a job's fields against each other: ``errors``, ``warnings``, and ``consistent`` if there is no error.

    ``wide``: job_id and a column for each field; absent ones are null. Blank values count as absent.
    """
    of = lambda k: F.nullif(F.col(k), F.lit("")) if k in wide.columns else F.lit(None).cast("string")
    plain = lambda k: F.regexp_replace(of(k), r"\D", "")
    same = lambda a, b, least=0: F.coalesce((plain(a) == plain(b)) & (F.length(plain(a)) >= least), F.lit(False))
    order, decision = V.date_order(of("auth_effective_date"), of("auth_expiration_date")), F.upper(F.trim(of("decision")))
    bad = lambda k, form: F.coalesce(F.size(V.bad_codes(of(k), form)) > 0, F.lit(False))
    dates = F.filter(F.array(*(plain(k) for k in R.DATE_FIELDS)), lambda d: d != "")
    thrice = F.exists(F.array_distinct(dates), lambda d: F.size(F.filter(dates, lambda x: x == d)) >= 3)
    errors = F.array(
        F.when(order == "ERROR", "EXPIRES_BEFORE_EFFECTIVE"), F.when(V.dob_in_past(of("patient_dob"), as_of) == "ERROR", "DOB_NOT_IN_PAST"),
        F.when(same("units_requested", "member_id", 6), "UNITS_ARE_MEMBER_ID"), F.when(same("next_review_date", "patient_dob"), "REVIEW_IS_DOB"),
    )
    warnings = F.array(
        F.when(order == "WARNING", "EXPIRES_WHEN_EFFECTIVE"),
        F.when((decision == "DENIED") & of("denial_reason").isNull(), "DENIED_WITHOUT_REASON").when((decision == "APPROVED") & of("units_approved").isNull(), "APPROVED_WITHOUT_UNITS"),
        F.when(bad("diagnosis_codes", DIAGNOSIS), "DIAGNOSIS_CODE"), F.when(bad("procedure_codes", PROCEDURE), "PROCEDURE_CODE"),
        F.when(thrice, "DATES_ALIKE"), F.when(V.prose(of("prior_auth_number")), "AUTH_IS_PROSE"),
    )
    out = wide.select("job_id", F.array_compact(errors).alias("errors"), F.array_compact(warnings).alias("warnings"))
    return out.withColumn("consistent", F.size("errors") == 0)
