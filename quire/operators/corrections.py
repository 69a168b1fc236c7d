"""Ordered corrections of merged fields (I5), on one row per job: each rule sees what the rules before it left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import digits

KEYS = ("member_id", "patient_dob", "auth_effective_date", "auth_expiration_date", "next_review_date", "units_requested", "patient_name", "provider_name")
_FIELD = "struct<value:string,confidence:double,method:string>"


def _value(key: str) -> Column:
    return F.coalesce(F.col(f"{key}.value"), F.lit(""))


def _clear(df: DataFrame, when: Column, *keys: str) -> DataFrame:
    hit = F.coalesce(when, F.lit(False))
    return df.withColumn("_hit", hit).withColumns({k: F.when(~F.col("_hit"), F.col(k)) for k in keys}).drop("_hit")


def _same(a: str, b: str) -> Column:
    return (_value(a) != "") & (_value(b) != "") & (digits(_value(a)) == digits(_value(b)))


def name_words(value: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.regexp_replace(F.lower(value), "[^a-z]", " "), r"\s+", -1), ""))


def corrected(fields: DataFrame, alternatives: DataFrame, verified: DataFrame) -> DataFrame:
    """``fields`` (job_id, field_key, value, confidence, method) after eight rules in their order.

    ``alternatives``: all candidates of a field with ``ord``, to recover a value from. ``verified``: job_id of jobs whose
    template is verified. Fields outside ``KEYS`` pass unchanged.
    """
    # Aggregates of structs are sorted before they are sent; rows are sent first, so that an even part is sorted, not a whole file.
    parts = int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_job = lambda df: df.repartition(parts, "job_id")
    item = F.struct("value", "confidence", "method")
    wide = by_job(fields.where(F.col("field_key").isin(*KEYS))).groupBy("job_id").agg(*(F.max(F.when(F.col("field_key") == k, item)).cast(_FIELD).alias(k) for k in KEYS))
    choice = F.struct("ord", "value", "confidence", "method")
    alt = by_job(alternatives.where(F.col("value") != "")).groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("field_key") == "auth_expiration_date", choice))).alias("_exp"),
        F.min(F.when((F.col("field_key") == "patient_name") & (F.col("method") == "TEMPLATE_OCR"), choice)).alias("_name"),
    )
    w = wide.join(alt, "job_id", "left").join(by_job(verified.select("job_id")).withColumn("_ok", F.lit(True)), "job_id", "left")
    plain = lambda k: F.replace(_value(k), F.lit(" "), F.lit(""))
    # Units that repeat the member id; a review date that repeats the date of birth.
    w = _clear(w, (_value("member_id") != "") & (plain("units_requested") == plain("member_id")) & (F.length(plain("units_requested")) >= 6), "units_requested")
    w = _clear(w, (_value("patient_dob") != "") & F.col("next_review_date").isNotNull() & (digits(_value("next_review_date")) == digits(_value("patient_dob"))), "next_review_date")
    # Both dates of an authorization from a model, equal to each other and to a third date.
    model = lambda k: ~F.coalesce(F.col(f"{k}.method"), F.lit("")).isin("TEMPLATE_OCR", "HYBRID")
    equal = (_value("auth_effective_date") != "") & (_value("auth_effective_date") == _value("auth_expiration_date"))
    w = _clear(w, equal & model("auth_effective_date") & model("auth_expiration_date") & (_same("auth_effective_date", "patient_dob") | _same("auth_effective_date", "next_review_date")), "auth_effective_date", "auth_expiration_date")
    # An expiration that is the date of birth gives way to the first candidate that is not, or goes; an effective date goes.
    other = F.get(F.filter("_exp", lambda x: digits(x["value"]) != digits(_value("patient_dob"))), 0)
    recovered = F.when(other.isNotNull(), F.struct(other["value"].alias("value"), F.coalesce(F.nullif(other["confidence"], F.lit(0.0)), F.lit(0.70)).alias("confidence"), other["method"].alias("method")))
    w = w.withColumn("auth_expiration_date", F.when(_same("auth_expiration_date", "patient_dob"), recovered).otherwise(F.col("auth_expiration_date")))
    w = _clear(w, _same("auth_effective_date", "patient_dob"), "auth_effective_date")
    # No adult is born after 2015; units are a number from 1 to 9999.
    w = _clear(w, F.regexp_extract(_value("patient_dob"), r"\b(20\d{2}|19\d{2}|18\d{2})\b", 1).try_cast("int") > 2015, "patient_dob")
    units = F.trim(_value("units_requested"))
    w = _clear(w, ~(units.rlike(r"^\d{1,4}$") & F.coalesce(units.try_cast("int") >= 1, F.lit(False))), "units_requested")
    # A patient's name inside the provider's is the provider's, unless a template has it; a verified template beats a model.
    inside = (F.size(name_words(_value("patient_name"))) > 0) & (F.size(F.array_except(name_words(_value("patient_name")), name_words(_value("provider_name")))) == 0)
    w = _clear(w, inside & (F.col("patient_name.method") != "TEMPLATE_OCR"), "patient_name")
    better = F.col("_ok") & (F.col("patient_name.method") == "LAYOUTLM") & F.col("_name").isNotNull()
    named = F.struct(F.col("_name.value").alias("value"), F.coalesce(F.nullif(F.col("_name.confidence"), F.lit(0.0)), F.lit(0.75)).alias("confidence"), F.lit("TEMPLATE_OCR").alias("method"))
    w = w.withColumn("patient_name", F.when(F.coalesce(better, F.lit(False)), named).otherwise(F.col("patient_name")))
    long = w.select("job_id", F.explode(F.array(*(F.struct(F.lit(k).alias("field_key"), F.col(k).alias("f")) for k in KEYS))).alias("x")).where("x.f IS NOT NULL")
    rest = fields.where(~F.col("field_key").isin(*KEYS)).select("job_id", "field_key", "value", "confidence", "method")
    return long.select("job_id", "x.field_key", "x.f.value", "x.f.confidence", "x.f.method").unionByName(rest)


def anchor_verdict(anchors: DataFrame, near: float = 0.20, least: float = 0.25, sure: float = 0.85) -> DataFrame:
    """Per job whether its template applies. ``anchors``: job_id, match_score, payer_match, label_score, cx, cy, roi_cx, roi_cy, a row per labelled field."""
    apart = F.sqrt(F.pow(F.col("cx") - F.col("roi_cx"), 2) + F.pow(F.col("cy") - F.col("roi_cy"), 2))
    found = F.coalesce((F.col("label_score") >= 0.5) & (apart < near), F.lit(False))
    g = anchors.groupBy("job_id").agg(F.max("match_score").alias("m"), F.min("payer_match").alias("payer"), F.count_if(found).alias("found"), F.count("*").alias("total"))
    bypass = (F.col("m") >= sure) & F.col("payer")
    score = F.when(bypass, 1.0).otherwise(F.round(F.col("found") / F.col("total"), 4))
    return g.select("job_id", score.alias("anchor_score"), (bypass | (F.col("payer") & (F.col("found") / F.col("total") >= least))).alias("verified"))


def extraction_confidence(mean: Column, anchored: Column, apart: Column) -> Column:
    near = F.when(apart < 0.10, 0.05).when(apart > 0.30, -0.10).otherwise(0.0)
    return F.greatest(F.lit(0.30), F.least(F.lit(1.0), mean + F.when(anchored, 0.05).otherwise(0.0) + near))


def label_confidence(mean: Column) -> Column:
    return F.greatest(F.lit(0.40), mean - 0.10)


def blended(model: Column, alignment: Column) -> Column:
    return F.greatest(F.lit(0.10), F.least(F.lit(0.98), model * 0.60 + alignment * 0.40))


def best_answers(answers: DataFrame, least: float = 0.01) -> DataFrame:
    """Per field and answer, whatever its case, the highest score; the spelling that has it, or sorts first of equals."""
    kept = answers.where(F.col("score") >= least)
    g = kept.groupBy("field_key", F.lower("answer").alias("_a")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "answer")).alias("b"))
    return g.select("field_key", F.col("b.answer").alias("answer"), (-F.col("b.minus")).alias("score"))


def suggested_roi(matched: DataFrame, margin: float = 0.01) -> DataFrame:
    """Per page the box around matched tokens, a little larger, within the page."""
    g = matched.groupBy("page_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("confidence").alias("confidence"))
    low, high = (lambda c: F.greatest(F.col(c) - margin, F.lit(0.0))), (lambda c: F.least(F.col(c) + margin, F.lit(1.0)))
    return g.select("page_id", low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1"), F.round("confidence", 6).alias("confidence"))
