"""Candidates to fields to scores to routing (I1-I14, E5, G1, G5, H25). Candidates: job_id, field_key, ord, value, method, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire import rules as R
from quire.functions.text import digits, is_blank_strict, is_blank_trim
from quire.operators.state import last_of_each

MESSAGE_NUMBER = r"^\d{7,}-\d{3}-\d+$"


def contamination_penalty(key: Column, value: Column) -> Column:
    """0 to 0.50: how much a template value looks like a label or prose and not like a value of its field."""
    k, v = F.lower(key), F.trim(value)
    words = F.array_remove(F.split(value, r"\s+", -1), "")
    n = F.size(words)
    most = F.lit(None).cast("int")
    for name, m in R.MOST_WORDS.items():
        most = F.when(k == name, m).otherwise(most)
    units = F.when(F.length(digits(value)) >= 6, 0.50).when(v.rlike(r"(?i)^\d{1,3}(\s*(visit|unit|day|session)s?)?$") | v.rlike(r"^\d+$"), 0.0).otherwise(0.25)
    stops = F.size(F.filter(words, lambda w: F.lower(F.regexp_replace(w, "[.,;:]+$", "")).isin(*R.STOP_WORDS)))
    label = F.lower(F.regexp_replace(F.get(words, 0), "[:.,]+$", "")).isin(*R.LABEL_WORDS) & (n >= 2) & value.rlike("[:=]")
    return (
        F.when(is_blank_strict(value), 0.25).when(k == "units_requested", units).when(k.isin("prior_auth_number", "member_id") & v.rlike(MESSAGE_NUMBER), 0.45)
        .when(n > most, F.least(F.lit(0.40), 0.10 * (n - most))).when((n >= 4) & (stops >= 2), F.least(F.lit(0.40), 0.10 * stops)).when(label, 0.20).when(v.isin("", ".", ":", "-"), 0.25).otherwise(0.0)
    )


def prescreen(candidates: DataFrame) -> DataFrame:
    """Model candidates that are plainly wrong get a confidence of 0.10: one date for three date fields, an id as units, a message number."""
    model = F.col("method").isin(*R.MODEL_METHODS) & ~is_blank_strict(F.col("value"))
    v = F.trim("value")
    dated = candidates.where(model & F.col("field_key").isin(*R.DATE_FIELDS)).groupBy("job_id", v.alias("_v")).agg(F.count("*").alias("n")).where(F.col("n") >= 3).select(F.col("job_id").alias("_job"), "_v", F.lit(True).alias("_confused"))
    met = candidates.join(dated, (F.col("job_id") == F.col("_job")) & (v == F.col("_v")), "left")
    wrong = (
        (F.col("field_key").isin(*R.DATE_FIELDS) & F.coalesce("_confused", F.lit(False)))
        | ((F.col("field_key") == "units_requested") & ((F.length(digits(v)) >= 6) | v.rlike(r"\b20[12]\d\b")))
        | (F.col("field_key").isin("prior_auth_number", "member_id") & v.rlike(MESSAGE_NUMBER))
    )
    return met.withColumn("confidence", F.when(model & wrong, 0.10).otherwise(F.col("confidence"))).drop("_job", "_v", "_confused")


def scored(candidates: DataFrame, multiplier: float = 0.70) -> DataFrame:
    """``score``: the confidence, more for a clean template value or a model, more if sources agree, less if they don't."""
    key = F.lower(F.trim(F.coalesce("value", F.lit(""))))
    c = candidates.withColumn("_key", key)
    group = Window.partitionBy("job_id", "field_key")
    n, agree = F.count("*").over(group), F.count("*").over(Window.partitionBy("job_id", "field_key", "_key"))
    penalty = contamination_penalty(F.col("field_key"), F.col("value"))
    own = F.when(F.col("method") == "TEMPLATE_OCR", F.when(penalty == 0, F.lit(0.10)).otherwise(-penalty)).when(F.col("method").isin(*R.MODEL_METHODS), F.lit(0.10 * multiplier)).otherwise(F.lit(0.0))
    together = F.when(agree > 1, F.least(0.20 * (agree - 1), F.lit(0.40))).when(n > 1, F.lit(-0.10)).otherwise(F.lit(0.0))
    return c.withColumns({"score": F.round(F.col("confidence") + own + together, 6), "n_candidates": n}).drop("_key")


def built(candidates: DataFrame) -> DataFrame:
    """One row per job and field: the candidate with the highest score, the first of equals; HYBRID if it had rivals."""
    s = scored(candidates)
    best = s.groupBy("job_id", "field_key").agg(F.min(F.struct((-F.col("score")).alias("minus"), "ord", "value", "method", "n_candidates")).alias("b"))
    confidence = F.greatest(F.least(-F.col("b.minus"), F.lit(1.0)), F.lit(0.0))
    absent = (confidence < 0.30) | is_blank_trim(F.col("b.value"))
    return best.select(
        "job_id", "field_key", F.when(~absent, F.col("b.value")).alias("value"), F.round(confidence, 6).alias("confidence"),
        F.when(absent, "NOT_PRESENT").when(F.col("b.n_candidates") > 1, "HYBRID").otherwise(F.col("b.method")).alias("method"), F.col("b.n_candidates").cast("long").alias("n_candidates"),
    )


def with_decision(fields: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds a decision (job_id, decision, doc_conf) to jobs that have no candidate for it."""
    missing = decisions.join(fields.where("field_key = 'decision'").select("job_id"), "job_id", "left_anti")
    return fields.unionByName(missing.select("job_id", F.lit("decision").alias("field_key"), F.col("decision").alias("value"), F.greatest(F.lit(0.80), "doc_conf").alias("confidence"), F.lit("CLASSIFIER").alias("method"), F.lit(1).cast("long").alias("n_candidates")))


def quality_penalty(blur: Column, density: Column, confidence: Column) -> Column:
    """Up to 0.08 for a blurred, sparse or uncertain page."""
    parts = (
        F.when(blur < 100, (1 - blur / 100) * 0.04).otherwise(0.0) + F.when(density < 0.02, 0.024).otherwise(0.0)
        + F.when(confidence < 0.80, F.least(0.5 * (0.80 - confidence), F.lit(0.04))).otherwise(0.0)
    )
    return F.least(parts, F.lit(0.08))


def overall(fields: DataFrame, values: DataFrame, validation: DataFrame, penalty: float = 0.0, critical: tuple[str, ...] = R.SCORER_CRITICAL) -> DataFrame:
    """One row per job: the weighted confidence, missing critical fields, and reasons to look at it.

    ``values``: job_id, field_key, n (candidates), different (distinct non-blank values). ``validation``: job_id, field_key, passed.
    """
    f = fields.join(values, ["job_id", "field_key"], "left").join(validation, ["job_id", "field_key"], "left")
    is_critical = F.col("field_key").isin(*critical)
    failed = F.coalesce(~F.col("passed"), F.lit(False))
    agree = (F.col("n") >= 2) & (F.col("different") <= 1)
    weighted = F.col("confidence") - F.when(failed, 0.05).otherwise(0.0) + F.when(agree, 0.10).otherwise(0.0)
    weighted = F.round(F.greatest(F.least(weighted, F.lit(1.0)), F.lit(0.0)), 6)
    weight = F.when(is_critical, 2.0).otherwise(1.0)
    f = f.select("job_id", "field_key", weighted.alias("w"), weight.alias("weight"), is_critical.alias("critical"), failed.alias("failed"), is_blank_strict(F.col("value")).alias("blank"))
    seen = lambda c: F.when(~F.col("blank"), c)
    jobs = f.groupBy("job_id").agg(
        F.sum(seen(F.round(F.col("w") * 1e6).cast("long") * F.col("weight").cast("long"))).alias("sum_w"), F.sum(seen(F.col("weight"))).alias("sum_weight"), F.count_if(~F.col("blank") & F.col("critical")).alias("have"),
        F.max(seen(F.col("critical") & F.col("failed") & (F.col("w") < 0.85))).alias("bad_critical"), F.max(seen(F.col("critical") & (F.col("w") < 0.50))).alias("low_critical"), F.max(seen(F.col("failed"))).alias("any_failed"),
    )
    missing = F.lit(len(critical)) - F.coalesce("have", F.lit(0))
    score = F.coalesce(F.try_divide(F.col("sum_w"), F.col("sum_weight")) / 1e6, F.lit(0.0)) - 0.05 * missing - penalty + 1e-9  # ties round up
    return jobs.select(
        "job_id", F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 4).alias("overall"), missing.alias("missing_critical"),
        F.coalesce("bad_critical", F.lit(False)).alias("bad_critical"), F.coalesce("low_critical", F.lit(False)).alias("low_critical"), F.coalesce("any_failed", F.lit(False)).alias("any_failed"),
    )


def routed(scores: DataFrame, threshold: float = 0.70, penalty: float = 0.0) -> DataFrame:
    """``needs_review`` and up to eight ``reasons``, in their order."""
    needs = (F.col("overall") < threshold) | (F.col("missing_critical") > 0) | F.col("bad_critical") | F.col("low_critical")
    reasons = F.array_compact(F.array(
        F.when(F.col("overall") < 0.70, "LOW_CONFIDENCE"), F.when(F.col("missing_critical") > 0, "MISSING_CRITICAL_FIELDS"), F.when(F.col("any_failed"), "VALIDATION_FAILED"), F.when(F.lit(penalty) > 0.05, "LOW_OCR_QUALITY"), F.when(F.col("low_critical"), "LOW_CONF_CRITICAL"),
    ))
    return scores.withColumns({"needs_review": needs, "reasons": F.slice(reasons, 1, 8)})


def review_flags(fields: DataFrame) -> DataFrame:
    """Fields for a person to look at, critical ones first, then the least certain: one row each with its ``place``."""
    critical = F.col("field_key").isin(*R.REVIEW_CRITICAL)
    limit = F.when(critical, 0.85).otherwise(0.75)
    blank = is_blank_trim(F.col("value"))
    f = fields.where((F.col("method") != "HUMAN_REVIEW") & (blank | (F.col("confidence") < limit)))
    f = f.select("job_id", "field_key", F.when(blank, "MISSING_VALUE").otherwise("LOW_CONFIDENCE").alias("reason"), limit.alias("threshold"), "confidence", critical.alias("critical"))
    w = Window.partitionBy("job_id").orderBy(F.col("critical").desc(), F.coalesce("confidence", F.lit(-1.0)), "field_key")
    return f.withColumn("place", F.row_number().over(w))


def apply_corrections(fields: DataFrame, corrections: DataFrame, *order: str) -> DataFrame:
    """Corrected values replace the fields' own with full confidence; a value that changed is kept as ``previous``.

    Of several corrections of a field the last by ``order`` (columns of ``corrections``) holds.
    """
    c = last_of_each(corrections.select("job_id", "field_key", "corrected_value", *order), ["job_id", "field_key"], *order).select("job_id", "field_key", F.col("corrected_value").alias("_new"))
    met = fields.join(c, ["job_id", "field_key"], "left")
    hit = F.col("_new").isNotNull()
    return met.select(
        "job_id", "field_key", F.coalesce("_new", "value").alias("value"), F.when(hit, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, "HUMAN_REVIEW").otherwise(F.col("method")).alias("method"), F.when(hit & ~F.col("value").eqNullSafe(F.col("_new")), F.col("value")).alias("previous"),
    )


def critical_disagreements(candidates: DataFrame, critical: tuple[str, ...] = R.SCORER_CRITICAL) -> DataFrame:
    """(job, field) whose first template and first model value, both there, differ in more than form."""
    c = candidates.where(F.col("field_key").isin(*critical) & ~is_blank_trim(F.col("value")))
    first = lambda cond: F.min_by(F.when(cond, F.col("value")), F.when(cond, F.col("ord")))
    g = c.groupBy("job_id", "field_key").agg(first(F.col("method") == "TEMPLATE_OCR").alias("template"), first(F.col("method").isin(*R.MODEL_METHODS)).alias("model"))
    plain = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    return g.where(F.col("template").isNotNull() & F.col("model").isNotNull() & (plain(F.col("template")) != plain(F.col("model"))))
