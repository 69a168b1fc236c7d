"""Quality analytics over jobs, reviews and feedback (D1-D7, D13-D17). Times are seconds; windows end at ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.quantiles import percentiles


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, 0.0 where whole is 0 or null."""
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), digits)


def duration() -> Column:
    return F.when(F.col("completed_s").isNotNull() & F.col("started_s").isNotNull(), F.col("completed_s") - F.col("started_s"))


def in_window(as_of: int, days: int) -> Column:
    return F.col("created_s") >= as_of - days * 86400


def _status(name: str) -> Column:
    return F.count_if(F.col("status") == name)


def quality_overview(jobs: DataFrame, as_of: int, days: int) -> DataFrame:
    """One row: jobs by status, average confidence and seconds, and the share of processed jobs that need no review."""
    one = jobs.where(in_window(as_of, days)).agg(
        F.count("*").alias("total_jobs"), _status("COMPLETED").alias("completed"), _status("NEEDS_REVIEW").alias("needs_review"), _status("FAILED").alias("failed"),
        F.round(F.coalesce(F.avg("overall_conf"), F.lit(0.0)), 4).alias("avg_confidence"), F.round(F.coalesce(F.avg(duration()), F.lit(0.0)), 1).alias("avg_seconds"),
    )
    return one.withColumn("auto_rate", rate(F.col("completed"), F.col("completed") + F.col("needs_review")))


def payer_stats(jobs: DataFrame, as_of: int, days: int, payer: str | None = None) -> DataFrame:
    """Per payer: counts by status, averages and the review rate, most jobs first."""
    j = jobs.where(in_window(as_of, days))
    j = j.where(F.col("payer") == payer) if payer else j
    g = j.groupBy("payer").agg(
        F.count("*").alias("total_jobs"), _status("COMPLETED").alias("completed"), _status("NEEDS_REVIEW").alias("needs_review"), _status("FAILED").alias("failed"),
        F.round(F.coalesce(F.avg("overall_conf"), F.lit(0.0)), 4).alias("avg_confidence"), F.round(F.coalesce(F.avg(duration()), F.lit(0.0)), 1).alias("avg_seconds"),
    )
    return g.withColumn("review_rate", rate(F.col("needs_review"), F.col("total_jobs"))).orderBy(F.col("total_jobs").desc(), "payer")


def corrections(feedback: DataFrame) -> DataFrame:
    return feedback.where(F.col("feedback_type") == "correction")


def common_corrections(feedback: DataFrame, top: int = 20) -> DataFrame:
    return corrections(feedback).groupBy("field_key").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "field_key").limit(top)


def corrections_by_payer(feedback: DataFrame, jobs: DataFrame, payer: str | None = None, top: int = 20) -> DataFrame:
    j = jobs.where(F.col("payer") == payer) if payer else jobs
    met = corrections(feedback).join(j.select("job_id", "payer"), "job_id")
    return met.groupBy("payer", "field_key").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "payer", "field_key").limit(top)


def feedback_summary(feedback: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: feedback, corrections, submitted reviews, their seconds, and the share of them with a correction."""
    f = feedback.agg(F.count("*").alias("total_feedback"), F.count_if(F.col("feedback_type") == "correction").alias("total_corrections"), F.countDistinct(F.when(F.col("feedback_type") == "correction", F.col("review_id"))).alias("reviews_with_corrections"))
    r = reviews.where(F.col("submitted_s").isNotNull()).agg(F.count("*").alias("submitted_reviews"), F.round(F.coalesce(F.avg(F.col("submitted_s") - F.col("claimed_s")), F.lit(0.0)), 1).alias("avg_review_seconds"))
    return f.crossJoin(r).withColumn("correction_rate", rate(F.col("reviews_with_corrections"), F.col("submitted_reviews")))  # one row each


def processing_time(jobs: DataFrame, as_of: int, days: int) -> DataFrame:
    """One row: mean, median and 95th percentile of the seconds that jobs took, and how many there are; the percentiles are found at once."""
    d = jobs.where(in_window(as_of, days)).select(duration().alias("d")).where("d IS NOT NULL")
    half, most = (F.round(F.lit(p).cast("double"), 1) for p in percentiles(d, "d", (0.5, 0.95)))
    return d.agg(F.round(F.avg("d"), 1).alias("avg_seconds"), half.alias("p50_seconds"), most.alias("p95_seconds"), F.count("*").alias("n"))


def doc_type_distribution(jobs: DataFrame, as_of: int, days: int) -> DataFrame:
    j = jobs.where(in_window(as_of, days)).groupBy(F.coalesce("doc_type", F.lit("UNKNOWN")).alias("doc_type"))
    return j.agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "doc_type")


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def conflicts(candidates: DataFrame) -> DataFrame:
    """(job, field) pairs whose methods disagree: more than one different value, compared as they stand."""
    return candidates.groupBy("job_id", "field_key").agg(F.countDistinct("value").alias("values")).where("values > 1").select("job_id", "field_key")


def mismatch_metrics(candidates: DataFrame, jobs: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Per payer, template and field: jobs, jobs in conflict, their rate, and whether it calls for an alert."""
    done = jobs.where(F.col("status").isin("COMPLETED", "NEEDS_REVIEW")).select("job_id", "payer", "template_id")
    per_job = candidates.groupBy("job_id", "field_key").agg(F.countDistinct("value").alias("values"))
    g = per_job.join(done, "job_id").groupBy("payer", "template_id", "field_key").agg(F.count("*").alias("jobs"), F.count_if(F.col("values") > 1).alias("conflicting"))
    g = g.withColumn("rate", rate(F.col("conflicting"), F.col("jobs")))
    return g.withColumn("alert", (F.col("rate") > threshold) & (F.col("conflicting") > 0))


def field_correction_rates(feedback: DataFrame, jobs: DataFrame, least: int = 5, limit: float = 0.30) -> DataFrame:
    """Corrections of a field over all jobs, windowed or not, and what to do about it; rare fields are left out."""
    g = corrections(feedback).groupBy("field_key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    g = g.crossJoin(F.broadcast(jobs.agg(F.count("*").alias("jobs"))))  # one row
    g = g.withColumn("rate", rate(F.col("n"), F.col("jobs")))
    return g.select("field_key", "n", "rate", F.when(F.col("rate") > limit, "LOWER_CONFIDENCE_THRESHOLD").otherwise("MONITOR").alias("action")).orderBy(F.col("rate").desc(), "field_key")


def payer_correction_rates(feedback: DataFrame, jobs: DataFrame) -> DataFrame:
    c = corrections(feedback).join(jobs.select("job_id", "payer"), "job_id").groupBy("payer").agg(F.count("*").alias("n"))
    totals = jobs.groupBy(F.col("payer").alias("_payer")).agg(F.count("*").alias("jobs"))
    g = c.join(totals, F.col("payer") == F.col("_payer"), "left").withColumn("rate", rate(F.col("n"), F.coalesce("jobs", F.lit(1))))
    return g.select("payer", "n", "rate", F.when(F.col("rate") > 0.30, "INCREASE_REVIEW_THRESHOLD").when(F.col("rate") > 0.15, "MONITOR").otherwise("OK").alias("action"))


def substitution_pairs(feedback: DataFrame, least: int = 3, top: int = 10) -> DataFrame:
    """Characters that corrections replace, position by position in values of equal length."""
    c = corrections(feedback).where(F.length("original_value") == F.length("corrected_value"))
    chars = lambda x: F.filter(F.split(x, ""), lambda y: y != "")
    pairs = c.select(F.explode(F.arrays_zip(chars(F.col("original_value")).alias("wrong"), chars(F.col("corrected_value")).alias("right"))).alias("p")).select("p.wrong", "p.right").where("wrong <> right")
    return pairs.groupBy("wrong", "right").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "wrong", "right").limit(top)


def roi_drift(feedback: DataFrame, least: int = 5) -> DataFrame:
    return corrections(feedback).groupBy("field_key").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def recommendations(feedback: DataFrame, jobs: DataFrame) -> DataFrame:
    """The four analyses as one table: analysis, key, n, action."""
    parts = [
        field_correction_rates(feedback, jobs).select(F.lit("field").alias("analysis"), F.col("field_key").alias("key"), "n", "action"),
        payer_correction_rates(feedback, jobs).select(F.lit("payer"), "payer", "n", "action"),
        substitution_pairs(feedback).select(F.lit("ocr"), F.concat("wrong", F.lit(">"), "right"), "n", F.lit("ADD_SUBSTITUTION")),
        roi_drift(feedback).select(F.lit("roi"), "field_key", "n", F.lit("CHECK_ROI")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
