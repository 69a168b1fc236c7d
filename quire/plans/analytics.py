"""Queries of the analytics operators, over jobs (orders), candidates (line items) and feedback (events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import bindings as B
from quire.bindings import with_sql
from quire.operators import analytics as A
from quire.operators import views as V
from quire.plans.registry import query

#: 2001-01-01 and 2024-02-01 UTC: just after the stand-ins' last days.
AS_OF, DAYS = 978307200, 1460
_W = f"created_s >= {AS_OF - DAYS * 86400}"
_STATS = """count(*) AS total_jobs, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (status = 'FAILED') AS failed,
  round(coalesce(avg(overall_conf), 0.0), 4) AS avg_confidence, round(coalesce(avg(completed_s - started_s), 0.0), 1) AS avg_seconds"""


@query(with_sql("job", f"SELECT *, round(coalesce(completed / nullif(completed + needs_review, 0), 0.0), 4) AS auto_rate FROM (SELECT {_STATS} FROM job WHERE {_W})"))
def d1_quality_overview(spark, sf_dir):
    return A.quality_overview(B.job(spark, sf_dir), AS_OF, DAYS)


@query(with_sql("job", f"SELECT *, round(coalesce(needs_review / nullif(total_jobs, 0), 0.0), 4) AS review_rate FROM (SELECT payer, {_STATS} FROM job WHERE {_W} GROUP BY payer)"))
def d2_payer_stats(spark, sf_dir):
    return A.payer_stats(B.job(spark, sf_dir), AS_OF, DAYS)


@query(with_sql("feedback", "SELECT field_key, count(*) AS n FROM feedback WHERE feedback_type = 'correction' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20"))
def d3_common_corrections(spark, sf_dir):
    return A.common_corrections(B.feedback(spark, sf_dir))


@query(with_sql("feedback job", "SELECT payer, field_key, count(*) AS n FROM feedback JOIN job USING (job_id) WHERE feedback_type = 'correction' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20"))
def d4_corrections_by_payer(spark, sf_dir):
    return A.corrections_by_payer(B.feedback(spark, sf_dir), B.job(spark, sf_dir))


#: A review per user: claimed at the first event, submitted at the last if the user is even.
_REVIEW_SQL = "review AS (SELECT review_id, min(created_s) AS claimed_s, CASE WHEN review_id % 2 = 0 THEN max(created_s) END AS submitted_s FROM feedback GROUP BY 1)"


def _reviews(feedback):
    return feedback.groupBy("review_id").agg(F.min("created_s").alias("claimed_s"), F.max("created_s").alias("last")).select("review_id", "claimed_s", F.when(F.col("review_id") % 2 == 0, F.col("last")).alias("submitted_s"))


@query(with_sql("feedback", f"""WITH {_REVIEW_SQL}, f AS (SELECT count(*) AS total_feedback, count(*) FILTER (feedback_type = 'correction') AS total_corrections,
  count(DISTINCT review_id) FILTER (feedback_type = 'correction') AS reviews_with_corrections FROM feedback),
r AS (SELECT count(*) AS submitted_reviews, round(coalesce(avg(submitted_s - claimed_s), 0.0), 1) AS avg_review_seconds FROM review WHERE submitted_s IS NOT NULL)
SELECT *, round(coalesce(reviews_with_corrections / nullif(submitted_reviews, 0), 0.0), 4) AS correction_rate FROM f, r"""))  # fmt: skip
def d5_feedback_summary(spark, sf_dir):
    f = B.feedback(spark, sf_dir)
    return A.feedback_summary(f, _reviews(f))


@query(with_sql("job", f"""SELECT round(avg(d), 1) AS avg_seconds, round(quantile_cont(d, 0.5), 1) AS p50_seconds, round(quantile_cont(d, 0.95), 1) AS p95_seconds, count(*) AS n
FROM (SELECT completed_s - started_s AS d FROM job WHERE {_W}) WHERE d IS NOT NULL"""))  # fmt: skip
def d6_processing_time(spark, sf_dir):
    return A.processing_time(B.job(spark, sf_dir), AS_OF, DAYS)


@query(with_sql("job", f"SELECT coalesce(doc_type, 'UNKNOWN') AS doc_type, count(*) AS n FROM job WHERE {_W} GROUP BY 1"))
def d7_doc_types(spark, sf_dir):
    return A.doc_type_distribution(B.job(spark, sf_dir), AS_OF, DAYS)


@query(with_sql("job", "SELECT tenant_id, status, payer, count(*) AS n FROM job GROUP BY ALL"))
def d8_counts(spark, sf_dir):
    return A.counts(B.job(spark, sf_dir), "tenant_id", "status", "payer")


@query(with_sql("candidate job", """WITH per AS (SELECT job_id, field_key, count(DISTINCT value) AS v FROM candidate GROUP BY ALL)
SELECT *, rate > 0.3::DOUBLE AND conflicting > 0 AS alert FROM (SELECT payer, template_id, field_key, count(*) AS jobs, count(*) FILTER (v > 1) AS conflicting, round(count(*) FILTER (v > 1) / count(*), 4) AS rate
FROM per JOIN job USING (job_id) WHERE status IN ('COMPLETED', 'NEEDS_REVIEW') GROUP BY ALL)"""))  # fmt: skip
def d13_mismatch_metrics(spark, sf_dir):
    return A.mismatch_metrics(B.candidate(spark, sf_dir), B.job(spark, sf_dir))


@query(with_sql("feedback job", """SELECT field_key, n, rate, CASE WHEN rate > 0.3::DOUBLE THEN 'LOWER_CONFIDENCE_THRESHOLD' ELSE 'MONITOR' END AS action FROM (
SELECT field_key, count(*) AS n, round(count(*) / (SELECT count(*) FROM job), 4) AS rate FROM feedback WHERE feedback_type = 'correction' GROUP BY 1 HAVING count(*) >= 5)"""))  # fmt: skip
def d14_field_correction_rates(spark, sf_dir):
    return A.field_correction_rates(B.feedback(spark, sf_dir), B.job(spark, sf_dir))


_D15 = """SELECT payer, n, rate, CASE WHEN rate > 0.3::DOUBLE THEN 'INCREASE_REVIEW_THRESHOLD' WHEN rate > 0.15::DOUBLE THEN 'MONITOR' ELSE 'OK' END AS action FROM (
SELECT payer, n, round(n / coalesce(jobs, 1), 4) AS rate FROM (SELECT payer, count(*) AS n FROM feedback JOIN job USING (job_id) WHERE feedback_type = 'correction' GROUP BY 1) LEFT JOIN (SELECT payer, count(*) AS jobs FROM job GROUP BY 1) USING (payer))"""


@query(with_sql("feedback job", _D15))
def d15_payer_correction_rates(spark, sf_dir):
    return A.payer_correction_rates(B.feedback(spark, sf_dir), B.job(spark, sf_dir))


_D16 = """SELECT wrong, "right", count(*) AS n FROM (SELECT unnest(string_split(original_value, '')) AS wrong, unnest(string_split(corrected_value, '')) AS "right"
FROM feedback WHERE feedback_type = 'correction' AND length(original_value) = length(corrected_value)) WHERE wrong <> "right" GROUP BY ALL HAVING count(*) >= 3 ORDER BY n DESC, wrong, "right" LIMIT 10"""


@query(with_sql("feedback", _D16))
def d16_substitution_pairs(spark, sf_dir):
    return A.substitution_pairs(B.feedback(spark, sf_dir))


@query(with_sql("feedback", "SELECT field_key, count(*) AS n FROM feedback WHERE feedback_type = 'correction' GROUP BY 1 HAVING count(*) >= 5"))
def d17_roi_drift(spark, sf_dir):
    return A.roi_drift(B.feedback(spark, sf_dir))


@query(with_sql("feedback job", f"""WITH d16 AS ({_D16}), d15 AS ({_D15}), c AS (SELECT field_key, count(*) AS n FROM feedback WHERE feedback_type = 'correction' GROUP BY 1 HAVING count(*) >= 5)
SELECT 'field' AS analysis, field_key AS key, n, CASE WHEN round(n / (SELECT count(*) FROM job), 4) > 0.3::DOUBLE THEN 'LOWER_CONFIDENCE_THRESHOLD' ELSE 'MONITOR' END AS action FROM c
UNION ALL SELECT 'payer', payer, n, action FROM d15 UNION ALL SELECT 'ocr', wrong || '>' || "right", n, 'ADD_SUBSTITUTION' FROM d16 UNION ALL SELECT 'roi', field_key, n, 'CHECK_ROI' FROM c"""))  # fmt: skip
def i27_recommendations(spark, sf_dir):
    return A.recommendations(B.feedback(spark, sf_dir), B.job(spark, sf_dir))


@query(with_sql("candidate", "SELECT job_id, field_key FROM candidate GROUP BY ALL HAVING count(DISTINCT value) > 1"))
def c4_conflicts(spark, sf_dir):
    return A.conflicts(B.candidate(spark, sf_dir))


@query(with_sql("feedback job", "SELECT event_id, payer, tenant_id, field_key FROM feedback JOIN job USING (job_id) WHERE payer = '1-URGENT'"))
def c1_feedback_jobs(spark, sf_dir):
    jobs = B.job(spark, sf_dir).where("payer = '1-URGENT'")
    return B.feedback(spark, sf_dir).join(jobs, "job_id").select("event_id", "payer", "tenant_id", "field_key")


@query(with_sql("feedback job", f"WITH {_REVIEW_SQL} SELECT review_id, tenant_id, status FROM review JOIN job ON review_id = job_id WHERE tenant_id = 'MACHINERY'"))
def c2_tenant_reviews(spark, sf_dir):
    jobs = B.job(spark, sf_dir).where("tenant_id = 'MACHINERY'")
    return _reviews(B.feedback(spark, sf_dir)).join(jobs, F.col("review_id") == F.col("job_id")).select("review_id", "tenant_id", "status")


@query(with_sql("candidate job", "SELECT job_id, field_key, method, payer FROM candidate JOIN job USING (job_id) WHERE status <> 'FAILED'"))
def c3_fields_jobs(spark, sf_dir):
    jobs = B.job(spark, sf_dir).where("status <> 'FAILED'").select("job_id", "payer")
    return B.candidate(spark, sf_dir).join(jobs, "job_id").select("job_id", "field_key", "method", "payer")


@query(with_sql("feedback job", """SELECT payer, coalesce(n, 0) AS corrections, coalesce(jobs, 1) AS jobs FROM (SELECT payer, count(*) AS jobs FROM job GROUP BY 1)
LEFT JOIN (SELECT payer, count(*) AS n FROM feedback JOIN job USING (job_id) WHERE feedback_type = 'correction' AND field_key = 'error' GROUP BY 1) USING (payer)"""))  # fmt: skip
def c16_payer_totals(spark, sf_dir):
    jobs = B.job(spark, sf_dir)
    n = A.corrections(B.feedback(spark, sf_dir)).where("field_key = 'error'").join(jobs, "job_id").groupBy("payer").agg(F.count("*").alias("n"))
    return jobs.groupBy("payer").agg(F.count("*").alias("jobs")).join(n, "payer", "left").select("payer", F.coalesce("n", F.lit(0)).alias("corrections"), "jobs")


# Documented but not implemented by the reference (M1-M6).
@query(with_sql("job", f"SELECT payer, doc_type, count(*) AS n, round(avg(overall_conf), 4) AS avg_confidence FROM job WHERE {_W} GROUP BY ROLLUP (payer, doc_type)"))
def m2_payer_breakdown(spark, sf_dir):
    j = B.job(spark, sf_dir).where(A.in_window(AS_OF, DAYS))
    return j.rollup("payer", "doc_type").agg(F.count("*").alias("n"), F.round(F.avg("overall_conf"), 4).alias("avg_confidence"))


@query(with_sql("feedback", """SELECT field_key, count(*) AS total, count(*) FILTER (feedback_type = 'correction') AS corrected, round(1 - count(*) FILTER (feedback_type = 'correction') / count(*), 4) AS accuracy FROM feedback GROUP BY 1"""))
def m3_field_accuracy(spark, sf_dir):
    return V.field_accuracy(B.feedback(spark, sf_dir))


@query(with_sql("feedback", "SELECT created_s // 3600 AS hour, count(*) AS n, count(*) FILTER (feedback_type = 'correction') AS corrections FROM feedback GROUP BY 1"))
def m5_hourly_trend(spark, sf_dir):
    return V.hourly_trend(B.feedback(spark, sf_dir))


@query(with_sql("job feedback", """SELECT * FROM (SELECT count(*) AS jobs, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (needs_review) AS in_review, round(avg(overall_conf), 4) AS avg_confidence FROM job),
(SELECT count(*) AS feedback, count(*) FILTER (feedback_type = 'correction') AS corrections, count(DISTINCT field_key) AS fields FROM feedback)"""))
def m1_summary(spark, sf_dir):
    return V.summary(B.job(spark, sf_dir), B.feedback(spark, sf_dir))


@query(with_sql("feedback", "SELECT field_key, substr(original_value, 1, 3) AS original_value, substr(corrected_value, 1, 3) AS corrected_value, count(*) AS n, max(created_s) AS last_s FROM feedback WHERE feedback_type = 'correction' AND substr(original_value, 1, 3) <> substr(corrected_value, 1, 3) GROUP BY ALL HAVING count(*) >= 2"))
def m4_mismatches(spark, sf_dir):
    f = B.feedback(spark, sf_dir).withColumns({c: F.substring(c, 1, 3) for c in ("original_value", "corrected_value")})
    return V.mismatches(f)


@query(with_sql("job candidate", "SELECT job_id, status, created_s, found_in FROM (SELECT job_id, status, created_s, tenant_id FROM job) JOIN (SELECT job_id, string_agg(DISTINCT field_key, ',' ORDER BY field_key) AS found_in FROM candidate WHERE contains(lower(value), 'v3') GROUP BY 1) USING (job_id) WHERE tenant_id = 'MACHINERY' ORDER BY created_s DESC, job_id LIMIT 50"))
def m6_job_search(spark, sf_dir):
    found = V.job_search(B.job(spark, sf_dir), B.candidate(spark, sf_dir), "V3", "MACHINERY")
    return found.select("job_id", "status", "created_s", F.array_join("found_in", ",").alias("found_in"))


@query(with_sql("feedback", "SELECT event_id, review_id, field_key FROM feedback WHERE field_key = 'view' AND feedback_type = 'confirmation' ORDER BY created_s DESC, event_id LIMIT 10000"))
def b18_training_filter(spark, sf_dir):
    labels = B.feedback(spark, sf_dir).select(F.col("event_id").alias("label_id"), F.lit("all").alias("payer"), "review_id", "field_key", (F.col("feedback_type") == "confirmation").alias("is_verified"), "created_s")
    return V.training_filter(labels, payer="all", field_key="view").select(F.col("label_id").alias("event_id"), "review_id", "field_key")
