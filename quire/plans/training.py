"""Queries of the training-set operators, over line items as fields and labels joined with documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import bindings as B
from quire.bindings import with_sql
from quire.operators import training as T
from quire.plans.registry import query

_KEYS = ("member_id", "decision", "patient_name")
_TRAIN = "field_key IN ('member_id', 'decision', 'patient_name') AND (method IN ('TEMPLATE_OCR', 'HUMAN_REVIEW') OR confidence >= 0.80::DOUBLE) AND confidence >= 0.50::DOUBLE AND lower(trim(value)) NOT IN ('', 'n/a', 'none', 'unknown', '-', 'null')"


@query(with_sql("candidate", f"SELECT job_id, field_key, ord, value FROM candidate WHERE {_TRAIN}"))
def b24_trainable(spark, sf_dir):
    return T.trainable(B.candidate(spark, sf_dir), _KEYS).select("job_id", "field_key", "ord", "value")


@query(with_sql("candidate", "SELECT job_id, field_key, ord FROM candidate WHERE length(trim(value)) >= 2 AND regexp_matches(trim(value), '^v[0-2]')"))
def b25_valid_truth(spark, sf_dir):
    return B.candidate(spark, sf_dir).where(T.valid_truth(F.col("value"), "^v[0-2]")).select("job_id", "field_key", "ord")


@query(with_sql("candidate", f"SELECT DISTINCT job_id, field_key FROM candidate WHERE {_TRAIN} EXCEPT SELECT job_id, field_key FROM candidate WHERE NOT validation_passed"))
def c14_new_labels(spark, sf_dir):
    c = B.candidate(spark, sf_dir)
    return T.new_labels(T.trainable(c, _KEYS), c.where("NOT validation_passed")).select("job_id", "field_key").distinct()


_LABELS = "label AS (SELECT l_orderkey AS page_id, 'f' || l_linenumber AS field_key, 'v' || l_partkey AS value, l_returnflag AS payer, epoch(l_shipdate)::BIGINT AS created_s, l_partkey * 1000000 + l_suppkey * 100 + l_quantity::BIGINT AS label_id FROM lineitem)"


def _labels(spark, sf_dir):
    i = B.table(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_orderkey").alias("page_id"), F.concat(F.lit("f"), "l_linenumber").alias("field_key"), F.concat(F.lit("v"), "l_partkey").alias("value"), F.col("l_returnflag").alias("payer"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("created_s"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("label_id"),
    )


@query(f"""WITH {_LABELS}, k AS (SELECT * FROM label QUALIFY row_number() OVER (PARTITION BY page_id, field_key ORDER BY created_s, label_id) = 1),
t AS (SELECT page_id, '{{' || string_agg('"' || field_key || '":"' || value || '"', ',' ORDER BY field_key) || '}}' AS gt_parse FROM k GROUP BY 1)
SELECT page_id, gt_parse, payer FROM t JOIN (SELECT page_id, arg_max(payer, struct_pack(a := created_s, b := label_id)) AS payer FROM label GROUP BY 1) USING (page_id)""")
def d21_export_groups(spark, sf_dir):
    return T.export_groups(_labels(spark, sf_dir))


@query("""WITH p AS (SELECT doc_id, quality AS cls FROM labels), s AS (SELECT cls, count(*) AS n FROM p GROUP BY 1), t AS (SELECT max(n) AS top FROM s),
r AS (SELECT doc_id, cls, n, top, row_number() OVER (PARTITION BY cls ORDER BY md5('42:' || doc_id), doc_id) - 1 AS rank FROM p JOIN s USING (cls), t)
SELECT doc_id, cls, unnest(range(1, top // n + CASE WHEN rank < top - top // n * n THEN 1 ELSE 0 END + 1))::INTEGER AS copy FROM r""")
def d22_balanced(spark, sf_dir):
    p = B.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("cls"))
    return T.balanced(p, "cls", "doc_id").select("doc_id", "cls", "copy")


@query(with_sql("page", """SELECT c.job_id, page_number, field_key, job_id || field_key AS ground_truth_value, payer, 'DT' || job_id % 3 AS doc_type, 'human_review' AS source, job_id % 7 AS created_by
FROM (SELECT job_id, arg_min(payer, page_number) AS payer FROM page GROUP BY 1) c JOIN (SELECT job_id, min(page_number) AS page_number FROM page WHERE NOT is_cover GROUP BY 1) USING (job_id), (SELECT unnest(['f1', 'f2']) AS field_key)"""))
def j8_review_labels(spark, sf_dir):
    """Two fields of every job corrected."""
    p = B.page(spark, sf_dir)
    jobs = p.groupBy("job_id").agg(F.min_by("payer", "page_number").alias("payer")).withColumn("doc_type", F.concat(F.lit("DT"), F.col("job_id") % 3))
    c = jobs.select("job_id", F.explode(F.array(F.lit("f1"), F.lit("f2"))).alias("field_key")).withColumns({"corrected_value": F.concat("job_id", "field_key"), "reviewer_id": F.col("job_id") % 7})
    return T.review_labels(c, p, jobs)


@query("""SELECT count(*) FILTER (created_s > 883612800) AS new_labels, count(*) FILTER (created_s > 883612800) >= 20 AS due FROM (SELECT epoch(l_shipdate)::BIGINT AS created_s FROM lineitem)""")
def j12_retrain_due(spark, sf_dir):
    models = spark.createDataFrame([("LAYOUTLM", 883612800), ("layoutlm", 852076800), ("OTHER", 946684800)], "model_type string, created_s long")
    return T.retrain_due(_labels(spark, sf_dir), models, "layoutlm")


@query(f"""WITH {_LABELS}, q AS (SELECT unnest(['f1', 'f1', 'f2']) AS field_key, unnest(['What is it?', 'Which one?', 'Who?']) AS question) SELECT question, count(*) AS n FROM label JOIN q USING (field_key) GROUP BY 1""")
def j13_questions(spark, sf_dir):
    q = T.questions(_labels(spark, sf_dir), {"f1": ("What is it?", "Which one?"), "f2": ("Who?",)})
    return q.groupBy("question").agg(F.count("*").alias("n"))


@query(with_sql("job candidate", f"SELECT payer, field_key, count(*) AS n FROM candidate JOIN job USING (job_id) WHERE status = 'COMPLETED' AND {_TRAIN} GROUP BY ALL"))
def j11_training_set(spark, sf_dir):
    jobs = B.job(spark, sf_dir).where("status = 'COMPLETED'").select("job_id", "payer")
    return T.trainable(B.candidate(spark, sf_dir), _KEYS).join(jobs, "job_id").groupBy("payer", "field_key").agg(F.count("*").alias("n"))


_J11_PAGES = """pages AS (SELECT l_orderkey AS job_id, min(l_linenumber) AS page_number, bool_or(l_returnflag = 'A') AS is_cover FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


@query(with_sql("job candidate", f"""WITH {_J11_PAGES}, best AS (SELECT job_id, page_number, CASE WHEN page_number % 3 > 0 THEN 'pre/' ELSE 'raw/' END || job_id || '/' || page_number AS page_key FROM pages WHERE page_number % 5 <> 0 OR page_number % 3 > 0), one AS (SELECT job_id, arg_min(page_number, (is_cover::INTEGER, (page_number <> 1)::INTEGER, page_number)) AS page_number FROM pages GROUP BY 1),
field AS (SELECT job_id, field_key, arg_min(trim(value), ord) AS value, arg_min(confidence, ord) AS confidence, arg_min(method, ord) AS method FROM candidate GROUP BY ALL),
seen AS (SELECT DISTINCT job_id, field_key FROM candidate WHERE job_id % 11 = 0 AND NOT validation_passed)
SELECT job_id, page_number AS page_id, field_key, value, page_key, upper(payer) AS payer, doc_type, CASE WHEN template_id % 5 = 0 THEN 'synthetic_template' ELSE 'batch3_extraction' END AS source
FROM field JOIN job USING (job_id) JOIN one USING (job_id) JOIN best USING (job_id, page_number)
WHERE status IN ('COMPLETED', 'NEEDS_REVIEW') AND field_key IN ('member_id', 'decision', 'patient_name') AND value <> '' AND confidence >= 0.30::DOUBLE
  AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.job_id = field.job_id AND seen.field_key = field.field_key)"""))
def j11_training_labels(spark, sf_dir):
    c = B.candidate(spark, sf_dir)
    fields = c.groupBy("job_id", "field_key").agg(*(F.min_by(x, "ord").alias(x) for x in ("value", "confidence", "method")))
    jobs = B.job(spark, sf_dir).withColumn("filename", F.when(F.col("template_id") % 5 == 0, "Old-HUMANA.pdf").otherwise("scan.pdf"))
    p = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("page_number")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("is_cover"))
    key = lambda kind: F.concat(F.lit(kind), "job_id", F.lit("/"), "page_number")
    n = F.col("page_number")
    pages = p.withColumns({"page_id": n, "preprocessed_key": F.when(n % 3 > 0, key("pre/")), "raw_key": F.when(n % 5 != 0, key("raw/")).otherwise("")})
    existing = c.where("job_id % 11 = 0 AND NOT validation_passed")
    return T.training_labels(jobs, fields, pages, existing, _KEYS, 0.30)


@query("SELECT 'q' || quality || 't' || toxic AS label, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def b18_label_counts(spark, sf_dir):
    m = B.table(spark, sf_dir, "labels").join(B.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return m.groupBy(F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("label"), "lang").agg(F.count("*").alias("n"))
