"""Queries of state and upserts, over events and orders as logs; and the plain lookups over jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import bindings as B
from quire.bindings import with_sql
from quire.operators import state as S, templates as A, views as V
from quire.plans.registry import query
from quire.sources.committed import CommittedTable, release_claims
from quire.sources.scratch import folder

_EV = """ev AS (SELECT user_id AS job_id, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'PROCESSING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'NEEDS_REVIEW' END AS status, created_s AS t, event_id AS seq FROM (SELECT *, floor(epoch(ts))::BIGINT AS created_s FROM events))"""


def _ev(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "view", "PROCESSING").when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED").otherwise("NEEDS_REVIEW")
    return e.select(F.col("user_id").alias("job_id"), status.alias("status"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), "user_id")


@query(f"""WITH {_EV} SELECT job_id, arg_max(status, struct_pack(a := t, s := seq)) AS status, min(t) FILTER (status = 'PROCESSING') AS started_at, max(t) FILTER (status = 'COMPLETED') AS completed_at, count(*) AS events FROM ev GROUP BY 1""")
def j1_job_state(spark, sf_dir):
    return S.job_state(_ev(spark, sf_dir))


def _attempts(spark, sf_dir):
    e = _ev(spark, sf_dir)
    return e.select((F.col("seq") % 40).alias("review_id"), (F.col("user_id") % 7).cast("long").alias("user_id"), "at", "seq")


# The fold as a recursive walk over each review's attempts.
_CLAIMS = f"""RECURSIVE {_EV}, att AS (SELECT seq % 40 AS review_id, (job_id % 7)::BIGINT AS user_id, t, row_number() OVER (PARTITION BY seq % 40 ORDER BY t, seq) AS i FROM ev),
walk AS (SELECT review_id, i, user_id AS holder, t AS since, 1 AS granted, 0 AS refused FROM att WHERE i = 1
  UNION ALL SELECT a.review_id, a.i, CASE WHEN f THEN a.user_id ELSE holder END, CASE WHEN f THEN a.t ELSE since END, granted + f::INTEGER, refused + (NOT f)::INTEGER
  FROM (SELECT a.*, holder, since, granted, refused, holder = a.user_id OR a.t - since > 1800 AS f FROM walk JOIN att a ON a.review_id = walk.review_id AND a.i = walk.i + 1) a)"""


@query(f"""WITH {_CLAIMS} SELECT review_id, holder AS claimed_by, since AS claimed_at, granted::INTEGER AS granted, refused::INTEGER AS refused FROM walk QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY i DESC) = 1""")
def j3_claims(spark, sf_dir):
    return S.claims(_attempts(spark, sf_dir))


_REV = f"""rev AS (SELECT review_id, user_id AS claimed_by, t AS claimed_at, review_id % 3 AS priority, t - 100 AS created_s, CASE WHEN review_id % 4 = 0 THEN t END AS submitted_s FROM (SELECT job_id AS review_id, (job_id % 7)::BIGINT AS user_id, max(t) AS t FROM ev GROUP BY ALL))"""


def _reviews(spark, sf_dir):
    e = _ev(spark, sf_dir).groupBy(F.col("job_id").alias("review_id")).agg(F.max("at").alias("at"))
    return e.select("review_id", (F.col("review_id") % 7).cast("long").alias("claimed_by"), F.col("at").alias("claimed_at"), (F.col("review_id") % 3).alias("priority"), (F.col("at") - 100).alias("created_s"), F.when(F.col("review_id") % 4 == 0, F.col("at")).alias("submitted_s"))


@query(f"WITH {_EV}, {_REV} SELECT review_id, priority, created_s FROM rev WHERE submitted_s IS NULL AND 1706659200 - claimed_at > 1800")
def j2_unclaimed_reviews(spark, sf_dir):
    return S.unclaimed(_reviews(spark, sf_dir), 1706659200).select("review_id", "priority", "created_s")


@query(f"WITH {_EV}, {_REV} SELECT review_id, min(ev.t) AS submitted_s, min(ev.t - claimed_at) AS seconds FROM ev JOIN rev ON rev.review_id = ev.job_id WHERE ev.job_id % 7 = claimed_by AND ev.t >= claimed_at GROUP BY 1")
def j4_submits(spark, sf_dir):
    submits = _ev(spark, sf_dir).select(F.col("job_id").alias("review_id"), (F.col("user_id") % 7).cast("long").alias("user_id"), "at")
    return S.submitted(_reviews(spark, sf_dir), submits)


@query(f"WITH {_EV}, {_REV} SELECT count(*) AS released FROM rev WHERE submitted_s IS NULL AND 1706659200 - claimed_at > 1800")
def j5_release_expired(spark, sf_dir):
    return S.unclaimed(_reviews(spark, sf_dir), 1706659200).agg(F.count("*").alias("released"))


@query("SELECT s_nationkey AS grp, arg_max(s_suppkey, struct_pack(a := round(s_acctbal)::BIGINT, b := s_suppkey)) AS active_version, count(*) AS promotions FROM supplier GROUP BY 1")
def j6_active_versions(spark, sf_dir):
    p = B.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("version_id"), F.round("s_acctbal").cast("long").alias("at"))
    return S.promoted(p, "grp")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'UPDATED' END, c_mktsegment) AS segment FROM customer")
def g2_upsert(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    old = c.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("UPDATED").alias("segment"))
    return S.upsert(old, new, ["c_custkey"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'UPDATED 2' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 3 = 0
UNION ALL SELECT NULL, 'NEW'""")
def g2_committed_upsert(spark, sf_dir):
    """All customers in a committed table; every third updated twice in a batch that is sent twice, every seventh deleted first, a null key added."""
    c = B.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    table = CommittedTable.create(c, folder(spark, "customers"), ["c_custkey"], 16)
    table.apply("deletes", 0, None, c.where("c_custkey % 7 = 0"))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.explode(F.array(F.lit("UPDATED 1"), F.lit("UPDATED 2"))).alias("segment"))
    for _ in range(2):
        table.apply("updates", 0, new, None, "segment")
    for name in ("OLD", "NEW"):
        table.apply("nulls", int(name == "NEW"), c.limit(1).select(F.lit(None).cast("long").alias("c_custkey"), F.lit(name).alias("segment")))
    return table.read()


@query(f"""WITH {_EV}, {_REV} SELECT review_id, CASE WHEN gone THEN NULL ELSE claimed_by END AS claimed_by, CASE WHEN gone THEN NULL ELSE claimed_at END AS claimed_at, submitted_s
FROM (SELECT *, submitted_s IS NULL AND 1706659200 - claimed_at > 1800 AS gone FROM rev)""")
def j5_cleared_claims(spark, sf_dir):
    """Reviews in a committed table, once claims that ran out are released; the batch is sent twice, the second time with a later clock."""
    reviews = _reviews(spark, sf_dir).select("review_id", "claimed_by", "claimed_at", "submitted_s")
    table = CommittedTable.create(reviews, folder(spark, "reviews"), ["review_id"], 16)
    release_claims(table, "beat", 0, 1706659200)
    release_claims(table, "beat", 0, 2000000000)
    return table.read()


@query("""SELECT s_suppkey AS template_id, (['AETNA', 'CIGNA', 'HUMANA'])[1 + s_nationkey % 4] AS payer_name, CASE WHEN s_suppkey % 5 = 0 THEN 'renamed' ELSE s_name END AS template_name,
CASE WHEN s_suppkey % 5 = 0 THEN 'second' END AS description, s_suppkey % 10 <> 0 AS is_active FROM supplier WHERE s_nationkey % 4 < 3 AND s_suppkey % 7 <> 0""")
def n14_template_admin(spark, sf_dir):
    """Templates created where the payer is known, every fifth updated twice, every seventh deleted."""
    s = B.table(spark, sf_dir, "supplier")
    name = F.get(F.array(*(F.lit(p) for p in ("aetna", "Cigna", "HUMANA", "nobody"))), F.col("s_nationkey") % 4)
    asked = s.select(F.col("s_suppkey").alias("template_id"), name.alias("payer_name"), F.lit("prior_auth").alias("doc_type"), F.col("s_name").alias("template_name"), F.lit(None).cast("string").alias("description"))
    new = A.created(A.checked(asked, ("AETNA", "CIGNA", "HUMANA"), ("PRIOR_AUTH",)))
    table = CommittedTable.create(new.limit(0), folder(spark, "templates"), ["template_id"], 8)
    table.apply("admin", 0, new)
    edits = s.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("template_id"), F.lit("renamed").alias("template_name"), (F.col("s_suppkey") % 10 != 0).alias("is_active"), F.explode(F.array(F.lit("first"), F.lit("second"))).alias("description"))
    table.apply("admin", 1, lambda rows: A.updated(rows, edits, "description"))
    table.apply("admin", 2, None, s.where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("template_id")))
    return table.read().drop("doc_type")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def g3_delete_by_job(spark, sf_dir):
    gone = B.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.delete_by(B.table(spark, sf_dir, "lineitem"), gone, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(with_sql("candidate", """SELECT job_id, field_key FROM (SELECT DISTINCT job_id FROM candidate), (SELECT unnest(['member_id', 'decision', 'patient_dob']) AS field_key) EXCEPT SELECT job_id, field_key FROM candidate"""))
def c15_missing_fields(spark, sf_dir):
    c = B.candidate(spark, sf_dir)
    return S.missing_fields(c, c, ["member_id", "decision", "patient_dob"])


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size + 100 END, p_size)::INTEGER AS p_size, p_brand FROM part")
def n10_page_updates(spark, sf_dir):
    p = B.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    u = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 100).alias("p_size"))
    return S.coalesce_update(p, u, ["p_partkey"], ["p_size"]).select("p_partkey", "p_size", "p_brand")


_JOB = "job_id, tenant_id, payer, status, created_s"


def _jobs(spark, sf_dir):
    return B.job(spark, sf_dir)


def _few(df):
    return df.select("job_id", "tenant_id", "payer", "status", "created_s")


@query(with_sql("job", f"SELECT {_JOB} FROM job WHERE tenant_id = 'MACHINERY' AND status = 'COMPLETED' ORDER BY created_s DESC, job_id LIMIT 100 OFFSET 50"))
def b1_jobs_page(spark, sf_dir):
    return _few(V.jobs_page(_jobs(spark, sf_dir), "MACHINERY", "COMPLETED", 50, 100))


@query(with_sql("job", "SELECT sha256, tenant_id, min(job_id) AS first_job, count(*) AS n FROM job GROUP BY ALL HAVING count(*) > 1"))
def b2_duplicate_uploads(spark, sf_dir):
    return V.duplicate_uploads(_jobs(spark, sf_dir))


@query(with_sql("job", f"SELECT {_JOB} FROM job WHERE status = 'FAILED' ORDER BY created_s, job_id LIMIT 50"))
def b3_oldest_failed(spark, sf_dir):
    return _few(V.oldest(_jobs(spark, sf_dir), "FAILED"))


@query(with_sql("job", f"SELECT {_JOB} FROM job WHERE needs_review AND tenant_id = 'BUILDING'"))
def b4_needing_review(spark, sf_dir):
    return _few(V.needing_review(_jobs(spark, sf_dir), "BUILDING"))


@query(with_sql("job", f"SELECT {_JOB} FROM job WHERE template_id = 7"))
def b5_jobs_of_template(spark, sf_dir):
    return _few(V.jobs_of_template(_jobs(spark, sf_dir), 7))


@query(with_sql("page", "SELECT job_id, page_number FROM page WHERE NOT is_cover"))
def b6_content_pages(spark, sf_dir):
    return V.content_pages(B.page(spark, sf_dir)).select("job_id", "page_number")


@query(with_sql("page", "SELECT job_id, min(page_number) AS first_page, min(page_number) FILTER (NOT is_cover) AS label_page, count(*) AS pages FROM page GROUP BY 1"))
def j8_label_pages(spark, sf_dir):
    return V.label_pages(B.page(spark, sf_dir))


@query(with_sql("candidate", "SELECT job_id, field_key, ord, confidence, place FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY field_key, ord)::INTEGER AS place FROM candidate WHERE confidence < 0.75::DOUBLE) WHERE place <= 8"))
def f7_model_worklist(spark, sf_dir):
    return V.model_worklist(B.candidate(spark, sf_dir)).select("job_id", "field_key", "ord", "confidence", "place")
