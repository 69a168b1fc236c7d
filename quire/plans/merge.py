"""Queries of classification, merging, scoring and routing, over line items as candidates and documents as texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import bindings as B, rules as R
from quire.bindings import with_sql
from quire.functions import classify as C
from quire.operators import merge as M
from quire.plans.registry import query

# The domain's own words do not occur in the stand-in texts, so these tables hold words that do.
SIGNATURES = {"FIRST": (("license", "with from"), ("the", "and", "que", "der"), ("apache",)), "SECOND": (("| ",), ("les", "una", "und"), ()), "THIRD": ((), ("token", "@", "version", "re the"), ("mit",))}
PATTERNS = {"A": ((r"license", r"\d{4}\s\d"), (r"the\s+and", r"que"), (r"apache",)), "B": ((r"\|",), (r"un[ad]\s", r"\sder\s"), ()), "C": ((r"@\w+",), (r"\d{2,}", r"re\s+the"), (r"\smit\s",))}


def _payer_sql(least: float, none: str, signatures=SIGNATURES) -> str:
    def one(name):
        primary, secondary, negative = signatures[name]
        has = lambda ks: " OR ".join(f"contains(t, '{k}')" for k in ks) or "false"
        hits = " + ".join(f"contains(t, '{k}')::INTEGER" for k in secondary) or "0"
        return f"round(CASE WHEN {has(negative)} THEN 0.0 ELSE CASE WHEN {has(primary)} THEN 0.65::DOUBLE ELSE 0.0 END + least(({hits}) * 0.10::DOUBLE, 0.30::DOUBLE) END, 4)"

    cols = ", ".join(f"{one(n)} AS s{i}" for i, n in enumerate(signatures))
    pick = " ".join(f"WHEN s{i} = top THEN '{n}'" for i, n in enumerate(signatures))
    return f"SELECT doc_id, CASE WHEN NOT (top > 0 AND top >= {least}) THEN {none} {pick} END AS payer, CASE WHEN top > 0 AND top >= {least} THEN top ELSE 0.0 END AS score FROM (SELECT *, greatest(s0, s1, s2, 0.0) AS top FROM (SELECT doc_id, {cols} FROM (SELECT doc_id, lower(text) AS t FROM documents)))"


@query(_payer_sql(0.0, "'UNKNOWN'"))
def h28_payer(spark, sf_dir):
    name, score = C.payer(F.col("text"), SIGNATURES)
    return B.table(spark, sf_dir, "documents").select("doc_id", name.alias("payer"), score.alias("score"))


@query(_payer_sql(0.3, "NULL"))
def h29_page_payer(spark, sf_dir):
    name, score = C.page_payer(F.col("text"), SIGNATURES)
    return B.table(spark, sf_dir, "documents").select("doc_id", name.alias("payer"), score.alias("score"))


def _doc_type_sql() -> str:
    hit = lambda p: f"regexp_matches(text, '(?i){p}')"

    def one(name):
        strong, weak, negative = PATTERNS[name]
        count = lambda ps: " + ".join(f"{hit(p)}::INTEGER" for p in ps) or "0"
        no = " OR ".join(hit(p) for p in negative) or "false"
        return f"round(CASE WHEN {no} THEN 0.0 ELSE CASE WHEN {count(strong)} > 0 THEN 0.50::DOUBLE + least(({count(strong)}) * 0.12::DOUBLE, 0.35::DOUBLE) ELSE 0.0 END + least(({count(weak)}) * 0.05::DOUBLE, 0.15::DOUBLE) END, 4)"

    cols = ", ".join(f"{one(n)} AS s{i}" for i, n in enumerate(PATTERNS))
    pick = " ".join(f"WHEN s{i} = top THEN '{n}'" for i, n in enumerate(PATTERNS))
    return f"SELECT doc_id, CASE WHEN NOT top > 0 THEN 'OTHER' {pick} END AS doc_type, top AS score FROM (SELECT *, greatest(s0, s1, s2, 0.0) AS top FROM (SELECT doc_id, {cols} FROM documents))"


@query(_doc_type_sql())
def h31_doc_type(spark, sf_dir):
    name, score = C.doc_type(F.col("text"), PATTERNS)
    return B.table(spark, sf_dir, "documents").select("doc_id", name.alias("doc_type"), score.alias("score"))


@query("SELECT doc_id, (contains(lower(text), 'license')::INTEGER + contains(lower(text), 'the')::INTEGER + contains(lower(text), 'and')::INTEGER) >= 2 AS cover FROM documents")
def h30_cover(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", C.is_cover(F.col("text"), ("license", "the", "and")).alias("cover"))


@query(r"""SELECT doc_id, (CASE WHEN regexp_matches(text, '(?i)the') THEN 0.5::DOUBLE ELSE 0.0 END + CASE WHEN regexp_matches(text, '(?i)\d{3}') THEN 1.0 ELSE 0.0 END + CASE WHEN regexp_matches(text, '(?i)und') THEN 0.75::DOUBLE ELSE 0.0 END) >= 1.25 AND NOT regexp_matches(text, '(?i)license') AS cover FROM documents""")
def h27_cover_score(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", C.cover_score(F.col("text"), {"the": 0.5, r"\d{3}": 1.0, "und": 0.75}, "license", 1.25).alias("cover"))


_NO_PENALTY = """CASE WHEN value = '' THEN 0.25::DOUBLE WHEN field_key = 'units_requested' THEN 0.25::DOUBLE ELSE 0.0 END"""  # the stand-in values are one word or empty
_SCORED = f"""scored AS (SELECT *, round(confidence + CASE WHEN method = 'TEMPLATE_OCR' THEN CASE WHEN {_NO_PENALTY} = 0 THEN 0.10::DOUBLE ELSE -({_NO_PENALTY}) END WHEN method IN ('LAYOUTLM', 'VLM') THEN 0.10::DOUBLE * 0.70::DOUBLE ELSE 0.0 END
  + CASE WHEN agree > 1 THEN least(0.20::DOUBLE * (agree - 1), 0.40::DOUBLE) WHEN n > 1 THEN -0.10::DOUBLE ELSE 0.0 END, 6) AS score FROM (SELECT *, count(*) OVER (PARTITION BY job_id, field_key) AS n, count(*) OVER (PARTITION BY job_id, field_key, lower(trim(value))) AS agree FROM candidate))"""
_BUILT = f"""{_SCORED}, best AS (SELECT *, greatest(least(score, 1.0), 0.0) AS c FROM scored QUALIFY row_number() OVER (PARTITION BY job_id, field_key ORDER BY score DESC, ord) = 1),
built AS (SELECT job_id, field_key, CASE WHEN NOT (c < 0.30::DOUBLE OR trim(value) = '') THEN value END AS value, round(c, 6) AS confidence, CASE WHEN c < 0.30::DOUBLE OR trim(value) = '' THEN 'NOT_PRESENT' WHEN n > 1 THEN 'HYBRID' ELSE method END AS method, n AS n_candidates FROM best)"""


@query(with_sql("candidate", f"WITH {_SCORED} SELECT job_id, field_key, ord, score FROM scored"))
def i2_candidate_scores(spark, sf_dir):
    return M.scored(B.candidate(spark, sf_dir)).select("job_id", "field_key", "ord", "score")


@query(with_sql("candidate", f"WITH {_BUILT} SELECT * FROM built"))
def i3_field_build(spark, sf_dir):
    return M.built(B.candidate(spark, sf_dir))


@query(with_sql("candidate", f"""WITH {_BUILT} SELECT * FROM built UNION ALL SELECT job_id, 'decision', CASE WHEN job_id % 2 = 0 THEN 'APPROVED' ELSE 'DENIED' END, greatest(0.80::DOUBLE, round(overall_conf, 6)), 'CLASSIFIER', 1
FROM (SELECT o_orderkey AS job_id, o_totalprice % 1000 / 1000 AS overall_conf FROM orders) WHERE job_id NOT IN (SELECT job_id FROM built WHERE field_key = 'decision')"""))
def i6_decision_injection(spark, sf_dir):
    jobs = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 2 == 0, "APPROVED").otherwise("DENIED").alias("decision"), F.round(F.col("o_totalprice") % 1000 / 1000, 6).alias("doc_conf"))
    return M.with_decision(M.built(B.candidate(spark, sf_dir)), jobs)


def _scores(spark, sf_dir):
    c = B.candidate(spark, sf_dir, by_job=True)
    values = c.groupBy("job_id", "field_key").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.trim("value") != "", F.lower(F.trim("value")))).alias("different"))
    passed = c.groupBy("job_id", "field_key").agg(F.min("validation_passed").alias("passed"))
    return M.overall(M.built(c), values, passed)


_CRITICAL = "('" + "', '".join(R.SCORER_CRITICAL) + "')"
_OVERALL = f"""{_BUILT}, v AS (SELECT job_id, field_key, count(*) AS n, count(DISTINCT CASE WHEN trim(value) <> '' THEN lower(trim(value)) END) AS different, bool_and(validation_passed) AS passed FROM candidate GROUP BY ALL),
f AS (SELECT job_id, field_key, round(greatest(least(confidence - CASE WHEN NOT passed THEN 0.05::DOUBLE ELSE 0.0 END + CASE WHEN v.n >= 2 AND different <= 1 THEN 0.10::DOUBLE ELSE 0.0 END, 1.0), 0.0), 6) AS w, CASE WHEN field_key IN {_CRITICAL} THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
  field_key IN {_CRITICAL} AS critical, NOT passed AS failed, value IS NULL OR value = '' AS blank FROM built JOIN v USING (job_id, field_key)),
g AS (SELECT job_id, sum(round(w * 1e6)::BIGINT * weight::BIGINT) FILTER (NOT blank) AS sum_w, sum(weight) FILTER (NOT blank) AS sum_weight, count(*) FILTER (NOT blank AND critical) AS have, coalesce(bool_or(critical AND failed AND w < 0.85::DOUBLE) FILTER (NOT blank), false) AS bad_critical,
  coalesce(bool_or(critical AND w < 0.50::DOUBLE) FILTER (NOT blank), false) AS low_critical, coalesce(bool_or(failed) FILTER (NOT blank), false) AS any_failed FROM f GROUP BY 1),
overall AS (SELECT job_id, round(greatest(least(coalesce(sum_w / sum_weight / 1e6, 0.0) - 0.05::DOUBLE * (5 - have) + 1e-9, 1.0), 0.0), 4) AS overall, (5 - have)::BIGINT AS missing_critical, bad_critical, low_critical, any_failed FROM g)"""


@query(with_sql("candidate", f"""WITH {_OVERALL} SELECT job_id, overall, missing_critical, overall < 0.70::DOUBLE OR missing_critical > 0 OR bad_critical OR low_critical AS needs_review,
concat_ws(',', CASE WHEN overall < 0.70::DOUBLE THEN 'LOW_CONFIDENCE' END, CASE WHEN missing_critical > 0 THEN 'MISSING_CRITICAL_FIELDS' END, CASE WHEN any_failed THEN 'VALIDATION_FAILED' END, CASE WHEN low_critical THEN 'LOW_CONF_CRITICAL' END) AS reasons FROM overall"""))
def i7_overall_score(spark, sf_dir):
    r = M.routed(_scores(spark, sf_dir))
    return r.select("job_id", "overall", "missing_critical", "needs_review", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT p_partkey, round(least(CASE WHEN b < 100 THEN (1 - b / 100) * 0.04::DOUBLE ELSE 0.0 END + CASE WHEN d < 0.02::DOUBLE THEN 0.024::DOUBLE ELSE 0.0 END + CASE WHEN c < 0.80::DOUBLE THEN least(0.5 * (0.80::DOUBLE - c), 0.04::DOUBLE) ELSE 0.0 END, 0.08::DOUBLE), 6) AS penalty
FROM (SELECT p_partkey, (p_partkey % 200)::DOUBLE AS b, p_size / 1000.0::DOUBLE AS d, (p_partkey % 11) / 10.0::DOUBLE AS c FROM part)""")
def i8_quality_penalty(spark, sf_dir):
    k = F.col("p_partkey")
    return B.table(spark, sf_dir, "part").select("p_partkey", F.round(M.quality_penalty((k % 200).cast("double"), F.col("p_size") / 1000.0, k % 11 / 10.0), 6).alias("penalty"))


_REVIEW = "('" + "', '".join(R.REVIEW_CRITICAL) + "')"


@query(with_sql("candidate", f"""WITH {_BUILT} SELECT job_id, field_key, reason, threshold, confidence, row_number() OVER (PARTITION BY job_id ORDER BY critical DESC, confidence, field_key)::INTEGER AS place FROM (
SELECT job_id, field_key, confidence, coalesce(trim(value), '') = '' AS blank, CASE WHEN coalesce(trim(value), '') = '' THEN 'MISSING_VALUE' ELSE 'LOW_CONFIDENCE' END AS reason, CASE WHEN field_key IN {_REVIEW} THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END AS threshold, field_key IN {_REVIEW} AS critical FROM built) WHERE blank OR confidence < threshold"""))
def i12_review_flags(spark, sf_dir):
    return M.review_flags(M.built(B.candidate(spark, sf_dir))).drop("critical")


@query(with_sql("candidate", f"""WITH {_BUILT}, c AS (SELECT event_id AS job_id, 'decision' AS field_key, 'v' || user_id % 5 AS new FROM events WHERE event_type = 'error')
SELECT job_id, field_key, coalesce(new, value) AS value, CASE WHEN new IS NOT NULL THEN 1.0 ELSE confidence END AS confidence, CASE WHEN new IS NOT NULL THEN 'HUMAN_REVIEW' ELSE method END AS method, CASE WHEN new IS NOT NULL AND value IS DISTINCT FROM new THEN value END AS previous FROM built LEFT JOIN c USING (job_id, field_key)"""))
def i14_apply_corrections(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").where("event_type = 'error'")
    c = e.select(F.col("event_id").alias("job_id"), F.lit("decision").alias("field_key"), F.concat(F.lit("v"), F.col("user_id") % 5).alias("corrected_value"))
    return M.apply_corrections(M.built(B.candidate(spark, sf_dir)), c)


@query(with_sql("candidate", f"""SELECT job_id, field_key, template, model FROM (SELECT job_id, field_key, arg_min(value, ord) FILTER (method = 'TEMPLATE_OCR') AS template, arg_min(value, ord) FILTER (method = 'LAYOUTLM') AS model
FROM candidate WHERE field_key IN {_CRITICAL} AND trim(value) <> '' GROUP BY ALL) WHERE template IS NOT NULL AND model IS NOT NULL AND regexp_replace(lower(template), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(model), '[^a-z0-9]', '', 'g')"""))
def i11_critical_disagreements(spark, sf_dir):
    return M.critical_disagreements(B.candidate(spark, sf_dir))


@query(with_sql("candidate", """WITH m AS (SELECT *, method = 'LAYOUTLM' AND value <> '' AS model FROM candidate), d AS (SELECT job_id, trim(value) AS v FROM m WHERE model AND field_key = 'patient_dob' GROUP BY ALL HAVING count(*) >= 3)
SELECT job_id, field_key, ord, CASE WHEN model AND field_key = 'patient_dob' AND d.v IS NOT NULL THEN 0.10::DOUBLE ELSE confidence END AS confidence FROM m LEFT JOIN d USING (job_id) WHERE d.v IS NULL OR d.v = trim(value)
UNION ALL SELECT job_id, field_key, ord, confidence FROM m JOIN d USING (job_id) WHERE d.v <> trim(value)"""))
def i1_prescreen(spark, sf_dir):
    return M.prescreen(B.candidate(spark, sf_dir)).select("job_id", "field_key", "ord", "confidence")
