"""Queries of the correction and confidence operators, over parts, line items and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import bindings as B
from quire.bindings import with_sql
from quire.operators import corrections as C
from quire.operators import views as V
from quire.plans.registry import query

# A job per part; every rule meets parts that it holds for and parts that it does not.
_VALUES = {
    "member_id": ("CASE WHEN k % 3 = 0 THEN '1234567' ELSE 'M' || k END", lambda k: F.when(k % 3 == 0, "1234567").otherwise(F.concat(F.lit("M"), k))),
    "patient_dob": ("CASE WHEN k % 5 = 0 THEN '1/2/2020' ELSE '1/2/19' || lpad((k % 90 + 10)::VARCHAR, 2, '0') END", lambda k: F.when(k % 5 == 0, "1/2/2020").otherwise(F.concat(F.lit("1/2/19"), F.lpad((k % 90 + 10).cast("string"), 2, "0")))),
    "auth_effective_date": ("CASE WHEN k % 4 = 0 THEN '1-2-19' || lpad((k % 90 + 10)::VARCHAR, 2, '0') ELSE '5/5/2024' END", lambda k: F.when(k % 4 == 0, F.concat(F.lit("1-2-19"), F.lpad((k % 90 + 10).cast("string"), 2, "0"))).otherwise("5/5/2024")),
    "auth_expiration_date": ("CASE WHEN k % 8 = 0 OR k % 7 = 0 THEN '1-2-19' || lpad((k % 90 + 10)::VARCHAR, 2, '0') ELSE '6/6/2024' END", lambda k: F.when((k % 8 == 0) | (k % 7 == 0), F.concat(F.lit("1-2-19"), F.lpad((k % 90 + 10).cast("string"), 2, "0"))).otherwise("6/6/2024")),
    "next_review_date": ("CASE WHEN k % 6 = 0 THEN '1.2.19' || lpad((k % 90 + 10)::VARCHAR, 2, '0') ELSE '7/7/2024' END", lambda k: F.when(k % 6 == 0, F.concat(F.lit("1.2.19"), F.lpad((k % 90 + 10).cast("string"), 2, "0"))).otherwise("7/7/2024")),
    "units_requested": ("CASE k % 4 WHEN 0 THEN '123 4567' WHEN 1 THEN '0' WHEN 2 THEN '12' ELSE '12 visits' END", lambda k: F.when(k % 4 == 0, "123 4567").when(k % 4 == 1, "0").when(k % 4 == 2, "12").otherwise("12 visits")),
    "patient_name": ("CASE WHEN k % 2 = 0 THEN 'red, widget' ELSE 'Ann' END", lambda k: F.when(k % 2 == 0, "red, widget").otherwise("Ann")),
    "provider_name": ("name", lambda k: F.col("name")),
    "note": ("'n' || k", lambda k: F.concat(F.lit("n"), k)),
}
_METHOD = "CASE (k + i) % 3 WHEN 0 THEN 'TEMPLATE_OCR' WHEN 1 THEN 'LAYOUTLM' ELSE 'VLM' END"
_LONG = " UNION ALL ".join(f"SELECT k AS job_id, '{n}' AS field_key, {sql} AS value, 0.5::DOUBLE AS confidence, {_METHOD.replace('i)', f'{i})')} AS method FROM p" for i, (n, (sql, _)) in enumerate(_VALUES.items()))
_ND = lambda c: f"regexp_replace(coalesce({c}, ''), '\\D', '', 'g')"
_SAME = lambda a, b: f"coalesce({a}.value, '') <> '' AND coalesce({b}.value, '') <> '' AND {_ND(a + '.value')} = {_ND(b + '.value')}"
_NW = lambda c: f"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z]', ' ', 'g'), '\\s+'), lambda x: x <> '')"
_I5 = f"""WITH p AS (SELECT p_partkey AS k, p_name AS name FROM part), f AS ({_LONG}),
w0 AS (SELECT job_id, {', '.join(f"max(struct_pack(value := value, confidence := confidence, method := method)) FILTER (field_key = '{k}') AS {k}" for k in C.KEYS)} FROM f GROUP BY 1),
w1 AS (SELECT * REPLACE (CASE WHEN replace(units_requested.value, ' ', '') = member_id.value AND length(replace(units_requested.value, ' ', '')) >= 6 THEN NULL ELSE units_requested END AS units_requested, CASE WHEN {_SAME('next_review_date', 'patient_dob')} THEN NULL ELSE next_review_date END AS next_review_date) FROM w0),
w2 AS (SELECT *, auth_effective_date.value = auth_expiration_date.value AND auth_effective_date.method NOT IN ('TEMPLATE_OCR', 'HYBRID') AND auth_expiration_date.method NOT IN ('TEMPLATE_OCR', 'HYBRID') AND (({_SAME('auth_effective_date', 'patient_dob')}) OR ({_SAME('auth_effective_date', 'next_review_date')})) AS hit FROM w1),
w3 AS (SELECT * REPLACE (CASE WHEN hit THEN NULL ELSE auth_effective_date END AS auth_effective_date, CASE WHEN hit THEN NULL ELSE auth_expiration_date END AS auth_expiration_date) FROM w2),
w4 AS (SELECT * REPLACE (CASE WHEN {_SAME('auth_expiration_date', 'patient_dob')} THEN CASE WHEN job_id % 2 = 0 THEN struct_pack(value := '8/8/2024', confidence := 0.70::DOUBLE, method := 'VLM') END ELSE auth_expiration_date END AS auth_expiration_date, CASE WHEN {_SAME('auth_effective_date', 'patient_dob')} THEN NULL ELSE auth_effective_date END AS auth_effective_date) FROM w3),
w5 AS (SELECT * REPLACE (CASE WHEN regexp_extract(patient_dob.value, '(20\\d{{2}})', 1) > '2015' THEN NULL ELSE patient_dob END AS patient_dob, CASE WHEN regexp_full_match(units_requested.value, '\\d{{1,4}}') AND units_requested.value <> '0' THEN units_requested END AS units_requested,
  CASE WHEN len(list_filter({_NW('patient_name.value')}, lambda x: NOT list_contains({_NW('provider_name.value')}, x))) = 0 AND patient_name.method <> 'TEMPLATE_OCR' THEN NULL ELSE patient_name END AS patient_name) FROM w4),
w6 AS (SELECT * REPLACE (CASE WHEN job_id % 3 = 0 AND patient_name.method = 'LAYOUTLM' THEN struct_pack(value := 'Bob', confidence := 0.9::DOUBLE, method := 'TEMPLATE_OCR') ELSE patient_name END AS patient_name) FROM w5)
SELECT job_id, field_key, x.value AS value, x.confidence AS confidence, x.method AS method FROM ({' UNION ALL '.join(f"SELECT job_id, '{k}' AS field_key, {k} AS x FROM w6" for k in C.KEYS)}) WHERE x IS NOT NULL
UNION ALL SELECT * FROM f WHERE field_key = 'note'"""


@query(_I5)
def i5_corrections(spark, sf_dir):
    p = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    k = F.col("k")
    method = lambda i: F.when((k + i) % 3 == 0, "TEMPLATE_OCR").when((k + i) % 3 == 1, "LAYOUTLM").otherwise("VLM")
    items = F.array(*(F.struct(F.lit(n).alias("field_key"), f(k).cast("string").alias("value"), method(i).alias("method")) for i, (n, (_, f)) in enumerate(_VALUES.items())))
    fields = p.select("k", F.explode(items).alias("x")).select(F.col("k").alias("job_id"), "x.field_key", "x.value", F.lit(0.5).alias("confidence"), "x.method")
    alt = lambda key, ord_, value, conf, how: p.select(k.alias("job_id"), F.lit(key).alias("field_key"), F.lit(ord_).alias("ord"), value.alias("value"), F.lit(conf).alias("confidence"), F.lit(how).alias("method"))
    again = F.concat(F.lit("1/2/19"), F.lpad((k % 90 + 10).cast("string"), 2, "0"))
    candidates = alt("auth_expiration_date", 0, again, 0.9, "LAYOUTLM").unionByName(alt("auth_expiration_date", 1, F.when(k % 2 == 0, "8/8/2024"), 0.0, "VLM")).unionByName(alt("patient_name", 0, F.lit("Bob"), 0.9, "TEMPLATE_OCR"))
    candidates = candidates.where(~((F.col("field_key") == "auth_expiration_date") & (F.col("ord") == 0) & (F.col("job_id") % 5 == 0)))
    return C.corrected(fields, candidates, p.where("k % 3 = 0").select(k.alias("job_id")))


@query("""WITH a AS (SELECT l_orderkey AS job_id, l_quantity / 55.0::DOUBLE AS m, l_linestatus = 'O' AS payer, l_discount * 10 AS s, l_tax * 5 AS d FROM lineitem),
g AS (SELECT job_id, max(m) AS m, bool_and(payer) AS payer, count(*) FILTER (s >= 0.5::DOUBLE AND d < 0.20::DOUBLE) AS found, count(*) AS total FROM a GROUP BY 1)
SELECT job_id, CASE WHEN m >= 0.85::DOUBLE AND payer THEN 1.0 ELSE round(found / total, 4) END AS anchor_score, (m >= 0.85::DOUBLE AND payer) OR (payer AND found / total >= 0.25::DOUBLE) AS verified FROM g""")
def i17_template_verification(spark, sf_dir):
    i = B.table(spark, sf_dir, "lineitem")
    a = i.select(F.col("l_orderkey").alias("job_id"), (F.col("l_quantity") / 55.0).alias("match_score"), (F.col("l_linestatus") == "O").alias("payer_match"), (F.col("l_discount") * 10).alias("label_score"), (F.col("l_tax") * 5).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("roi_cx"), F.lit(0.0).alias("roi_cy"))
    return C.anchor_verdict(a)


@query("""SELECT p_partkey, round(greatest(0.30::DOUBLE, least(1.0, m + CASE WHEN p_partkey % 2 = 0 THEN 0.05::DOUBLE ELSE 0.0 END + CASE WHEN d < 0.10::DOUBLE THEN 0.05::DOUBLE WHEN d > 0.30::DOUBLE THEN -0.10::DOUBLE ELSE 0.0 END)), 6) AS template, round(greatest(0.40::DOUBLE, m - 0.10::DOUBLE), 6) AS label,
round(greatest(0.10::DOUBLE, least(0.98::DOUBLE, m * 0.60::DOUBLE + d * 0.40::DOUBLE)), 6) AS model FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS m, (p_partkey % 47) / 100.0::DOUBLE AS d FROM part)""")
def i18_confidences(spark, sf_dir):
    m, d = F.col("p_size") / 50.0, F.col("p_partkey") % 47 / 100.0
    p = B.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(C.extraction_confidence(m, F.col("p_partkey") % 2 == 0, d), 6).alias("template"), F.round(C.label_confidence(m), 6).alias("label"), F.round(C.blended(m, d), 6).alias("model"))


@query("""SELECT p_brand AS field_key, arg_min(p_name, struct_pack(a := -s, b := p_name)) AS answer, max(s) AS score FROM (SELECT p_brand, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name, p_size / 50.0::DOUBLE AS s FROM part WHERE p_size / 50.0::DOUBLE >= 0.1::DOUBLE) GROUP BY p_brand, lower(p_name)""")
def i23_best_answers(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    a = p.select(F.col("p_brand").alias("field_key"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("answer"), (F.col("p_size") / 50.0).alias("score"))
    return C.best_answers(a, 0.1)


@query(with_sql("ocr_token", """SELECT page_id, greatest(min(x0) - 0.01::DOUBLE, 0.0) AS x0, greatest(min(y0) - 0.01::DOUBLE, 0.0) AS y0, least(max(x1) + 0.01::DOUBLE, 1.0) AS x1, least(max(y1) + 0.01::DOUBLE, 1.0) AS y1, round(avg(confidence), 6) AS confidence FROM ocr_token WHERE lower(token_text) = 'the' GROUP BY 1"""))
def i25_roi_suggestion(spark, sf_dir):
    return C.suggested_roi(B.ocr_token(spark, sf_dir).where(F.lower("token_text") == "the"))


@query("SELECT s_nationkey, count(*) AS templates, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL")
def c5_template_lookup(spark, sf_dir):
    s, n = B.table(spark, sf_dir, "supplier"), B.table(spark, sf_dir, "nation")
    return V.with_parent(s, n, "s_nationkey", "n_nationkey").groupBy("s_nationkey", "n_name").agg(F.count("*").alias("templates"))


@query("SELECT doc_id, len(list_distinct(list_transform(string_split(lang || ',' || upper(lang) || ',' || source, ','), lambda x: lower(x))))::INTEGER AS aliases FROM documents")
def g4_alias_union(spark, sf_dir):
    both = V.alias_union(F.array("lang"), F.array(F.upper("lang"), "source"))
    return B.table(spark, sf_dir, "documents").select("doc_id", F.size(both).alias("aliases"))


@query(with_sql("ocr_token", "SELECT page_id, line_number, min(word_number) AS first_word, count(*) AS n FROM ocr_token WHERE ends_with(token_text, ':') OR lower(token_text) IN ('the', 'and', 'license') GROUP BY ALL"))
def h26_label_lines(spark, sf_dir):
    return V.label_lines(B.ocr_token(spark, sf_dir), ("the", "and", "license"))


