"""Queries of the scalar functions, over values spelled from the orders' keys, and over documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import bindings as B
from quire.bindings import with_sql
from quire.functions import dates, geometry as G, payer_rules as P, text as T, validators as V
from quire.operators import routing
from quire.plans.registry import query

_MONTHS = ("January", "Feb", "Mar", "April", "May", "June", "July", "Aug", "September", "Oct", "Nov", "December")

_RAW_SQL = """raw AS (SELECT k, kind, payer, CASE kind
  WHEN 'date' THEN CASE k % 7 WHEN 0 THEN m || '/' || d || '/' || y WHEN 1 THEN m || '-' || d || '-' || y WHEN 2 THEN y || '-' || m || '-' || d WHEN 3 THEN m || '/' || d || '/' || lpad((y % 100)::VARCHAR, 2, '0')
    WHEN 4 THEN 'on ' || m || '/' || d || '/' || lpad((y % 100)::VARCHAR, 2, '0') WHEN 5 THEN (['January', 'Feb', 'Mar', 'April', 'May', 'June', 'July', 'Aug', 'September', 'Oct', 'Nov', 'December'])[m] || ' ' || d || ', ' || y ELSE ' n/a ' END
  WHEN 'phone' THEN CASE WHEN k % 4 = 0 THEN '1-' ELSE '' END || lpad((k * 7919131 % 10000000000)::VARCHAR, CASE WHEN k % 5 = 0 THEN 9 ELSE 10 END, '5')
  WHEN 'ssn' THEN lpad((k * 104729 % 1000000000)::VARCHAR, 9, '0')
  WHEN 'member_id' THEN (['yaw', 'H-', ''])[k % 3 + 1] || ' ' || lpad((k * 15485863 % 1000000000)::VARCHAR, 9, '1') || '-x'
  WHEN 'npi' THEN lpad((k * 32452843 % 10000000000)::VARCHAR, 10, '1') ELSE '  two   words ' || k END AS value
  FROM (SELECT o_orderkey AS k, (['date', 'phone', 'ssn', 'member_id', 'npi', 'text'])[o_orderkey % 6 + 1] AS kind, (['ANTHEM', 'UNITED_HEALTH', 'MOLINA'])[o_orderkey // 6 % 3 + 1] AS payer,
    o_orderkey // 6 % 12 + 1 AS m, o_orderkey // 72 % 31 + 1 AS d, 1950 + o_orderkey % 81 AS y FROM orders))"""


def _raw(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda values, i: F.element_at(F.array(*(F.lit(v) for v in values)), i.cast("int"))
    o = B.table(spark, sf_dir, "orders").select(
        k.alias("k"), pick(("date", "phone", "ssn", "member_id", "npi", "text"), k % 6 + 1).alias("kind"), pick(("ANTHEM", "UNITED_HEALTH", "MOLINA"), F.expr("o_orderkey div 6 % 3 + 1")).alias("payer"),
        F.expr("o_orderkey div 6 % 12 + 1").alias("m"), F.expr("o_orderkey div 72 % 31 + 1").alias("d"), (1950 + k % 81).alias("y"),
    )
    k, m, d, y = (F.col(c) for c in ("k", "m", "d", "y"))
    short = F.lpad((y % 100).cast("string"), 2, "0")
    date = (
        F.when(k % 7 == 0, F.concat_ws("/", m, d, y)).when(k % 7 == 1, F.concat_ws("-", m, d, y)).when(k % 7 == 2, F.concat_ws("-", y, m, d)).when(k % 7 == 3, F.concat_ws("/", m, d, short))
        .when(k % 7 == 4, F.concat(F.lit("on "), F.concat_ws("/", m, d, short))).when(k % 7 == 5, F.concat(pick(_MONTHS, m), F.lit(" "), d, F.lit(", "), y)).otherwise(" n/a ")
    )
    tens = lambda by, power: (k * by % 10**power).cast("string")
    phone = F.concat(F.when(k % 4 == 0, "1-").otherwise(""), F.when(k % 5 == 0, F.lpad(tens(7919131, 10), 9, "5")).otherwise(F.lpad(tens(7919131, 10), 10, "5")))
    member = F.concat(pick(("yaw", "H-", ""), k % 3 + 1), F.lit(" "), F.lpad(tens(15485863, 9), 9, "1"), F.lit("-x"))
    value = (
        F.when(F.col("kind") == "date", date).when(F.col("kind") == "phone", phone).when(F.col("kind") == "ssn", F.lpad(tens(104729, 9), 9, "0"))
        .when(F.col("kind") == "member_id", member).when(F.col("kind") == "npi", F.lpad(tens(32452843, 10), 10, "1")).otherwise(F.concat(F.lit("  two   words "), k))
    )
    return o.select("k", "kind", "payer", value.alias("value"))


# The twin of the canonical forms. Whole dates first, then one found inside; both pivots.
_PARSED = """coalesce(CASE WHEN regexp_full_match(v, '\\d{1,2}/\\d{1,2}/\\d{4}') THEN try_strptime(v, '%m/%d/%Y') WHEN regexp_full_match(v, '\\d{1,2}-\\d{1,2}-\\d{4}') THEN try_strptime(v, '%m-%d-%Y')
  WHEN regexp_full_match(v, '\\d{4}-\\d{1,2}-\\d{1,2}') THEN try_strptime(v, '%Y-%m-%d') WHEN regexp_full_match(v, '\\d{1,2}/\\d{1,2}/\\d{2}') THEN try_strptime(v, '%m/%d/%y') END,
  try_strptime(v, '%B %d, %Y'), try_strptime(v, '%b %d, %Y'))""".replace("\\\\", "\\")
_INSIDE = r"try_strptime(regexp_extract(v, '(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})', 1) || '/' || regexp_extract(v, '(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})', 2) || '/' || CASE WHEN length(regexp_extract(v, '(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})', 3)) = 2 THEN CASE WHEN regexp_extract(v, '(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})', 3)::INTEGER < 50 THEN '20' ELSE '19' END ELSE '' END || regexp_extract(v, '(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})', 3), '%m/%d/%Y')"
_D = r"regexp_replace(v, '\D', '', 'g')"
_CANONICAL = rf"""CASE kind WHEN 'date' THEN coalesce(strftime({_PARSED}, '%Y-%m-%d'), strftime({_INSIDE}, '%Y-%m-%d'), v)
  WHEN 'phone' THEN CASE WHEN length({_D}) = 10 THEN '(' || {_D}[1:3] || ') ' || {_D}[4:6] || '-' || {_D}[7:10] WHEN length({_D}) = 11 AND {_D}[1] = '1' THEN '(' || {_D}[2:4] || ') ' || {_D}[5:7] || '-' || {_D}[8:11] ELSE v END
  WHEN 'ssn' THEN CASE WHEN length({_D}) = 9 THEN {_D}[1:3] || '-' || {_D}[4:5] || '-' || {_D}[6:9] ELSE v END
  WHEN 'npi' THEN CASE WHEN length({_D}) = 10 THEN {_D} ELSE v END
  WHEN 'member_id' THEN CASE WHEN payer = 'ANTHEM' AND regexp_matches(upper(regexp_replace(v, '[\s\-]', '', 'g')), '^[A-Z]{{3}}\d{{9,}}') THEN regexp_extract(upper(regexp_replace(v, '[\s\-]', '', 'g')), '^[A-Z]{{3}}\d{{9,}}') ELSE upper(regexp_replace(v, '[\s\-]', '', 'g')) END
  ELSE trim(regexp_replace(v, '\s+', ' ', 'g')) END"""


@query(f"WITH {_RAW_SQL}, t AS (SELECT *, trim(value) AS v FROM raw) SELECT k, kind, value, {_CANONICAL} AS canonical FROM t")
def h1_canonicalize(spark, sf_dir):
    return _raw(spark, sf_dir).select("k", "kind", "value", T.canonicalize(F.col("value"), F.col("kind"), F.col("payer")).alias("canonical"))


@query(f"WITH {_RAW_SQL}, t AS (SELECT *, trim(value) AS v FROM raw WHERE kind = 'date') SELECT k, value, strftime({_PARSED}, '%Y-%m-%d') AS parsed FROM t")
def h3_dates(spark, sf_dir):
    return _raw(spark, sf_dir).where("kind = 'date'").select("k", "value", F.date_format(dates.parsed(F.trim("value")), "yyyy-MM-dd").alias("parsed"))


@query(rf"WITH {_RAW_SQL}, t AS (SELECT *, trim(value) AS v FROM raw) SELECT regexp_replace(lower({_CANONICAL}), '[^a-z0-9]', '', 'g') AS key, count(*) AS n FROM t GROUP BY 1")
def h8_equivalence_classes(spark, sf_dir):
    key = T.comparison_key(F.col("value"), F.col("kind"), F.col("payer"))
    return _raw(spark, sf_dir).groupBy(key.alias("key")).agg(F.count("*").alias("n"))


_LUHN = "list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i % 2 = 0 THEN digits[i]::INTEGER ELSE CASE WHEN digits[i]::INTEGER * 2 > 9 THEN digits[i]::INTEGER * 2 - 9 ELSE digits[i]::INTEGER * 2 END END)) % 10 = 0"


@query(rf"WITH {_RAW_SQL} SELECT k, digits, {_LUHN} AS valid FROM (SELECT k, regexp_replace(value, '\D', '', 'g') AS digits FROM raw WHERE kind = 'npi')")
def h13_npi_luhn(spark, sf_dir):
    return _raw(spark, sf_dir).where("kind = 'npi'").select("k", T.digits(F.col("value")).alias("digits"), V.npi_ok(F.col("value")).alias("valid"))


_KEYS = {"date": "service_date", "phone": "provider_phone", "ssn": "member_ssn", "member_id": "member_id", "npi": "provider_npi", "text": "note"}
def _keyed(spark, sf_dir):
    key = F.lit(None).cast("string")
    for kind, name in _KEYS.items():
        key = F.when(F.col("kind") == kind, name).otherwise(key)
    return _raw(spark, sf_dir).withColumn("field_key", key)


_KEY_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KEYS.items()) + " END"


@query(rf"""WITH {_RAW_SQL}, t AS (SELECT *, trim(value) AS v, regexp_replace(value, '\D', '', 'g') AS digits FROM raw)
SELECT k, {_KEY_SQL} AS field_key, CASE kind WHEN 'date' THEN CASE WHEN coalesce({_PARSED} NOT BETWEEN DATE '1900-01-01' AND DATE '2029-12-31', true) THEN 'INVALID_DATE' ELSE '' END
  WHEN 'phone' THEN CASE WHEN length(digits) = 10 OR length(digits) = 11 AND digits[1] = '1' THEN '' ELSE 'INVALID_PHONE' END
  WHEN 'ssn' THEN CASE WHEN length(digits) = 9 AND digits[1:3] <> '000' AND digits[4:5] <> '00' AND digits[6:9] <> '0000' THEN '' ELSE 'INVALID_SSN' END
  WHEN 'npi' THEN CASE WHEN {_LUHN} THEN '' ELSE 'INVALID_NPI' END ELSE '' END AS errors FROM t""")
def h16_field_errors(spark, sf_dir):
    raw = _keyed(spark, sf_dir)
    return raw.select("k", "field_key", F.array_join(V.errors(F.col("field_key"), F.col("value"), F.lit("2024-06-30").cast("date")), ",").alias("errors"))


#: Rules of two payers, with every flag; the third has none.
_RULES = {
    "ANTHEM": {
        "field_validations": {"member_id": {"regex": "^[A-Z0-9]{8,14}$", "min_length": 8, "max_length": 14}, "service_date": {"format": "MM/DD/YYYY", "validate_not_future": True, "validate_after_effective": True}},
        "canonicalization": {"member_id": {"uppercase": True, "remove_spaces": True, "remove_dashes": True}, "dates": {"standard_format": "YYYY-MM-DD", "accept_formats": ["MM/DD/YYYY", "MM-DD-YYYY", "YYYY-MM-DD", "MM/DD/YY"]}},
    },
    "MOLINA": {
        "field_validations": {"provider_npi": {"regex": "[1-5]"}, "note": {"min_length": 18, "max_length": 19}},
        "canonicalization": {"note": {"trim": False, "lowercase": True, "remove_special": True}, "member_id": {"trim": True, "lowercase": True}},
    },
}
_AT = r"CASE WHEN regexp_full_match(value, '\d{1,2}/\d{1,2}/\d{4}') THEN try_strptime(value, '%m/%d/%Y') END"


@query(rf"""WITH {_RAW_SQL}, t AS (SELECT *, {_KEY_SQL} AS field_key, {_AT} AS day FROM raw)
SELECT k, field_key, CASE WHEN payer = 'ANTHEM' AND kind = 'member_id' THEN concat_ws(',', CASE WHEN NOT regexp_full_match(value, '[A-Z0-9]{{8,14}}') THEN 'PATTERN' END, CASE WHEN length(value) < 8 THEN 'TOO_SHORT' END, CASE WHEN length(value) > 14 THEN 'TOO_LONG' END)
  WHEN payer = 'ANTHEM' AND kind = 'date' THEN concat_ws(',', CASE WHEN day > DATE '2010-06-30' THEN 'IN_FUTURE' END, CASE WHEN day <= DATE '1980-01-31' THEN 'NOT_AFTER_EFFECTIVE' END)
  WHEN payer = 'MOLINA' AND kind = 'npi' AND value[1] NOT BETWEEN '1' AND '5' THEN 'PATTERN' WHEN payer = 'MOLINA' AND kind = 'text' AND length(value) < 18 THEN 'TOO_SHORT' WHEN payer = 'MOLINA' AND kind = 'text' AND length(value) > 19 THEN 'TOO_LONG' ELSE '' END AS errors FROM t""")
def h15_rule_errors(spark, sf_dir):
    raw = _keyed(spark, sf_dir)
    found = P.rule_errors(F.col("payer"), F.col("field_key"), F.col("value"), F.lit("1/31/1980"), F.lit("2010-06-30").cast("date"), _RULES)
    return raw.select("k", "field_key", F.array_join(found, ",").alias("errors"))


@query(rf"""WITH {_RAW_SQL}, t AS (SELECT *, {_KEY_SQL} AS field_key, trim(value) AS v FROM raw) SELECT k, field_key,
CASE WHEN payer = 'ANTHEM' AND kind = 'member_id' THEN upper(replace(replace(v, ' ', ''), '-', '')) WHEN payer = 'ANTHEM' AND kind = 'date' THEN coalesce(strftime(coalesce(
    CASE WHEN regexp_full_match(v, '\d{{1,2}}/\d{{1,2}}/\d{{4}}') THEN try_strptime(v, '%m/%d/%Y') END, CASE WHEN regexp_full_match(v, '\d{{1,2}}-\d{{1,2}}-\d{{4}}') THEN try_strptime(v, '%m-%d-%Y') END,
    CASE WHEN regexp_full_match(v, '\d{{4}}-\d{{1,2}}-\d{{1,2}}') THEN try_strptime(v, '%Y-%m-%d') END), '%Y-%m-%d'), v)
  WHEN payer = 'MOLINA' AND kind = 'text' THEN regexp_replace(lower(value), '[^a-z0-9]', '', 'g') WHEN payer = 'MOLINA' AND kind = 'member_id' THEN lower(v) ELSE v END AS canonical FROM t""")
def h9_rule_canonical(spark, sf_dir):
    raw = _keyed(spark, sf_dir)
    return raw.select("k", "field_key", P.rule_canonical(F.col("payer"), F.col("field_key"), F.col("value"), _RULES).alias("canonical"))


_PAIRS = "SELECT k, a.value AS one, b.value AS two FROM raw a JOIN raw b ON b.k = a.k + 6 WHERE a.kind = 'date' AND b.kind = 'date'"


def _date_pairs(spark, sf_dir):
    d = _raw(spark, sf_dir).where("kind = 'date'").select("k", "value")
    return d.join(d.select((F.col("k") - 6).alias("k"), F.col("value").alias("two")), "k").withColumnRenamed("value", "one")


@query(f"""WITH {_RAW_SQL}, p AS (SELECT a.k AS k, a.value AS one, b.value AS two FROM raw a JOIN raw b ON b.k = a.k + 6 WHERE a.kind = 'date' AND b.kind = 'date'),
q AS (SELECT k, one, two, (SELECT {_PARSED} FROM (SELECT trim(one) AS v)) AS a, (SELECT {_PARSED} FROM (SELECT trim(two) AS v)) AS b FROM p)
SELECT k, CASE WHEN b < a THEN 'ERROR' WHEN b = a THEN 'WARNING' ELSE '' END AS "order", CASE WHEN a >= DATE '1990-01-01' THEN 'ERROR' ELSE '' END AS dob FROM q""")
def h33_date_order(spark, sf_dir):
    p = _date_pairs(spark, sf_dir)
    return p.select("k", V.date_order(F.col("one"), F.col("two")).alias("order"), V.dob_in_past(F.col("one"), F.lit("1990-01-01").cast("date")).alias("dob"))


@query(r"""SELECT p_partkey, list_aggregate(list_filter(regexp_split_to_array(codes, '[,;\s]+'), lambda x: x <> '' AND NOT regexp_full_match(x, '(?i)[A-Z]\d{2}(\.\d{1,4})?')), 'string_agg', ',') AS bad
FROM (SELECT p_partkey, 'A' || p_partkey % 100 || 'B; J' || p_partkey % 1000 || '.' || p_size || ' x' || p_size AS codes FROM part)""")
def h36_diagnosis_codes(spark, sf_dir):
    k = F.col("p_partkey")
    codes = F.concat(F.lit("A"), k % 100, F.lit("B; J"), k % 1000, F.lit("."), F.col("p_size"), F.lit(" x"), F.col("p_size"))
    return B.table(spark, sf_dir, "part").select("p_partkey", F.array_join(V.bad_codes(codes, routing.DIAGNOSIS), ",").alias("bad"))


_BAD_SQL = "list_aggregate(list_filter(regexp_split_to_array(codes, '[,;\\s]+'), lambda x: x <> '' AND NOT regexp_full_match(x, '{}')), 'string_agg', ',')"


@query(rf"""SELECT p_partkey, coalesce({_BAD_SQL.format(r"(?i)[A-Z]\d{2}(\.\d{1,4})?")}, '') AS diagnosis, coalesce({_BAD_SQL.format(r"(?i)(\d{5}|[A-Z]\d{4})")}, '') AS procedure
FROM (SELECT p_partkey, 'f' || p_partkey % 100 || '.' || p_size || ';J' || p_partkey % 100 || 'B,' || chr(9) || 'G0' || p_partkey % 1000 || ' 9' || p_partkey % 10000 AS codes FROM part)""")
def h36_code_forms(spark, sf_dir):
    k = F.col("p_partkey")
    codes = F.concat(F.lit("f"), k % 100, F.lit("."), F.col("p_size"), F.lit(";J"), k % 100, F.lit("B,\tG0"), k % 1000, F.lit(" 9"), k % 10000)
    bad = lambda form: F.array_join(V.bad_codes(codes, form), ",")
    return B.table(spark, sf_dir, "part").select("p_partkey", bad(routing.DIAGNOSIS).alias("diagnosis"), bad(routing.PROCEDURE).alias("procedure"))


@query(r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g'))::BIGINT AS n, sha256(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g'))) AS sha FROM documents")
def h18_clean_text(spark, sf_dir):
    t = F.regexp_replace(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"\s+", " ")
    return B.table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.sha2(T.clean_ocr_text(F.col("text")), 256).alias("sha"))


@query("SELECT p_partkey, translate(lower(p_name || p_partkey), '01', 'ol') AS folded, translate(lower(p_name || p_partkey), '01', 'oi') AS seed FROM part")
def h19_ocr_fold(spark, sf_dir):
    v = F.concat("p_name", F.col("p_partkey").cast("string"))
    return B.table(spark, sf_dir, "part").select("p_partkey", T.ocr_fold(v).alias("folded"), T.ocr_fold(v, "i").alias("seed"))


@query("SELECT a.p_partkey, levenshtein(upper(a.p_name), upper(b.p_name))::INTEGER AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def h32_levenshtein(spark, sf_dir):
    p = B.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(q, "p_partkey").select("p_partkey", F.levenshtein(F.upper("p_name"), F.upper("other")).alias("distance"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def h42_sha256(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(with_sql("job", "SELECT job_id, (completed_s - started_s)::DOUBLE AS seconds FROM job WHERE completed_s IS NOT NULL"))
def h41_durations(spark, sf_dir):
    j = B.job(spark, sf_dir).where("completed_s IS NOT NULL")
    return j.select("job_id", (F.col("completed_s") - F.col("started_s")).cast("double").alias("seconds"))


@query(with_sql("ocr_token", """SELECT page_id, line_number, word_number, round((x1 - x0) * (y1 - y0), 6) AS area, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy,
  round(greatest(least(x1, 0.55::DOUBLE) - greatest(x0, 0.13::DOUBLE), 0) * greatest(least(y1, 0.51::DOUBLE) - greatest(y0, 0.1::DOUBLE), 0) / ((x1 - x0) * (y1 - y0)), 4) AS ratio FROM ocr_token"""))
def h46_boxes(spark, sf_dir):
    t = B.ocr_token(spark, sf_dir)
    box = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    roi = tuple(F.lit(x) for x in (0.13, 0.1, 0.55, 0.51))
    cx, cy = G.center(box)
    return t.select("page_id", "line_number", "word_number", F.round(G.area(*box), 6).alias("area"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"), F.round(G.overlap_ratio(box, roi), 4).alias("ratio"))


@query("SELECT regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g').lower() AS snake, n FROM (SELECT 'FaxOcr' || upper(r_name[1]) || lower(r_name[2:]) AS name, r_regionkey AS n FROM region)")
def h50_snake_case(spark, sf_dir):
    name = F.concat(F.lit("FaxOcr"), F.upper(F.substring("r_name", 1, 1)), F.lower(F.expr("substring(r_name, 2)")))
    return B.table(spark, sf_dir, "region").select(T.snake_case(name).alias("snake"), F.col("r_regionkey").alias("n"))
