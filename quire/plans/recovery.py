"""Query of the recoveries, over texts and fields spelled from the orders' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import bindings as B
from quire.operators import recovery as R
from quire.plans.registry import query

_JOBS_SQL = r"""raw AS (SELECT o_orderkey AS k, (o_orderkey // 7 % 12 + 1) || '/' || (o_orderkey // 5 % 28 + 1) || '/' || (2000 + o_orderkey % 25) AS a,
  (o_orderkey // 3 % 12 + 1) || '/' || (o_orderkey % 28 + 1) || '/' || (2001 + o_orderkey % 25) AS z FROM orders),
job AS (SELECT k, a, z, 'to ' || 'G' || lpad((k * 7 % 10000)::VARCHAR, 4, '0') || ' x1, K' || lpad((k % 10000)::VARCHAR, 4, '0') || 'B and k' || k AS scanned,
  CASE k // 4 % 4 WHEN 0 THEN 'Service dates: ' || a || ' - ' || z WHEN 1 THEN z || '-' || a || '; ' || a || '--' || z WHEN 2 THEN 'Authorization Date ' || a || ' ' || z ELSE '' END || chr(10)
  || (['Visits approved: ', 'Units  Requested', 'unit authorized '])[k % 3 + 1] || (k % 12000) || chr(10) || CASE WHEN k // 2 % 3 = 0 THEN 'Reference # : R' || lpad((k % 100000)::VARCHAR, 5, '0') || chr(10) ELSE '' END
  || CASE k // 3 % 5 WHEN 0 THEN ' Member Name: DOE ' || chr(65 + (k % 26)::INTEGER) || ', Requesting Provider: X' WHEN 1 THEN 'the following member: ' || chr(10) || ' Jane Roe ' || a WHEN 2 THEN 'Member Name ' || k ELSE '' END AS text,
  CASE WHEN k // 8 % 2 = 0 THEN 'G0480' END AS code, CASE WHEN k // 16 % 3 > 0 THEN replace(a, '/', '-') ELSE '' END AS start, CASE WHEN k // 32 % 2 = 0 THEN z END AS stop,
  CASE WHEN k // 64 % 3 = 0 THEN '4' END AS units, CASE WHEN k // 128 % 2 = 0 THEN 'JANE ROE' END AS name, (['', 'A B', '18-008-1', 'AB12345', 'abc'])[k // 11 % 5 + 1] AS auth FROM raw)"""
_FOUND_SQL = r"""svc AS (SELECT *, regexp_extract_all(scanned, '\b([A-Z]\d{4}[A-Z]?)\b', 1) AS codes,
  regexp_extract(text, '(?i)(?:Service|Authorization)\s+dates?\s*:?\s*(\d{1,2}/\d{1,2}/\d{4})\s*[-–]+\s*(\d{1,2}/\d{1,2}/\d{4})', ['m1', 'm2']) AS dates,
  regexp_extract(text, '(?i)(?:Service|Authorization)\s+dates?\s*:?\s*(\d{1,2}/\d{1,2}/\d{4})\s*[-–]+\s*(\d{1,2}/\d{1,2}/\d{4})') AS dates_said,
  list_filter(regexp_extract_all(text, '\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\s*[-–]+\s*\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}'), lambda m: regexp_replace(regexp_extract(m, '^[\d/]+'), '\D', '', 'g') = regexp_replace(start, '\D', '', 'g'))[1] AS span,
  regexp_extract(text, '(?i)(?:units?|visits?)\s+(?:authorized|approved|requested)\s*:?\s*(\d+)') AS units_said, regexp_extract(text, '(?i)(?:units?|visits?)\s+(?:authorized|approved|requested)\s*:?\s*(\d+)', 1) AS units_read,
  regexp_extract(text, 'Reference # : R\d{5}') AS ref, regexp_extract(text, 'Member Name: DOE [A-Z].*') AS label FROM job)"""


@query(rf"""WITH {_JOBS_SQL}, {_FOUND_SQL}
SELECT k AS job_id, 'service_code' AS field_key, codes[1] AS value, 0.65::DOUBLE AS confidence, 'OCR scan: ' || codes[1] || CASE WHEN codes[2] <> codes[1] THEN ' ' || codes[2] ELSE '' END AS evidence FROM svc WHERE code IS NULL AND len(codes) > 0
UNION ALL SELECT k, 'auth_expiration_date', regexp_extract(span, '[\d/]+$'), 0.70, 'OCR range: ' || span FROM svc WHERE start <> '' AND stop IS NULL AND span IS NOT NULL
UNION ALL SELECT k, 'auth_effective_date', dates.m1, 0.65, 'OCR: ' || dates_said FROM svc WHERE start = '' AND dates_said <> ''
UNION ALL SELECT k, 'auth_expiration_date', dates.m2, 0.65, 'OCR: ' || dates_said FROM svc WHERE start = '' AND stop IS NULL AND dates_said <> ''
UNION ALL SELECT k, 'units_requested', units_read, 0.65, 'OCR: ' || units_said FROM svc WHERE units IS NULL AND units_read::BIGINT BETWEEN 1 AND 9999
UNION ALL SELECT k, 'prior_auth_number', CASE WHEN auth = 'abc' THEN 'OP' || lpad(k::VARCHAR, 9, '0') WHEN ref <> '' THEN right(ref, 6) END, CASE WHEN auth = 'abc' THEN 0.8 WHEN ref <> '' THEN 0.65 END, CASE WHEN auth <> 'abc' AND ref <> '' THEN 'OCR: ' || ref END FROM svc WHERE auth <> 'AB12345'
UNION ALL SELECT k, 'patient_name', 'Jane Roe', 0.85, 'OCR: following member: Jane Roe' FROM svc WHERE name IS NULL AND contains(text, 'following member')
UNION ALL SELECT k, 'patient_name', regexp_extract(label, 'DOE [A-Z]'), 0.60, 'OCR: ' || label FROM svc WHERE name IS NULL AND label <> ''""")
def h39_recoveries(spark, sf_dir):
    k, div = F.col("o_orderkey"), lambda n: F.expr(f"o_orderkey div {n}")
    date = lambda m, d, y: F.concat_ws("/", div(m) % 12 + 1, d % 28 + 1, k % 25 + y)
    raw = B.table(spark, sf_dir, "orders").select("o_orderkey", date(7, div(5), 2000).alias("a"), date(3, k, 2001).alias("z"))
    four = lambda n: F.lpad((n % 10000).cast("string"), 4, "0")
    which = lambda i, *texts: F.get(F.array(*(t if not isinstance(t, str) else F.lit(t) for t in texts)), i.cast("int"))
    dates = which(div(4) % 4, F.concat(F.lit("Service dates: "), "a", F.lit(" - "), "z"), F.concat("z", F.lit("-"), "a", F.lit("; "), "a", F.lit("--"), "z"), F.concat(F.lit("Authorization Date "), "a", F.lit(" "), "z"), "")
    units = F.concat(which(k % 3, "Visits approved: ", "Units  Requested", "unit authorized "), k % 12000)
    ref = F.when(div(2) % 3 == 0, F.concat(F.lit("Reference # : R"), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("\n"))).otherwise("")
    label = F.concat(F.lit(" Member Name: DOE "), F.chr(65 + k % 26), F.lit(", Requesting Provider: X"))
    name = which(div(3) % 5, label, F.concat(F.lit("the following member: \n Jane Roe "), "a"), F.concat(F.lit("Member Name "), k), "", "")
    none = F.array().cast(f"array<{R.CANDIDATE}>")

    def field(value, confidence=0.9, candidates=none):
        return F.struct(value.alias("value"), F.lit(confidence).alias("confidence"), F.lit("LAYOUTLM").alias("method"), candidates.alias("candidates")).cast(R.FIELD)

    auth = which(div(11) % 5, "", "A B", "18-008-1", "AB12345", "abc")
    other = F.struct(F.concat(F.lit("OP"), F.lpad(k.cast("string"), 9, "0")).alias("value"), F.lit(0.8).alias("confidence"), F.lit(R.READ).alias("method"))
    values = {
        "service_code": field(F.when(div(8) % 2 == 0, "G0480")), "auth_effective_date": field(F.when(div(16) % 3 > 0, F.replace("a", F.lit("/"), F.lit("-"))).otherwise("")),
        "auth_expiration_date": field(F.when(div(32) % 2 == 0, F.col("z"))), "units_requested": field(F.when(div(64) % 3 == 0, "4")), "patient_name": field(F.when(div(128) % 2 == 0, "JANE ROE")),
        "prior_auth_number": field(auth, 0.3, F.when(auth == "abc", F.array(other)).otherwise(none)),
    }
    jobs = raw.select(
        k.alias("job_id"), F.concat(dates, F.lit("\n"), units, F.lit("\n"), ref, name).alias("text"), F.concat(F.lit("to G"), four(k * 7), F.lit(" x1, K"), four(k), F.lit("B and k"), k).alias("scanned"),
        F.create_map(*(x for key, value in values.items() for x in (F.lit(key), value))).alias("fields"), F.lit(None).cast(R.FIELD).alias("cleared_name"),
    )
    return R.recoveries(jobs).drop("method")
