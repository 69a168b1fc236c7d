"""Golden values of the type trim and of the token filters, and what runs on from a label."""

import pytest
from pyspark.sql import functions as F

from quire.functions import trim as T

TRIMMED = [
    ("prior_auth_number", "is#213403025", "213403025"), ("prior_auth_number", "UM84429804 0806WD89S Talbot", "UM84429804 0806WD89S"), ("prior_auth_number", "a b c d e f g", ""),
    ("prior_auth_number", "Authorization Number: OP0085373636", "OP0085373636"), ("reference_number", "no digits here", "no digits here"), ("prior_auth_number", "x # y", "x # y"),
    ("next_review_date", "Date Span: 1/2/2024 -- 2/3/2024", ""), ("auth_expiration_date", "1/2/2024 - 2/3/2024", "2/3/2024"), ("auth_effective_date", "from 2024-01-02 to 2024-03-04", "2024-01-02"), ("patient_dob", "DOB: 11/2/80 x", "11/2/80"), ("patient_dob", "none", "none"),
    ("member_id", "Member ID: H67649627", "H67649627"), ("member_id", "abc (82353822-01)", "82353822-01"), ("member_id", "abc def", "abc"), ("member_id", "", ""),
    ("service_code", "112036 x", "H2036"), ("cpt_code", "99213, H2034 level", "99213, H2034"), ("hcpc_code", "none at all", "none at all"), ("npi", "NPI 1234567890 x", "1234567890"), ("provider_npi", "12345", "12345"),
    ("patient_name", "06/29/1990 MILLERRIKKI", "MILLERRIKKI"), ("patient_name", "Brock Baker 09/10/1985 F", "Brock Baker"), ("patient_name", "[NICHOLAS LIMONGI", "NICHOLAS LIMONGI"), ("patient_name", "12345678 Ann Lee", "Ann Lee"), ("patient_name", "Dateofbirth", ""),
    ("provider_name", "Oak Clinic:.", "Oak Clinic"), ("provider_name", "Requesting Provider", ""), ("provider_name", "Facility Name:", ""), ("other", "as it is ", "as it is "), ("member_id", None, None),
]

FILTERED = [
    ("patient_dob", ["born", "1/2/80", "to"], ["1/2/80", "to"]), ("auth_effective_date", ["Authorized:8/16/2025-9/14/2025", "x"], ["8/16/2025-9/14/2025"]), ("next_review_date", ["on11/07/2024.", "2024-1-2 to 2024-3-4"], ["11/07/2024", "2024-1-2 to 2024-3-4"]),
    ("auth_expiration_date", ["from1/2/2024 until 3/4/2024 or5/6/2024"], ["1/2/2024-3/4/2024"]),
    ("member_id", ["H123456", "1/2/1980"], ["H123456"]), ("member_id", ["abcdef"], []), ("member_id", ["12"], []), ("member_id", ["next 12345"], []), ("member_id", ["1" * 31], []),
    ("provider_npi", ["1234567890", "123"], ["1234567890"]), ("prior_auth_number", ["OP12", "x"], ["OP12", "x"]), ("prior_auth_number", ["please"], []), ("prior_auth_number", ["Member DOB 1"], []),
    ("units_requested", ["15", "15"], ["15", "15"]), ("units_requested", ["fifteen"], []), ("units_requested", ["above 3"], []), ("diagnosis_code", ["F11.20", "f11", "x"], ["F11.20"]),
    ("service_code", ["(H0015", "TG)", "verylongword1"], ["(H0015"]), ("patient_name", ["SMITH"], ["SMITH"]), ("patient_name", ["Member:", "Ann"], []), ("patient_name", ["health", "risk"], []), ("patient_name", ["abcdefghij", "abcdefghij", "abcdefghij", "abcdefghij"], []),
    ("provider_name", ["Oak", "Clinic"], ["Oak", "Clinic"]), ("provider_name", ["Oak"], []), ("provider_name", ["Dear", "Sir"], []), ("provider_phone", ["x", "555-123-4567"], ["555-123-4567"]), ("provider_fax", ["555-123-4567 555-765-4321"], ["555-123-4567 55"]),
    ("other", ["x"], ["x"]), ("member_id", [], []),
]


def test_trimmed(spark):
    df = spark.createDataFrame(TRIMMED, "key string, value string, want string")
    assert [tuple(r) for r in df.select("key", "value", T.trimmed(F.col("key"), F.col("value"))).collect()] == TRIMMED


def test_filtered(spark):
    df = spark.createDataFrame([(k, [(x, 0.5) for x in xs]) for k, xs, _ in FILTERED], "key string, tokens array<struct<text:string,x0:double>>")
    got = [(r[0], [t["text"] for t in r[1]]) for r in df.select("key", T.filtered_by(F.col("key"), F.col("tokens"))).collect()]
    assert got == [(k, want) for k, _, want in FILTERED]


@pytest.mark.parametrize("token,label,want", [("DOB11/2/80", "DOB:", "11/2/80"), ("DateSpan08/25/2025", "datespan", "08/25/2025"), ("MemberD0B 01/09/1962", "Member DOB", None), ("D0B01/09/1962", "DOB", "01/09/1962"), ("DOB none", "DOB", None), ("x", "DOB", None)])
def test_after_label(spark, token, label, want):
    assert spark.range(1).select(T.after_label(F.lit(token), label)).first()[0] == want
