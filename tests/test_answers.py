"""Golden vectors of answer cleaning, from the rules' own words."""

import pytest
from pyspark.sql import functions as F

from quire.functions import answers as A

CASES = [
    ("patient_dob", "born 1/2/80 or 3/4/1981", "1/2/80"), ("auth_expiration_date", "1/2/2024 - 3/4/2024", "3/4/2024"), ("patient_dob", "no date", None),
    ("service_code", "(h2036), 99213; x", "H2036 99213"), ("provider_npi", "NPI 1234567893", "1234567893"), ("provider_npi", "12", None),
    ("provider_phone", "Phone: 866.577.2184", "(866) 577-2184"), ("provider_phone", "1-866-577-2184", "(866) 577-2184"), ("provider_phone", "5772184", None),
    ("prior_auth_number", "Ref # OP1234 pending", "OP1234"), ("prior_auth_number", "866-577-2184", None), ("prior_auth_number", "1-866-577-2184", None), ("prior_auth_number", "please call 123", None), ("prior_auth_number", "none", None),
    ("member_id", "#: YAW123 x", "YAW123"), ("member_id", "member 123", None), ("patient_name", "To: Doe, Jane 01/02/2024 fax", "Doe, Jane"), ("patient_name", "November 15, 2024", None), ("patient_name", "Acme LLC", None), ("patient_name", "Name: x", None),
    ("provider_name", "Company: Bright Path", "Bright Path"), ("provider_name", "example.com", None), ("provider_name", "Humana", None), ("diagnosis_code", "F32.1, j45", "F32.1 J45"), ("units_requested", "30 visits of 2", "30 2"), ("units_requested", "many", None),
    ("note", " fine ", "fine"), ("note", "please contact people regarding documents", None), ("note", "", None), ("note", None, None),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(CASES)], "i int, k string, v string")
    return {r["i"]: r["c"] for r in df.select("i", A.clean_answer(F.col("k"), F.col("v")).alias("c")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_clean_answer(cleaned, i):
    assert cleaned[i] == CASES[i][2], CASES[i]


def test_dob_from_review(spark):
    df = spark.createDataFrame([("1/2/1980",), ("1/2/2024",), (None,)], "v string")
    got = [r[0] is not None for r in df.select(A.dob_from_review(F.col("v"), F.lit("2024-06-30").cast("date"))).collect()]
    assert got == [True, False, False]
