"""Golden values of the scans that read missing fields from the text."""

from quire.operators import recovery as R

SCHEMA = f"job_id long, text string, scanned string, fields map<string, {R.FIELD}>, cleared_name {R.FIELD}"
field = lambda value=None, confidence=None, method=None, candidates=None: (value, confidence, method, candidates)
KNOWN = {"service_code": field("G0480"), "auth_effective_date": field("1/2/2024"), "auth_expiration_date": field("2/2/2024"), "units_requested": field("4"), "patient_name": field("Ann Lee")}


def found(spark, text, fields=None, cleared=None, scanned=None):
    df = spark.createDataFrame([(1, text, scanned, {**KNOWN, **(fields or {})}, cleared)], SCHEMA)
    return sorted((r.field_key, r.value, r.confidence, r.method, r.evidence) for r in R.recoveries(df).collect())


def test_service_codes(spark):
    gone = {"service_code": field("")}
    assert found(spark, "", gone, scanned="x G0480, H2036A G0480 éG0481 H0015 J1") == [("service_code", "G0480", 0.65, R.READ, "OCR scan: G0480 H2036A H0015")]
    assert found(spark, "", gone, scanned="g0480 GG0480 G04801") == []
    assert found(spark, "", None, scanned="H2036") == []


def test_dates(spark):
    open_end = {"auth_expiration_date": field(None)}
    text = "1/3/2024 - 1/9/2024 and 1-2-2024 –- 3/4/24, 1/2/2024-5/5/2025"
    assert found(spark, text, open_end) == [("auth_expiration_date", "3/4/24", 0.70, R.READ, "OCR range: 1-2-2024 –- 3/4/24")]
    assert found(spark, "1/3/2024 - 1/9/2024", open_end) == []
    none = {"auth_effective_date": field(""), **open_end}
    line = "SERVICE  Date: 06/07/2023 - 06/08/2023"
    assert found(spark, "x " + line, none) == [("auth_effective_date", "06/07/2023", 0.65, R.READ, "OCR: " + line), ("auth_expiration_date", "06/08/2023", 0.65, R.READ, "OCR: " + line)]
    assert [f[0] for f in found(spark, line, {"auth_effective_date": field(None)})] == ["auth_effective_date"]
    assert found(spark, line) == []


def test_units(spark):
    gone = {"units_requested": field(None)}
    for text, value in (("Visits approved: 12", "12"), ("unit requested 007", "007"), ("Units authorized:10000", None), ("units approved 0", None), ("units approved: 10000 visits approved: 3", None), ("units: 4", None)):
        assert [f[1] for f in found(spark, text, gone)] == ([value] if value else [])


def test_prior_auth_number(spark):
    bad = lambda v, *candidates, confidence=0.9, method="LAYOUTLM": {"prior_auth_number": field(v, confidence, method, list(candidates))}
    assert found(spark, "Reference # : AB12345") == []
    assert found(spark, "", bad("AB12345")) == [] and found(spark, "", bad("18-008-1")) == [] and found(spark, "", bad("18-008-1", confidence=0.3, method=R.READ)) == []
    assert found(spark, "", bad("A B")) == [("prior_auth_number", None, None, None, None)]
    assert found(spark, "Ref\nreference# ab12345 x", bad(None)) == [("prior_auth_number", "ab12345", 0.65, R.READ, "OCR: reference# ab12345")]
    some = [("A B C D", 0.9, "X"), ("1-23456", 0.9, "X"), (None, 0.9, "X"), (" OP999 ", 0.0, None), ("OP111", 0.8, "X")]
    assert found(spark, "Reference# ab12345", bad("18-008-1", *some, confidence=0.3)) == [("prior_auth_number", " OP999 ", 0.65, R.READ, None)]


def test_patient_name(spark):
    gone = {"patient_name": field(""), "provider_name": field("Oak Park Clinic, MD")}
    was = field("Oak Park", 0.9, "X", [("", 1.0, "X"), ("Oak Park", 1.0, "X"), ("PARK OAK", 1.0, "X"), (" Jo Day", 0.7, "Y"), ("Al Roe", 0.9, "X")])
    assert found(spark, "", gone, was) == [("patient_name", "Jo Day", 0.7, "Y", None)]
    line = "Member Name: MAY ANN, Requesting Provider: BOVA, DAWN"
    assert found(spark, "x\n  " + line + " \n", gone) == [("patient_name", "MAY ANN", 0.60, R.READ, "OCR: " + line)]
    assert [f[1] for f in found(spark, "member name 12\nMember Name: MAY ANN 3/1/90 x", gone)] == ["MAY ANN"]
    assert found(spark, "the Member Name: MAY", gone) == []
    assert found(spark, line) == []
    after = "for the following Member: \n  Jane Roe 3/1/90\nx"
    assert found(spark, after) == [("patient_name", "Jane Roe", 0.85, R.READ, "OCR: following member: Jane Roe")]
    assert [f[1] for f in found(spark, after.replace("Roe", "Roe,"))] == ["Jane Roe,"] and [f[1] for f in found(spark, "following member:\nJane Roe,,\n")] == ["Jane Roe"]
    assert found(spark, after, {"patient_name": field("JANE ROE")}) == []
    assert [f[1] for f in found(spark, line + "\n" + after, gone)] == ["Jane Roe"]


def test_empty(spark):
    assert found(spark, None, {"service_code": field(None)}) == []
    assert R.recoveries(spark.createDataFrame([], SCHEMA)).collect() == []
    null = spark.createDataFrame([(None, "Visits approved: 3", "H2036", None, None)], SCHEMA)
    assert [(r.job_id, r.value) for r in R.recoveries(null).collect()] == [(None, "H2036"), (None, "3")]
