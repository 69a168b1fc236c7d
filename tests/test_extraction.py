"""Values next to labels: inside the label's token, right of it, below it, from the page with the most labels, and by regions."""

import pytest

from quire.operators import extraction as E

SCHEMA = "job_id long, page_number int, page_id long, line_number int, word_number int, token_text string, x0 double, y0 double, x1 double, y1 double, confidence double"
ALIASES = [("member_id", "Member ID"), ("patient_name", "Patient Name"), ("patient_dob", "Date of Birth"), ("units_requested", "Units Requested"), ("service_code", "CPT Code"), ("prior_auth_number", "Auth #"), ("note", "note")]


def page(job, number, lines, confidence=0.9):
    """Tokens of lines of (text, x0) pairs; a token is as wide as its text."""
    out = []
    for n, line in enumerate(lines):
        for k, (text, x) in enumerate(line):
            out.append((job, number, job * 100 + number, n, k, text, x, 0.05 * n, x + 0.01 * len(text), 0.05 * n + 0.015, confidence))
    return out


FORM = [
    [("Member", 0.1), ("ID:", 0.17), ("AB12345", 0.3)],
    [("Patient", 0.1), ("Name", 0.18), ("Ann", 0.3), ("Lee", 0.35), ("Total:", 0.4)],
    [("Date", 0.1), ("of", 0.15), ("Birth", 0.18), ("CPT", 0.6), ("Code", 0.64)],
    [("01/02/1980", 0.12), ("112036", 0.6), ("G0480,", 0.68)],
    [("Units", 0.1), ("Requested", 0.16), ("30", 0.3), ("30", 0.33)],
    [("Auth#:", 0.1), ("Q77-1", 0.2), ("far", 0.6)],
]


@pytest.fixture(scope="module")
def tokens(spark):
    rows = page(1, 1, [[("fax", 0.1), ("cover", 0.2), ("Member", 0.3), ("ID:", 0.4), ("COVER99", 0.5)]])
    rows += page(1, 2, [[("Member", 0.1), ("ID:", 0.17), ("ZZ98765", 0.3)]])
    rows += page(1, 3, FORM)
    rows += page(2, 1, [[("MemberID:77001234", 0.1)], [("note:", 0.1)], [("see", 0.1), ("below", 0.14)], [], [("too", 0.1), ("far", 0.14)]], 0.45)
    rows += page(3, 1, [[("nothing", 0.1)]])
    return spark.createDataFrame(rows, SCHEMA)


def test_values_of_whole_jobs(spark, tokens):
    aliases = spark.createDataFrame(ALIASES, "field_key string, label string")
    got = {(r.job_id, r.field_key): (r.value, r.page_number, round(r.confidence, 2)) for r in E.label_values(tokens, aliases).collect()}
    assert got[1, "member_id"] == ("AB12345", 3, 0.8)  # the form page, not the one before it
    assert got[1, "patient_name"] == ("Ann Lee", 3, 0.8)  # up to the next label
    assert got[1, "patient_dob"] == ("01/02/1980", 3, 0.8)  # below
    assert got[1, "units_requested"] == ("30", 3, 0.8)  # said twice
    assert got[1, "service_code"] == ("H2036 G0480,", 3, 0.8)
    assert got[1, "prior_auth_number"] == ("Q77-1", 3, 0.8)  # not beyond the gap
    assert got[2, "member_id"] == ("77001234", 1, 0.4)  # inside the label's token
    assert got[2, "note"][0] == "see below"
    assert not [k for k in got if k[0] == 3]


def test_regions_bound_the_value_and_the_confidence(spark, tokens):
    aliases = spark.createDataFrame(ALIASES, "field_key string, label string")
    schema = "field_key string, page_number int, roi_x0 double, roi_y0 double, roi_x1 double, roi_y1 double"
    regions = spark.createDataFrame([("patient_name", 3, 0.28, 0.04, 0.29, 0.07), ("member_id", 3, 0.3, 0.0, 0.4, 0.02), ("member_id", 1, 0.8, 0.8, 0.9, 0.9)], schema)
    got = {(r.job_id, r.field_key): (r.value, round(r.confidence, 2)) for r in E.label_values(tokens, aliases, regions=regions).collect()}
    assert got == {(1, "patient_name"): ("Ann", 1.0), (1, "member_id"): ("AB12345", 1.0), (2, "member_id"): ("77001234", 0.4)}  # no token beyond the region; a value far off counts less


def test_no_tokens(spark, tokens):
    aliases = spark.createDataFrame(ALIASES, "field_key string, label string")
    assert E.label_values(tokens.limit(0), aliases).collect() == []
