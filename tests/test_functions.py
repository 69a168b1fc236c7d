"""Golden vectors of the scalar functions and operators, and rows with nulls, ties and nothing."""

import datetime

import pytest
from pyspark.sql import functions as F

from quire import rules as R
from quire.functions import classify as C, dates, geometry as G, text as T, validators as V
from quire.operators import merge as M, search, segments, tokens


def one(spark, **columns):
    return tuple(spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first())


@pytest.mark.parametrize("kind,value,payer,want", [
    ("date", "03/05/24", "", "2024-03-05"), ("date", "Mar 5, 2024", "", "2024-03-05"), ("date", "3/5/60", "", "2060-03-05"), ("date", "on 3/5/60", "", "1960-03-05"), ("date", "13/45/2024", "", "13/45/2024"),
    ("phone", "1-866-577-2184", "", "(866) 577-2184"), ("phone", "12", "", "12"), ("ssn", "123456789", "", "123-45-6789"), ("member_id", "yaw 123-456-789", "ANTHEM", "YAW123456789"),
    ("npi", "123 456 7893", "", "1234567893"), ("text", "  a \n b ", "", "a b"), ("date", None, "", ""), ("date", "", "", ""),
])
def test_canonicalize(spark, kind, value, payer, want):
    assert one(spark, v=T.canonicalize(F.lit(value).cast("string"), F.lit(kind), F.lit(payer))) == (want,)


def test_dates(spark):
    got = spark.createDataFrame([("2/30/2024",), ("2-3-2024",), ("2024-2-3",), ("2/3/72",), ("February 3, 2024",), ("2/3/2",), (None,)], "v string").select(dates.parsed(F.col("v"))).collect()
    d = datetime.date
    assert [r[0] for r in got] == [None, d(2024, 2, 3), d(2024, 2, 3), d(1972, 2, 3), d(2024, 2, 3), None, None]


def test_npi_luhn(spark):
    assert one(spark, a=V.npi_ok(F.lit("1234567893")), b=V.npi_ok(F.lit("1234567897"))) == (False, True)


@pytest.mark.parametrize("key,value,want", [
    ("member_id", "A B C", 0.10), ("units_requested", "12 visits", 0.0), ("units_requested", "123456", 0.50), ("prior_auth_number", "1963313490-008-1", 0.45),
    ("note", "this is for a patient", 0.40), ("note", "Member: x", 0.20), ("note", "", 0.25), ("note", None, 0.25), ("note", ":", 0.25), ("note", "fine", 0.0),
])
def test_contamination_penalty(spark, key, value, want):
    assert one(spark, p=F.round(M.contamination_penalty(F.lit(key), F.lit(value).cast("string")), 4))[0] == want


def test_payer(spark):
    name, score = C.payer(F.col("t"))
    rows = [("Molina Healthcare at molinahealthcare.com",), ("anthem bcbs and aetna",), (None,), ("",)]
    got = spark.createDataFrame(rows, "t string").select(name, F.round(score, 2)).collect()
    assert [tuple(r) for r in got] == [("MOLINA", 0.85), ("UNKNOWN", 0.0), ("UNKNOWN", 0.0), ("UNKNOWN", 0.0)]
    assert list(R.PAYER_SIGNATURES)[0] == "ANTHEM"


def test_doc_type(spark):
    name, score = C.doc_type(F.lit("Determination: Approved. Effective Date 1 Expiration Date 2"))
    assert one(spark, n=name, s=F.round(score, 2), d=C.decision(name)) == ("PRIOR_AUTH_APPROVAL", 0.72, "APPROVED")


def test_hamming(spark):
    assert one(spark, h=G.hamming(F.lit(5).cast("long"), F.lit(-1).cast("long"))) == (62,)


CANDIDATE = "job_id long, field_key string, ord int, value string, method string, confidence double"


@pytest.mark.parametrize("rows,want", [
    ([("A1", "TEMPLATE_OCR", 0.90), ("a1", "LAYOUTLM", 0.60)], ("A1", 1.0, "HYBRID")),
    ([("A1", "TEMPLATE_OCR", 0.90), ("B2", "LAYOUTLM", 0.95)], ("B2", 0.92, "HYBRID")),
    ([("x", "LAYOUTLM", 0.20)], (None, 0.27, "NOT_PRESENT")),
])
def test_field_build(spark, rows, want):
    df = spark.createDataFrame([(1, "provider_phone", i, *r) for i, r in enumerate(rows)], CANDIDATE)
    assert tuple(M.built(df).select("value", F.round("confidence", 4), "method").first()) == want


def test_quality_penalty(spark):
    assert one(spark, p=F.round(M.quality_penalty(F.lit(50.0), F.lit(0.01), F.lit(0.70)), 4)) == (0.08,)


def test_review_flags(spark):
    fields = [(1, "patient_name", "x", 0.84, "HYBRID", 2), (1, "provider_name", "x", 0.84, "HYBRID", 2), (1, "member_id", None, None, "HYBRID", 2), (1, "decision", "x", 0.1, "HUMAN_REVIEW", 1)]
    df = spark.createDataFrame(fields, "job_id long, field_key string, value string, confidence double, method string, n_candidates long")
    got = [(r["field_key"], r["reason"], r["place"]) for r in M.review_flags(df).orderBy("place").collect()]
    assert got == [("member_id", "MISSING_VALUE", 1), ("patient_name", "LOW_CONFIDENCE", 2)]


def test_match_score(spark):
    assert one(spark, s=F.round(search.match_score(F.lit(0.8), F.lit(3), 6), 4)) == (0.785,)


@pytest.mark.parametrize("words,chunks", [(1, 1), (256, 1), (300, 2), (480, 2), (481, 3)])
def test_chunks(spark, words, chunks):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(words))), (2, None), (3, " ")], "doc_id long, text string")
    got = tokens.chunks(df).collect()
    assert len(got) == chunks and {w for r in got for w in r["chunk"].split()} == {f"w{i}" for i in range(words)}


def test_boundaries_agree_with_the_scan(spark):
    import random

    r = random.Random(4)
    rows = [(j, p, r.choice(["A", "B", "C", None]), r.choice([0.3, 0.5, 0.9]), r.random() < 0.2, r.choice([5, 50])) for j in range(120) for p in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "job_id long, page_number long, payer string, payer_confidence double, is_cover boolean, word_count int")
    key = lambda x: sorted((a["job_id"], a["page_number"], a["reason"]) if a["reason"] else (a["job_id"], a["page_number"], "") for a in x.collect())
    assert key(segments.boundaries(df)) == key(segments.scanned_boundaries(df))


def test_hamming_join_is_complete(spark):
    import random

    r = random.Random(9)
    base = [r.getrandbits(64) - 2**63 for _ in range(30)]
    rows = [(i, h) for i, h in enumerate(base)] + [(100 + i, (h ^ sum(1 << r.randrange(63) for _ in range(4)))) for i, h in enumerate(base)]
    df = spark.createDataFrame(rows, "id long, hash long")
    got = {(a["left_id"], a["right_id"]): a["distance"] for a in search.hamming_join(df, df, 6).collect()}
    apart = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert got == {(a, b): apart(x, y) for a, x in rows for b, y in rows if apart(x, y) <= 6}


def test_file_names(spark):
    names = [("a b.pdf", "a_b.pdf"), ("../../x/évil?.pdf", "évil_.pdf"), ("", "unnamed_fax"), (None, "unnamed_fax"), ("__..", "unnamed_fax")]
    got = spark.createDataFrame([(n,) for n, _ in names], "n string").select(T.sanitized_name("n")).collect()
    assert [r[0] for r in got] == [w for _, w in names]
