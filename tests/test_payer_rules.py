"""Golden values of payers' own rules."""

from pyspark.sql import functions as F

from quire.functions import payer_rules as P

RULES = {
    "A": {"field_validations": {"id": {"regex": "^[A-Z]{2}", "min_length": 3, "max_length": 4}, "end_date": {"format": "MM/DD/YYYY", "validate_not_future": True, "validate_after_effective": True}, "x": {}},
          "canonicalization": {"id": {"uppercase": True, "remove_spaces": True, "remove_dashes": True}, "dates": {"standard_format": "YYYY-MM-DD", "accept_formats": ["MM/DD/YYYY", "MM/DD/YY"]}, "raw": {"trim": False, "remove_special": True}}},
}
ERRORS = [
    ("A", "id", "AB1", []), ("A", "id", "ab", ["PATTERN", "TOO_SHORT"]), ("A", "id", "AB123", ["TOO_LONG"]), ("A", "id", "", ["PATTERN", "TOO_SHORT"]), ("A", "id", None, []), ("B", "id", "ab", []), ("A", "x", "", []), (None, "id", "ab", []),
    ("A", "end_date", "1/2/2031", ["IN_FUTURE"]), ("A", "end_date", "01/31/2020", ["NOT_AFTER_EFFECTIVE"]), ("A", "end_date", "2/1/2020", []), ("A", "end_date", "2/30/2031", []), ("A", "end_date", "2031-01-02", []), ("A", "end_date", "1/2/31", []),
]
FORMS = [
    ("A", "id", " ab-1\t2 ", "AB1\t2"), ("A", "end_date", " 1/2/2031", "2031-01-02"), ("A", "end_date", "1/2/31", "1/2/31"), ("A", "end_date", "2/30/2031", "2/30/2031"), ("A", "raw", " a b-c ", "abc"),
    ("A", "other", " a b ", "a b"), ("B", "id", " a-b ", "a-b"), (None, "id", " a ", "a"), ("A", "id", None, None), ("A", "id", "", ""),
]


def test_rule_errors(spark):
    df = spark.createDataFrame([r[:3] for r in ERRORS], "payer string, key string, value string")
    got = df.select(P.rule_errors(F.col("payer"), F.col("key"), F.col("value"), F.lit("1/31/2020"), F.lit("2030-01-01").cast("date"), RULES)).collect()
    assert [r[0] for r in got] == [r[3] for r in ERRORS]


def test_rule_canonical(spark):
    df = spark.createDataFrame([r[:3] for r in FORMS], "payer string, key string, value string")
    got = df.select(P.rule_canonical(F.col("payer"), F.col("key"), F.col("value"), RULES)).collect()
    assert [r[0] for r in got] == [r[3] for r in FORMS]
