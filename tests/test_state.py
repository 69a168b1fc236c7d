"""Updates whose keys are null or come more than once."""

from quire.operators import lookups as L
from quire.operators import merge as M
from quire.operators import state as S


def test_upsert_takes_the_last_of_each_key_and_null_is_one(spark):
    old = spark.createDataFrame([(1, "a", 0), (None, "b", 0), (2, "c", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "d", 3), (1, "e", 2), (None, "f", 1), (None, "g", 2), (4, None, 1)], "k int, v string, at int")
    assert sorted(map(str, map(tuple, S.upsert(old, new, ["k"], "at").collect()))) == sorted(map(str, [(1, "d", 3), (None, "g", 2), (2, "c", 0), (4, None, 1)]))
    assert S.upsert(old, new.limit(0), ["k"]).count() == 3 and S.upsert(old.limit(0), new, ["k"], "at").count() == 3


def test_two_corrections_of_a_field_make_one_row(spark):
    fields = spark.createDataFrame([(1, "f", "old", 0.5, "LAYOUTLM")], "job_id int, field_key string, value string, confidence double, method string")
    c = spark.createDataFrame([(1, "f", "new", 2), (1, "f", "newer", 3), (1, "f", "first", 1)], "job_id int, field_key string, corrected_value string, at int")
    (r,) = M.apply_corrections(fields, c, "at").collect()
    assert (r.value, r.previous, r.method) == ("newer", "old", "HUMAN_REVIEW")


def test_repeated_updates_keep_the_rows(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    u = spark.createDataFrame([(1, "p", 1), (1, "q", 2), (2, None, 1)], "k int, v string, at int")
    assert sorted(map(tuple, S.coalesce_update(rows, u, ["k"], ["v"], "at").collect())) == [(1, "q"), (2, "y")]
    versions = spark.createDataFrame([("a", "K", {"f": 1.0}, True)], "version_id string, kind string, metrics map<string,double>, is_active boolean")
    new = spark.createDataFrame([("b", "k", {"f": 2.0}), ("b", "k", {"f": 2.0})], "version_id string, kind string, metrics map<string,double>")
    assert L.registered(versions, new).count() == 2
    m = spark.createDataFrame([("a", {"f": 3.0}, 1), ("a", {"f": 4.0}, 2)], "version_id string, metrics map<string,double>, at int")
    assert L.with_metrics(versions, m, "at").first().metrics == {"f": 4.0}
    f = spark.createDataFrame([(1, "f", "M", None, None)], "job_id int, field_key string, method string, validation_passed boolean, validation_errors array<string>")
    v = spark.createDataFrame([(1, "f", True, None, 1), (1, "f", False, ["bad"], 2)], "job_id int, field_key string, passed boolean, errors array<string>, at int")
    (r,) = L.with_validation(f, v, "at").collect()
    assert (r.validation_passed, r.validation_errors) == (False, ["bad"])
