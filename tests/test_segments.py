"""Documents within a job, from page texts."""

from quire.operators import segments as S

SIGNS = {"A": (("acme",), (), ()), "B": (("bolt",), (), ("no bolt",))}
SCHEMA = "job_id long, page_number int, text string, known_cover boolean"
LONG = " word" * 30


def found(spark, *texts, least=1):
    rows = [(1, i + 1, t, False) if not isinstance(t, tuple) else (1, i + 1, *t) for i, t in enumerate(texts)]
    got = S.detected(spark.createDataFrame(rows, SCHEMA), ("fax cover", "pages:"), SIGNS, least).collect()
    return sorted((r.segment, r.page_numbers, r.payer, r.payer_confidence, r.has_cover, r.reason, r.composite) for r in got)


def test_segments(spark):
    assert found(spark, "acme" + LONG, "plain" + LONG) == [(0, [1, 2], "A", 0.325, False, "start", False)]
    assert found(spark, "acme" + LONG, "bolt" + LONG) == [(0, [1], "A", 0.65, False, "start", True), (1, [2], "B", 0.65, False, "payer_change", True)]
    assert [s[1:] for s in found(spark, "x", "Fax Cover pages: 2", "no bolt")] == [([1], None, 0.0, False, "start", True), ([2, 3], None, 0.0, True, "cover_page", True)]
    assert [s[1] for s in found(spark, None, ("acme", True))] == [[1], [2]]


def test_small_segments_join_the_one_before(spark):
    got = found(spark, "acme" + LONG, "acme" + LONG, "bolt" + LONG, "acme" + LONG, "acme" + LONG, least=2)
    assert got == [(0, [1, 2, 3], "A", 0.65, False, "start", True), (1, [4, 5], "A", 0.65, False, "payer_change", True)]


def test_empty(spark):
    assert S.detected(spark.createDataFrame([], SCHEMA), ("a",), SIGNS, 2).collect() == []
