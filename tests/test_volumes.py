"""What queries shuffle: lines of tokens, not tokens; candidates once, and not once more for each distinct count."""

import __spark_entry__ as entry
from quire.operators import lookups as L

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_not_cut_into_tokens_and_put_together_again(spark):
    assert [plan(spark, q).count("Generate ") for q in ("d10_page_text", "n12_raw_ocr", "h22_filtered_tokens")] == [1, 1, 1]  # lines of texts
    assert "Aggregate" not in plan(spark, "h22_filtered_tokens")


def test_no_row_is_sent_once_for_each_distinct_count(spark):
    assert "Expand" not in plan(spark, "i9_review_reasons") and "Expand" not in plan(spark, "i13_final_route")


def test_jobs_come_from_their_fields(spark):
    assert plan(spark, "i7_overall_score").count("Relation [l_orderkey") == 3  # fields, values, validation


def test_raw_ocr_by_tokens_and_by_lines(spark):
    pages = spark.createDataFrame([(1, 0, 10), (1, 1, 11)], "job_id long, page_number int, page_id long")
    tokens = spark.createDataFrame([(10, 1, 0, "c", 0.5), (10, 0, 1, "b", None), (10, 0, 0, "a", 0.25)], "page_id long, line_number int, word_number int, token_text string, confidence double")
    got = L.raw_ocr(pages, tokens).orderBy("page_id").select("page_id", "n_tokens", "confidence", "text").collect()
    assert list(map(tuple, got)) == [(10, 3, 0.375, "a b c"), (11, 0, None, "")]


def test_rows_are_sent_before_they_are_sorted_for_corrections(spark):
    assert plan(spark, "i5_corrections").count("RepartitionByExpression [job_id") == 3
