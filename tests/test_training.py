"""The training set on small jobs: which fields, which page, and whether there is a label already."""

from quire.operators import training as T

JOBS = "job_id long, filename string, payer string, doc_type string, status string"
FIELDS = "job_id long, field_key string, value string, confidence double, method string"
PAGES = "job_id long, page_id long, page_number int, is_cover boolean, raw_key string, preprocessed_key string"
SEEN = "job_id long, field_key string"


def labels(spark, jobs, fields, pages, seen=(), **more):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    got = T.training_labels(frame(jobs, JOBS), frame(fields, FIELDS), frame(pages, PAGES), frame(seen, SEEN), ("a", "b"), 0.6, **more)
    return sorted(tuple(r) for r in got.collect())


JOB, PAGE = (1, "x.pdf", "anthem", "pa", "COMPLETED"), (1, 10, 1, False, "raw", "pre")


def test_fields(spark):
    fields = [(1, "a", " v ", 0.6, None), (1, "b", "w", 0.7, "other"), (1, "c", "x", 1.0, "LAYOUTLM")]
    assert labels(spark, [JOB], fields, [PAGE]) == [(1, 10, "a", "v", "pre", "ANTHEM", "PA", "batch3_extraction")]
    for value, confidence, method, kept in (("N/A", 0.9, "OCR_LABEL", 0), (" ", 0.9, "OCR_LABEL", 0), (None, 0.9, "OCR_LABEL", 0), ("v", 0.59, "OCR_LABEL", 0), ("v", None, "OCR_LABEL", 0), ("v", 0.8, "other", 1), ("v", 0.6, "ocr_label", 1), ("v", 0.6, "", 1)):
        assert len(labels(spark, [JOB], [(1, "a", value, confidence, method)], [PAGE])) == kept
    assert labels(spark, [JOB], fields, [PAGE], [(1, "a"), (1, "a")]) == []


def test_jobs(spark):
    one = [(1, "a", "v", 0.9, None)]
    for payer, status in (("UNKNOWN", "COMPLETED"), ("", "COMPLETED"), (None, "COMPLETED"), ("A", "FAILED"), ("A", None)):
        assert labels(spark, [(1, "x", payer, None, status)], one, [PAGE]) == []
    template = [(1, "My-Humana.PDF", "A", None, "REVIEW_REQUIRED")]
    assert [r[7] for r in labels(spark, template, one, [PAGE], source="templates")] == ["synthetic_template"]
    assert labels(spark, template, one, [PAGE], source="batch3") == [] and labels(spark, [(1, None, "A", None, "COMPLETED")], one, [PAGE], source="templates") == []


def test_pages(spark):
    one = [(1, "a", "v", 0.9, None)]
    page = lambda i, n, cover, raw="r", pre=None: (1, i, n, cover, raw, pre)
    best = lambda *pages: [(r[1], r[4]) for r in labels(spark, [JOB], one, pages)]
    assert best(page(1, 1, True), page(2, 3, False), page(3, 2, False)) == [(3, "r")]
    assert best(page(1, 2, True), page(2, 1, True, "r", "")) == [(2, "r")]
    assert best(page(1, 1, None, "r", "p"), page(2, 0, False)) == [(1, "p")]
    assert best(page(1, 1, False, "", None), page(2, 2, False)) == [] and best() == []
