"""Files, sinks and seeds: what is taken in, what is turned away and why, and what a repeated write leaves."""

import pandas as pd
from pyspark.sql import functions as F

from quire.operators import lookups as L
from quire.operators import tokens as T
from quire.operators import training as R
from quire.sources import files as S
from quire.streaming import jobs as J

PDF = b"%PDF-1.4 " + b"x" * 40


def test_uploads(spark, tmp_path):
    for name, data in {"a b.pdf": PDF, "text.pdf": b"no such kind of file at all", "big.png": b"\x89PNG\r\n\x1a\n" + b"y" * 500, "scan.jpg": b"\xff\xd8\xff" + b"z" * 30}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.length: r for r in S.uploads(spark, str(tmp_path), "t1", "2024-03-05 10:00:00", most=300).collect()}
    assert {n: r.error for n, r in got.items()} == {len(PDF): None, 27: "BAD_TYPE", 508: "TOO_LARGE", 33: None}
    assert got[len(PDF)].kind == "application/pdf" and got[33].kind == "image/jpeg"
    assert got[len(PDF)].storage_key.startswith("t1/2024/03/05/" + got[len(PDF)].sha256[:8])


def test_appends_and_replaced_partitions(spark, tmp_path):
    path = str(tmp_path / "tokens")
    rows = lambda *r: spark.createDataFrame(list(r), "job_id int, t string")
    S.append(rows((1, "a"), (2, "b")), path, "job_id")
    S.append(rows((1, "c")), path, "job_id")
    assert sorted((r.job_id, r.t) for r in spark.read.parquet(path).collect()) == [(1, "a"), (1, "c"), (2, "b")]
    for _ in range(2):
        S.replace_partitions(rows((1, "d")), path, "job_id")
    assert sorted((r.job_id, r.t) for r in spark.read.parquet(path).collect()) == [(1, "d"), (2, "b")]


def test_rules_and_thresholds(spark):
    df = S.rules(spark, {"B": {"display_name": "Bee", "critical_fields": ["x"], "confidence_thresholds": {"x": 0.9}, "field_validations": {"x": {"pattern": "a"}}}, "A": {}})
    got = {r.payer: r for r in df.withColumns({"own": S.threshold_of(F.col("thresholds"), F.lit("x")), "other": S.threshold_of(F.col("thresholds"), F.lit("y"))}).collect()}
    assert (got["B"].own, got["B"].other, got["A"].own) == (0.9, 0.7, 0.7) and got["B"].validations == {"x": '{"pattern": "a"}'}
    assert S.rules(spark, {}).count() == 0


def test_template_seeds(spark):
    seeds = [{"payer": "A", "doc_type": "D", "template_name": "T", "fields": {"f": {"page": 2, "label": "F:", "roi": {"x0": 0.1, "x1": 0.5}}, "g": {"is_required": True}}}]
    got = {r.field_key: r for r in S.template_fields(spark, seeds).collect()}
    assert (got["f"].page, got["f"].roi_x1, got["f"].roi_y1, got["g"].page, got["g"].is_required, got["g"].expected_type) == (2, 0.5, 0.0, 1, True, "text")


def test_pages_tell_what_was_dropped_and_refused(spark):
    def split(frames):
        for f in frames:
            yield pd.DataFrame([(s, n, b"i") for s in f["sha256"] for n in range(1, 5)], columns=["sha256", "page_number", "image"])

    files = spark.createDataFrame([("a", PDF), ("locked", PDF + b"/Encrypt 5 0 R"), ("null", None)], "sha256 string, content binary")
    got = sorted((r.sha256, r.page_number or 0, r.image is not None, r.error) for r in S.pages_of(files, split, most=3).collect())
    pages = [(1, True, None), (2, True, None), (3, True, None), (4, False, "BEYOND_PAGE_LIMIT")]
    assert got == [*(("a", *p) for p in pages), ("locked", 0, False, "ENCRYPTED"), *(("null", *p) for p in pages)]


def test_a_batch_that_is_sent_again_replaces_itself(spark, tmp_path):
    write = J.idempotent_sink(str(tmp_path / "out"))
    for _ in range(2):
        write(spark.range(3), 0)
    write(spark.range(2), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_rows_go_to_a_client_some_at_a_time(spark, tmp_path):
    folder = str(tmp_path)

    def send(rows):
        import uuid

        assert len(rows) <= 4
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(",".join(str(r["id"]) for r in rows))

    S.hook(send, 4)(spark.range(10).coalesce(1), 0)
    sent = [p.read_text().split(",") for p in tmp_path.iterdir()]
    assert sorted(int(x) for s in sent for x in s) == list(range(10)) and sorted(map(len, sent)) == [2, 4, 4]


def test_seed_lines_do_not_break_below_the_top_edge(spark):
    boxes = [(1, 0.1 * i, y - 0.005, 0.1 * i + 0.05, y + 0.005) for i, y in enumerate((-0.01, 0.0, 0.03, 0.04, 0.06))]
    d = spark.createDataFrame(boxes, "page_id int, x0 double, y0 double, x1 double, y1 double")
    lines = lambda f: [r.line_number for r in f(d).orderBy("y0").collect()]
    assert lines(T.seed_lines) == [1, 1, 1, 1, 2] and lines(T.assign_lines) == [0, 0, 1, 1, 1]


def test_page_scan_and_known_keys(spark):
    rows = spark.createDataFrame([(i % 10 if i else None,) for i in range(25)], "k int").distinct()
    assert [r.k for r in L.page_scan(rows, "k", 0, 3).collect()] == [None, 0, 1] and [r.k for r in L.page_scan(rows, "k", 9, 5).collect()] == [8, 9]
    asked = spark.createDataFrame([(3,), (77,), (None,)], "k int")
    assert {r.k: r.exists for r in L.known(asked, rows, "k").collect()} == {3: True, 77: False, None: False}


def test_labels_of_a_review(spark):
    c = spark.createDataFrame([(1, "f", "v", "r"), (2, "f", "v", "r"), (3, "f", "v", "r")], "job_id int, field_key string, corrected_value string, reviewer_id string")
    pages = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, None), (2, 1, True)], "job_id int, page_number int, is_cover boolean")
    jobs = spark.createDataFrame([(1, "P", "D"), (2, "P", "D")], "job_id int, payer string, doc_type string")
    assert [tuple(r) for r in R.review_labels(c, pages, jobs).collect()] == [(1, 2, "f", "v", "P", "D", "human_review", "r")]
