"""WARC: exact round trip, deduplication, range coalescing and odd rows."""

import hashlib

from quire.llm import storage, warc

SCHEMA = "page_id long, url string, html string, digest string"
BIG = "<p>é" + "x" * 200


def brute(rows):
    payload = lambda r: (r[2] or "").encode()
    out = []
    for r in rows:
        same = [s[0] for s in rows if payload(s) == payload(r) and s[0] is not None]
        revisit = len(payload(r)) >= 100 and bool(same) and (r[0] is None or r[0] > min(same))
        out.append((r[0], len(payload(r)), hashlib.sha256(payload(r)).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    return sorted(map(str, out))


def test_round_trip(spark):
    rows = [(3, "u", BIG, "k"), (1, "v\r\nX: y", BIG, "k"), (2, None, BIG, "k"), (4, "u", "", "k"), (5, "u", None, "k"), (6, "u", "short", "k"), (7, "u", "short", "k"), (None, "u", BIG, "k"), (8, "u", "y" * 300_000 + "\r\n\r\n", "k"), (9, "w", "n" * 100, "k"), (9, "w", "n" * 100, "k")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(str(tuple(r)) for r in warc.digest(df).collect()) == brute(rows)
    folder = storage.fresh_dir(spark, "warc")
    index = warc.archive(df, folder)
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(index.where("page_id IN (1, 8)"), folder).collect()}
    assert got == {1: BIG, 8: "y" * 300_000 + "\r\n\r\n"}


def test_archives_begin_with_their_info_and_no_two_records_have_one_id(spark):
    import gzip
    from pathlib import Path

    rows = [(9, "w", BIG, "k"), (9, "w", BIG, "k"), (None, "u", "a", "k"), (None, "u", "a", "k"), (10, "w", BIG, "k")]
    folder = storage.fresh_dir(spark, "warc")
    warc.archive(spark.createDataFrame(rows, SCHEMA), folder).collect()
    files = [gzip.decompress(f.read_bytes()).decode() for f in Path(folder.removeprefix("file://")).rglob("*.warc.gz")]
    ids = [x for t in files for x in t.split("\r\n") if x.startswith("WARC-Record-ID: <urn:uuid:")]
    assert files and all(t.startswith("WARC/1.1\r\nWARC-Type: warcinfo\r\n") for t in files) and len(ids) == len(set(ids)) == len(rows) + len(files)


def test_empty_table(spark):
    assert warc.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranges():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 200, 5), ("b", 0, 3)]
    assert list(warc.ranges(rows, gap=30, most=100)) == [("a", 0, 45, [(0, 10), (10, 5), (40, 5)]), ("a", 200, 205, [(200, 5)]), ("b", 0, 3, [(0, 3)])]
    assert len(list(warc.ranges([("a", i * 10, 10) for i in range(100)], most=100))) == 10
