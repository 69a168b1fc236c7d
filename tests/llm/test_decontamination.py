"""Decontamination against brute force: both ways of looking windows up, odd rows, and what clean() removes."""

import hashlib
import re

import pytest

from quire.llm import decontamination as D

DOC = "doc_id long, text string, item string"
BENCH = "item_id long, text string, k string"
LONG = "One two three four five six seven eight nine ten eleven Twelve thirteen"
ITEMS = [(1, LONG, "x"), (2, "short item É", "x"), (3, "", "x"), (4, None, "x"), (5, LONG, "x"), (30, "other words that nobody says at all in any of these documents here", "x"), (None, "null id item", "x")]
DOCS = [
    (1, f"intro {LONG.upper()}! outro", "x"), (2, "a SHORT--item É, b short item é", "x"), (3, None, "x"), (4, "", "x"), (5, "clean text with nothing to find", None),
    (6, LONG.replace("five", "5"), "x"), (7, " ".join([LONG] * 50), "x"), (7, "another row of the same id: short item É", "x"), (8, "w " * 20000 + LONG, "x"), (None, LONG, "x"), (9, "null id item", "x"), (5, "clean text with nothing to find", None),
]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute(docs, items):
    windows = {}
    for i, t, _ in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t, _ in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append(str((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))))
    return sorted(out)


@pytest.mark.parametrize("most", [40_000, 3])
def test_against_brute_force(spark, most):
    docs, bench = spark.createDataFrame(DOCS, DOC), spark.createDataFrame(ITEMS, BENCH)
    assert sorted(str(tuple(r)) for r in D.digest(docs, bench, max_windows=most).collect()) == brute(DOCS, ITEMS)


@pytest.mark.parametrize("most", [40_000, 0])
def test_empty_tables(spark, most):
    docs, bench = spark.createDataFrame(DOCS, DOC), spark.createDataFrame([], BENCH)
    assert not any(r["contaminated"] for r in D.digest(docs, bench, max_windows=most).collect())
    assert D.digest(spark.createDataFrame([], DOC), spark.createDataFrame(ITEMS, BENCH), max_windows=most).count() == 0


def test_clean(spark):
    docs, bench = spark.createDataFrame(DOCS, DOC), spark.createDataFrame(ITEMS, BENCH)
    kept = [r["doc_id"] for r in D.clean(docs, bench).collect()]
    assert sorted(kept) == [3, 4, 5, 5, 6]
    spans = {r["doc_id"]: r["text"] for r in D.clean(docs.where("doc_id IN (1, 2, 5)"), bench, "spans").collect()}
    assert spans == {1: "intro ! outro", 2: "a , b short item é", 5: "clean text with nothing to find"}
    with pytest.raises(ValueError):
        D.clean(docs, bench, "all")


@pytest.mark.parametrize("most,held", [(40_000, 256 << 20), (0, 256 << 20), (0, 0)])
def test_ids_with_commas_and_empty_ids(spark, most, held, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_BYTES", held)
    items = [("a,b", "one two three", "x"), ("", "four five six seven", "x"), ("it's \\", "one two three", "x"), (None, "eight nine", "x")]
    docs = [(1, "one two three four five six seven", "x"), (2, "four five six seven", "x"), (3, "eight nine", "x")]
    bench = spark.createDataFrame(items, "item_id string, text string, k string")
    assert sorted(str(tuple(r)) for r in D.digest(spark.createDataFrame(docs, DOC), bench, max_windows=most).collect()) == brute(docs, items)


@pytest.mark.parametrize("most", [40_000, 0])
def test_clean_passes_columns_of_any_name(spark, most):
    names = ["_w", "_h", "_hits", "_items", "_met", "n", "k"]
    df = spark.createDataFrame([(1, "clean words", *names), (2, LONG, *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = D.clean(df, spark.createDataFrame(ITEMS, BENCH), max_windows=most)
    assert [tuple(r) for r in kept.collect()] == [(1, "clean words", *names)] and kept.columns == df.columns
    assert {r["doc_id"]: r["_w"] for r in D.clean(df, spark.createDataFrame(ITEMS, BENCH), "spans", max_windows=most).collect()} == {1: "_w", 2: "_w"}
