"""Quality rules against brute force; the order of rules follows rejection per cost."""

import os
import re
import unicodedata

import pytest

from quire.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, kept string"
TEXTS = [
    None, "", " ", "one two", "a b c d e " * 5, "a b c d e f g h i j k l", "x " * 3000, "same line here\n" * 6 + "and eleven more words that are all different from the others", "é# * $ % & | < >" * 3 + " w" * 5,
    "a b c d e f\x0bg h i j k a b c d e z y x w v u t s r q p o n m", "a\tb\n\n \n c d e f g h i j k l m", "longword" * 40 + " " + "b" * 300, "p q r s t u v w x y z " + "".join(f"word{i} " for i in range(20000)), "é è ê ë à á â ä ù ú û ü",
    "a line that goes on and breaks off there...\nanother line of words that ends well\nand one more that does… \r\nso it goes", "- first of the things to say here\n • second of the things\n* third of them all\t\n\n",
    "11 22 33 44 55 66 77 88 99 100 200 300 ab", "and so on ...\nthen a line\nthen a line more\nthen the last line of this one",
]


def prose_fails(t):
    """The rules beyond the counts: too many lines that break off, too many bullets, too few letters."""
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    off = sum(x.rstrip(" \t\x0b\x0c\r").endswith(("...", "…")) for x in lines)
    bullets = sum(x.lstrip(" \t\x0b\x0c\r").startswith(("-", "*", "•")) for x in lines)
    letters, chars = sum(unicodedata.category(c)[0] == "L" for c in t), sum(c not in " \t\n\x0b\x0c\r" for c in t)
    return off * 100 > len(lines) * 30 or bullets * 100 > len(lines) * 90 or letters * 100 < chars * 50


def brute(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins, again = {}, set()
    for i in range(len(w) - 4):
        wins.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in wins.values():
        if len(at) > 1:
            again.update(p for i in at for p in range(i, i + 5))
    n, chars, symbols, dup = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
    base = n < 10 or 100 * len(again) > 20 * n
    more = symbols * 100 > n * 50 or dup * 100 > len(lines) * 50 or n > 0 and (chars < 2 * n or chars > 20 * n) or prose_fails(t)
    return (n, chars, symbols, dup, len(again), base, not (base or more))


def test_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[5], None), (None, TEXTS[4], "x"), (3, TEXTS[5], None)]
    got = Q.verdicts(spark.createDataFrame(rows, SCHEMA)).drop("rejected_by").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, *brute(t))) for i, t, _ in rows)


def test_cascade_keeps_the_same(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], SCHEMA)
    kept = Q.apply_cascade(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, t in enumerate(TEXTS) if brute(t)[-1]]


def test_order():
    """By rejection per cost of what is left: c rejects most, but nothing that b leaves."""
    seconds = {"a": 2.0, "b": 1.0, "c": 1.0, "d": 0.1}
    rejected = [(frozenset("bc"), 40), (frozenset("c"), 0), (frozenset("ab"), 10), (frozenset("a"), 5), (frozenset(), 45)]
    costs = Q.in_order(seconds, rejected)
    assert [c.name for c in costs] == ["b", "a", "c", "d"]
    assert [round(c.rejected, 3) for c in costs] == [0.5, 0.1, 0.0, 0.0]
    assert [r.name for r in Q.ordered([Q.Rule(x, None) for x in "abcd"], costs)] == ["b", "a", "c", "d"]
    assert [c.name for c in Q.in_order({"z": 1.0, "y": 1.5}, [(frozenset("z"), 5), (frozenset("y"), 5)])] == ["y", "z"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_the_order_is_the_same_in_ten_runs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert len({tuple(c.name for c in Q.estimate(df)) for _ in range(10)}) == 1


def test_copies_of_a_text_are_drawn_each_for_itself(spark):
    df = spark.createDataFrame([(i, "one text") for i in range(2000)], "doc_id long, text string")
    assert 50 < Q.sampled(df, "text", 100, ["doc_id"]).count() < 200
    same = spark.createDataFrame([(1, "one row")] * 2000, "doc_id long, text string")
    assert Q.sampled(same, "text", 100, ["doc_id"]).count() <= 400


def test_columns_with_clashing_names_pass_through(spark):
    df = spark.createDataFrame([(1, "plain words that make a line of more than ten words in all", "w", "m")], "doc_id long, text string, _w string, _x string")
    assert [tuple(r) for r in Q.apply_cascade(df).collect()] == [tuple(r) for r in df.collect()]
    assert Q.base_measures(df).columns == [*df.columns, "_m"]


def test_the_sample_is_the_same_in_two_runs(spark):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(500)], "doc_id long, text string")
    one, two = (sorted(r["doc_id"] for r in Q.sampled(df.repartition(k), "text", 50).collect()) for k in (2, 7))
    assert one == two and 20 < len(one) < 100


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Q.verdicts(empty).count() == 0 and Q.apply_cascade(empty).count() == 0
