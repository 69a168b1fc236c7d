"""Label search against a plain scan of small random pages."""

import random
import re

from quire.operators import labels as L

LABELS = [("id", "member id"), ("id", "id #"), ("name", "patient name:"), ("date", "date of birth"), ("date", "dob")]


def plain(tokens, labels):
    fold = lambda x: x.replace("0", "o").replace("1", "l")
    clean = lambda x: re.sub("#+$", "", re.sub(":+$", "", x.strip().lower()))
    like = lambda a, b: a in b or b in a or fold(a) in fold(b) or fold(b) in fold(a)
    inline = lambda x: m[1].strip() if (m := re.match(r"[^:|#]*[:|#](.*)$", x)) else ""
    best = {}
    toks = [(i, ln, w, clean(t), t) for i, (ln, w, t) in enumerate(sorted(tokens))]
    for key, label in labels:
        words = [clean(w) for w in label.lower().split()]
        for s in range(len(toks)):
            if len(words) == 1:
                if not like(words[0], toks[s][3]):
                    continue
                score, at = len(words[0]) / max(len(toks[s][3]), 1), [s]
            else:
                found, at = 0, []
                for t in toks[s : s + len(words) + 5]:
                    if at and abs(t[1] - toks[at[0]][1]) > 1:
                        break
                    k = 0
                    while found + k < len(words) and like(words[found + k], t[3]):
                        k += 1
                    if not k and not at:
                        break
                    if k:
                        found, at = found + k, [*at, t[0]]
                score = found / len(words)
                if score < 0.6 or not at:
                    continue
            rank = (-score, len(at), inline(toks[at[-1]][4]) == "", label, at)
            if key not in best or rank < best[key][0]:
                best[key] = (rank, label, round(score, 6), inline(toks[at[-1]][4]), [toks[i][4] for i in at])
    return {k: v[1:] for k, v in best.items()}


def test_against_a_plain_scan(spark):
    r = random.Random(3)
    words = ["member", "id", "ID:77", "id#5", "patient", "name", "Name:", "date", "of", "birth", "d0b", "dob:", "x", "zebra", "1d", ":"]
    pages = {p: [(i // 5, i % 5, r.choice(words)) for i in range(r.randint(1, 25))] for p in range(25)}
    rows = [(p, ln, w, t) for p, toks in pages.items() for ln, w, t in toks]
    df = spark.createDataFrame(rows, "page_id long, line_number int, word_number int, token_text string")
    aliases = spark.createDataFrame(LABELS, "field_key string, label string")
    got = {}
    for x in L.find_labels(df, aliases).collect():
        got.setdefault(x["page_id"], {})[x["field_key"]] = (x["label"], x["score"], x["inline"], [t["token_text"] for t in x["tokens"]])
    assert got == {p: found for p, toks in pages.items() if (found := plain(toks, LABELS))}


def test_tokens_dealt_by_page_are_not_shuffled(spark, monkeypatch):
    from quire import bindings as B

    plans, write = {}, L.stored

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(L, "stored", seen)
    found = L.find_labels(B.ocr_token(spark, "/root/testdata/sf0.001", by_page=True), spark.createDataFrame(LABELS, "field_key string, label string"))
    shuffles = lambda plan: [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(shuffles(plans["label-candidates"])) == 1  # of the texts
    assert all("hashpartitioning(page_id" in x for x in shuffles(found._jdf.queryExecution().executedPlan().toString()))  # of candidates, before they are there once a label


def test_many_words_are_found_by_the_index(spark, monkeypatch):
    monkeypatch.setattr(L, "FEW_WORDS", 0)
    test_against_a_plain_scan(spark)


def test_placed_tokens_are_read_once_and_not_sorted(spark, monkeypatch):
    from quire import bindings as B

    plans, write = {}, L.stored

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(L, "stored", seen)
    aliases = spark.createDataFrame(LABELS, "field_key string, label string")
    found = L.find_labels(B.ocr_token(spark, "/root/testdata/sf0.001", placed=True), aliases)
    plan = plans["label-candidates"].splitlines()
    assert set(plans) == {"label-words", "label-candidates"}  # no pass for the different tokens
    assert sum("Exchange hashpartitioning" in x for x in plan) == 1 and not any("Sort" in x and "word_number" in x for x in plan)
    counted = L.find_labels(B.ocr_token(spark, "/root/testdata/sf0.001", by_page=True), aliases)
    assert sorted(map(str, found.collect())) == sorted(map(str, counted.collect())) != []


def test_clean_cuts_marks_at_the_end_of_a_line_too(spark):
    from pyspark.sql import functions as F

    texts = ["A:", "a::#", "a#:", " B##  ", ":", "", "a:\r", "a#\n", "a:\u2028", "a:b", "\u00e4:#\x85", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim("t")), ":+$", ""), "#+$", "")
    assert all(r.a == r.b for r in df.select(L._clean(F.col("t")).alias("a"), plain.alias("b")).collect())
