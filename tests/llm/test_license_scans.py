"""Licence scans against a brute-force version in plain Python."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from quire.llm import license_scans as L

SCHEMA = "doc_id long, text string, path string, is_license_file boolean, line string"
PROSE = "the of and in this work is by to a\nmany words that no template has\n"
ROWS = (
    [(i, PROSE * 20, f"a/b/{i}", False, "x") for i in range(6)]
    + [(10, "Released under the MIT License.", "a/LICENSE", True, "x"), (11, "x\nLicensed under the Apache License, Version 2.0.", "a/b/c/COPYING", True, None), (12, "nothing", "a/b/c/d/f.txt", False, "x")]
    + [(13, "see the MIT page about how students of physics apply for a license to drive", "a/b/z", False, "x"), (14, None, "q/f", False, "x"), (15, "", None, None, "x"), (None, "Licensed under CC BY-NC 4.0.", "q/r/f", False, "x")]
    + [(16, "Licensed under CC BY 4.0.", "q/r/f", False, "x")] * 2
    + [(17, "word " * 20000 + "\nReleased under the MIT License.", "far", False, "x")]
)


def brute(rows):
    terms = lambda t: [x for x in re.split(r"[^a-z0-9]+", t.lower()) if x]
    lines = [ln for r in rows for ln in (r[1] or "").split("\n") if terms(ln)]
    vocab = {t for texts in L.TEMPLATES.values() for x in texts for t in terms(x)}
    df = Counter(t for ln in lines for t in set(terms(ln)) & vocab)
    n = len(lines)
    w = {t: max(L.FLOOR, math.log((1 + n) / (1 + df[t]))) for t in vocab}
    other = min(L.UNKNOWN, math.log(1 + n))
    vec = lambda ts: {t: c * w.get(t, other) for t, c in Counter(ts).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vec(terms(x)), len(terms(x))) for name, texts in L.TEMPLATES.items() for x in texts]
    known = {}

    def close(ts, size):
        """The closest of all templates, or of those of ``size`` terms."""
        key = (tuple(ts), size)
        if key not in known:
            v = vec(ts)
            near = [(-round(sum(v.get(a, 0) * b for a, b in t.items()) / (norm(v) * norm(t)), 4), name) for name, t, k in templates if norm(v) and norm(t) and size in (0, k) and not v.keys().isdisjoint(t)]
            known[key] = min((f for f in near if f[0] <= -L.THRESHOLD), default=None)
        return known[key]

    def best(text):
        """Of every line, and of every window of as many terms as a template has, across lines."""
        ts = terms(text or "")
        found = [close(terms(ln), 0) for ln in (text or "").split("\n") if terms(ln)]
        found += [close(ts[i : i + k], k) for k in {k for _, _, k in templates} for i in range(max(1, len(ts) - k + 1)) if ts]
        return min((f for f in found if f), default=None)

    up = lambda p: (p or "").rpartition("/")[0]
    files = {}
    for r in rows:
        if r[3] and (b := best(r[1])):
            files.setdefault(up(r[2]), []).append((*b, r[2]))
    out = []
    for r in rows:
        b, d, got = best(r[1]), up(r[2]), None
        while True:
            if d in files:
                got = min(files[d])
                break
            if not d:
                break
            d = up(d)
        out.append((r[0], r[2], b[1] if b else got and got[1], -b[0] if b else None, "own" if b else "inherited" if got else None, got[2] if got and not b else None))
    return sorted(map(str, out))


APACHE = L.TEMPLATES["Apache-2.0"][1]
#: Notices within other words, broken into lines, with words inserted, one after the other, and shorter than their template.
NOTICES = [
    f"some words before it {APACHE} and some after it that no template has",
    APACHE.replace(" ", "\n"),
    " ".join(f"{w} uh" if i % 6 == 5 else w for i, w in enumerate(APACHE.split())),
    "\n".join(t for texts in L.TEMPLATES.values() for t in texts),
    "MIT license",
    "the the the version version license",
    "first part of the text " * 5 + "Released under the BSD 3-Clause\nLicense. " + "more of the text here " * 5,
    "Copyright 2001 somebody\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated files",
]


def test_against_brute_force(spark):
    # Many lines without licence words, so that the licence words are rare.
    rows = ROWS + [(100 + i, "\n".join(f"plain{j} text{i}" for j in range(200)), f"p/{i}", False, "x") for i in range(20)]
    rows += [(200 + i, t, f"n{i}/f", i % 2 == 0, "x") for i, t in enumerate(NOTICES)] + [(300 + i, "nothing", f"n{i}/sub/g", False, "x") for i in range(len(NOTICES))]
    assert sorted(str(tuple(r)) for r in L.scan(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


def test_against_brute_force_where_licence_words_are_in_most_lines(spark):
    rows = [(i, "\n".join([APACHE, L.TEMPLATES["MIT"][0], "the license version"] * 3), f"d/{i}", False, "x") for i in range(4)] + [(50 + i, t, f"n{i}/f", False, "x") for i, t in enumerate(NOTICES)]
    assert sorted(str(tuple(r)) for r in L.scan(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


def test_inheritance(spark):
    rows = ROWS + [(100 + i, "\n".join(f"plain{j} text{i}" for j in range(200)), f"p/{i}", False, "x") for i in range(20)]
    got = {r["doc_id"]: r for r in L.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[0]["license"], got[0]["licensed_by"]) == ("MIT", "a/LICENSE")
    assert (got[12]["license"], got[12]["licensed_by"]) == ("Apache-2.0", "a/b/c/COPYING")
    assert got[13]["found"] == "inherited" and got[14]["license"] is None and got[17]["license"] == "MIT"


def test_frequent_licence_is_found(spark):
    # Every third text of few lines has the notice: its words are in far more than 1 % of the lines.
    hot = [(i, "some plain words\nReleased under the MIT License.\nmore words" if i % 3 == 0 else f"plain text {i}\nand more", f"h/{i}/f", False, "x") for i in range(90)]
    rows = hot + [(100, "Released under the MIT License.", "k/LICENSE", True, "x"), (101, "nothing here", "k/s/f", False, "x")]
    out = L.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: r["license"] for r in out} == {r[0]: "MIT" if r[0] % 3 == 0 and r[0] < 100 or r[0] >= 100 else None for r in rows}
    assert sorted(str(tuple(r)) for r in out) == brute(rows)


def test_key_terms_lose_no_line():
    template = {"released": 3.0, "under": 2.0, "the": 0.5, "mit": 4.0, "license": 3.0}
    keys, whole = L.key_terms(template, 0.6), sum(x * x for x in template.values())
    assert sum(x * x for t, x in template.items() if t not in keys) < 0.36 * whole and keys < set(template)
    assert L.key_terms(template, 0.0) == set(template)


def test_notices_with_other_words_and_broken_lines(spark):
    words = " ".join(f"word{i}" for i in range(300))
    header = "# Licensed under the Apache License,\n# Version 2.0 (the \"License\"); you may not use\n# this file except in compliance with the License."
    texts = ["Acme: released under the MIT License.", "Copyright 2020 Acme Corp. Released under the MIT License. See there.", f"{words} Released under the MIT License. {words}", f"{words}\n{header}\n{words}", "a word that is known to license nobody"]
    rows = [(i, t, f"t{i}/f", False, "x") for i, t in enumerate(texts)]
    for filler in (10, 4000):  # lines without licence words: the corpus grows, the answers stay
        grown = rows + [(100 + i, "\n".join(f"plain{j} text{i}" for j in range(filler // 10)), f"p/{i}", False, "x") for i in range(10)]
        got = {r["doc_id"]: r["license"] for r in L.scan(spark.createDataFrame(grown, SCHEMA)).collect()}
        assert [got[i] for i in range(5)] == ["MIT", "MIT", "MIT", "Apache-2.0", None]


def test_unknown_words_weigh_no_more_in_a_larger_corpus(spark):
    docs = lambda n: spark.range(n).select(F.concat(F.lit("plain words"), F.when(F.col("id") % 200 == 0, "\nmit").otherwise("")).alias("text")).union(spark.range(n).select(F.lit("other")))
    small, large = ({r["term"]: r["w"] for r in L.idf(docs(n), ["mit"]).collect()} for n in (2000, 200000))
    assert small[""] == large[""] == L.UNKNOWN


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], SCHEMA)).count() == 0
