"""Licence scans: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

The terms are those of the templates; a term's inverse document frequency is taken over every line of every text, and is
at least ``FLOOR``, so that every term of a template counts however common it is. Words outside the templates weigh as
much as a term that no line has, but at most ``UNKNOWN`` however many lines there are, so a sentence that merely mentions
a licence stays far from its template.

Compared are each line with all templates, and each window of a text, across its lines, with the templates that have as
many terms: a notice inside a long line, one with other words around it and one that is broken into lines is such a
window. A cosine is at most the share of the template's length that its terms in the line have; the ``key_terms`` are
those without which no line gets to the threshold, so only lines with one are compared, and only windows whose terms
make the share large enough, each different line or window once however many documents have it.

A file's licence is that of its closest line or window. A directory has the licence of its closest licence file. A file without
a licence of its own takes the one of the nearest directory above it: each directory's ancestors are joined by path
with the directories that have one, and the longest path wins. Every document is one output row.

Defined results: null and empty texts have no lines; a null path lies in the root directory; ties in similarity go to
the licence that sorts first; repeated rows each get their own row; columns beside doc_id, text, path and is_license_file
are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.native import let
from quire.llm.storage import cut, stored

THRESHOLD = 0.6
FLOOR = 0.1
#: Most weight of a word outside the templates: that of a term in one of a thousand lines.
UNKNOWN = 6.9

# Short notices of public licences, by SPDX identifier.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    "LGPL-3.0-only": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.",),
    "Proprietary": ("All rights reserved. No part may be reproduced without permission.",),
}
TERM = r"[^a-z0-9]+"


def terms(text: Column) -> Column:
    """The terms of a text in lower case."""
    return F.array_remove(F.split(text, TERM, -1), "")


def template_terms(docs: DataFrame, templates: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """license, template number, term, tf: a few hundred rows, as many as the templates have terms."""
    rows = [(name, i, text) for name, texts in sorted(templates.items()) for i, text in enumerate(texts)]
    t = docs.sparkSession.createDataFrame(rows, "license string, template int, text string")
    return t.select("license", "template", F.explode(terms(F.lower("text"))).alias("term")).groupBy("license", "template", "term").agg(F.count("*").alias("tf"))


def _lines(docs: DataFrame) -> DataFrame:
    """Every line of every text, in lower case."""
    return docs.select(F.explode(F.split(F.lower("text"), "\n", -1)).alias("line"))


def idf(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """term, w: over all lines of all texts; also the row with a null term, the weight of words outside the templates."""
    quoted = ", ".join(f"'{t}'" for t in sorted(vocabulary))
    own = F.expr(f"array_distinct(filter(ts, t -> t IN ({quoted})))")
    found = _lines(docs).select(terms(F.col("line")).alias("ts")).where(F.size("ts") > 0).select(F.explode(F.concat(own, F.array(F.lit("")))).alias("term"))
    df = stored(found.groupBy("term").agg(F.count("*").alias("df")), "term-lines")  # read twice
    n = df.where("term = ''").select(F.col("df").alias("n"))
    known = docs.sparkSession.createDataFrame([(t,) for t in sorted(vocabulary)] + [("",)], "term string")
    counts = known.join(df, "term", "left").crossJoin(F.broadcast(n))  # n is one row, or none in an empty table
    seen = F.when(F.col("term") == "", 0).otherwise(F.coalesce("df", F.lit(0)))
    w = F.log((1.0 + F.col("n")) / (1.0 + seen))
    return counts.select("term", F.when(F.col("term") == "", F.least(F.lit(UNKNOWN), w)).otherwise(F.greatest(F.lit(FLOOR), w)).alias("w"))


def least_share(template: Mapping[str, float], threshold: float) -> float:
    """What the squares of the shared terms of a template (term, weight times count) add up to at least, at the threshold.

    By Cauchy and Schwarz a cosine is at most the norm of the shared terms over that of the template.
    """
    return (max(threshold - 1e-4, 0.0) ** 2) * sum(x * x for x in template.values())  # cosines are rounded to four digits


def key_terms(template: Mapping[str, float], threshold: float) -> set[str]:
    """The weightiest terms of a template: the others together leave a cosine below the threshold."""
    left, keys = least_share(template, threshold), set(template)
    for term, x in sorted(template.items(), key=lambda e: (e[1], e[0])):
        left -= x * x
        if left <= 0:
            break
        keys.remove(term)
    return keys


def _windows(ts: Column, hits: Column, template: Mapping[str, float], size: int, threshold: float) -> Column:
    """The windows of ``size`` terms that share enough with a template; ``hits`` are the places of key terms."""
    keys, n = sorted(key_terms(template, threshold)), F.size(ts)
    own = F.filter(hits, lambda p: F.get(ts, p - 1).isin(keys))
    begin = lambda p: F.sequence(F.greatest(F.lit(1), p - (size - 1)), F.greatest(F.lit(1), F.least(p, n - (size - 1))))
    cuts = F.transform(F.array_distinct(F.flatten(F.transform(own, begin))), lambda at: F.slice(ts, at, F.lit(size)))
    terms_ = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(x * x).alias("x")) for t, x in sorted(template.items())))
    share = lambda c: F.aggregate(terms_, F.lit(0.0), lambda sum_, e: sum_ + F.when(F.array_contains(c, e["t"]), e["x"]).otherwise(0.0))
    near = F.filter(cuts, lambda c: share(c) >= least_share(template, threshold) - 1e-9)
    return F.transform(near, lambda c: F.struct(F.array_join(c, " ").alias("line"), F.lit(size).alias("span")))


def lines_worth_comparing(docs: DataFrame, vectors: list[tuple[dict[str, float], int]], threshold: float) -> DataFrame:
    """``docs`` without text, a row for each different ``line`` (``span`` 0) with a key term and each window of ``span`` terms.

    ``vectors`` are the templates, each with its number of terms.
    """
    keys = sorted(set().union(*(key_terms(v, threshold) for v, _ in vectors)))
    term = r"(?<![a-z0-9])(?:" + "|".join(keys) + r")(?![a-z0-9])" if keys else r"(?!)"
    rest = [c for c in docs.columns if c != "text"]
    lower = docs.select(*rest, F.lower("text").alias("text")).where(F.col("text").rlike(term))
    lines = F.transform(F.filter(F.array_distinct(F.split("text", "\n", -1)), lambda x: x.rlike(term)), lambda x: F.struct(x.alias("line"), F.lit(0).alias("span")))
    hits = lambda ts: F.filter(F.sequence(F.lit(1), F.size(ts)), lambda p: F.get(ts, p - 1).isin(keys))
    each = lambda ts, at: F.array_distinct(F.flatten(F.array(*(_windows(ts, at, v, size, threshold) for v, size in vectors))))
    found = F.concat(lines, let(terms(F.col("text")), lambda ts: let(hits(ts), lambda at: each(ts, at)))) if vectors else lines
    each_ = lower.select(*rest, F.explode_outer(found).alias("u")).where("u IS NOT NULL")  # outer: no filter that computes the array again
    return each_.select(*rest, "u.line", "u.span")


def closest(lines: DataFrame, tt: DataFrame, weights: Mapping[str, float], threshold: float = THRESHOLD) -> DataFrame:
    """``line``, ``span``, ``license``, ``similarity`` of the different lines and windows that are close enough to a template."""
    spark = lines.sparkSession
    lines = lines.groupBy("line", "span").agg(F.count("*").alias("n_lines")).select("line", "span")
    w = spark.createDataFrame([(t, x) for t, x in sorted(weights.items()) if t], "term string, w double")
    tv = tt.join(w, "term").select("license", "template", "term", "tf", (F.col("tf") * F.col("w")).alias("tw"))
    norms = tv.groupBy("license", "template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"), F.sum("tf").cast("int").alias("size"))
    tv = cut(tv.drop("tf").join(norms, ["license", "template"]))
    at = lines.select("line", "span", F.explode(terms(F.col("line"))).alias("term")).groupBy("line", "span", "term").agg(F.count("*").alias("tf"))
    lw = at.join(w, "term", "left").select("line", "span", "term", (F.col("tf") * F.coalesce("w", F.lit(weights.get("", 0.0)))).alias("lw"))
    size = lw.groupBy("line", "span").agg(F.sqrt(F.sum(F.col("lw") * F.col("lw"))).alias("ln"))
    met = lw.join(tv, "term").where((F.col("span") == 0) | (F.col("span") == F.col("size")))
    dots = met.groupBy("line", "span", "license", "template").agg(F.sum(F.col("lw") * F.col("tw")).alias("dot"), F.first("tn").alias("tn"))
    cosine = F.round(F.col("dot") / (F.col("ln") * F.col("tn")), 4)
    best = dots.join(size, ["line", "span"]).withColumn("similarity", cosine).where(F.col("similarity") >= threshold).groupBy("line", "span")
    return best.agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "license")).alias("b")).select("line", "span", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("similarity"))


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """The directory and all above it, the root last."""
    parts = F.split(directory, "/", -1)
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_distinct(F.concat(F.reverse(up), F.array(F.lit(""))))


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, similarity, found (``own``, ``inherited`` or null) and licensed_by, for ``docs`` with doc_id, text, path, is_license_file."""
    slim = docs.select("doc_id", "text", "path", "is_license_file", F.xxhash64("path", "text", "is_license_file").alias("_h"))
    tt = cut(template_terms(docs, templates))
    known = tt.collect()  # the templates' own terms
    weights = {r["term"]: r["w"] for r in idf(docs, sorted({r["term"] for r in known})).collect()}
    vectors: dict[tuple[str, int], tuple[dict[str, float], int]] = {}
    for r in known if weights else ():
        vector, size = vectors.get((r["license"], r["template"]), ({}, 0))
        vectors[r["license"], r["template"]] = ({**vector, r["term"]: r["tf"] * weights[r["term"]]}, size + r["tf"])
    lines = stored(lines_worth_comparing(slim, [vectors[k] for k in sorted(vectors)], threshold), "licence-lines")
    own = lines.join(closest(lines, tt, weights, threshold), ["line", "span"]).groupBy("doc_id", "_h", "path", "is_license_file").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "license")).alias("b"))
    own = cut(own.select("doc_id", "_h", "path", "is_license_file", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("similarity")))
    files = own.where("is_license_file").groupBy(parent(F.col("path")).alias("licensed_dir")).agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "license", "path")).alias("f"))
    dirs = slim.select(parent(F.col("path")).alias("dir")).distinct().withColumn("up", F.explode(ancestors(F.col("dir"))))
    near = dirs.join(files, F.col("up") == F.col("licensed_dir")).groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "f")).alias("x"))
    near = near.select(F.col("dir").alias("_dir"), F.col("x.f.license").alias("_inherited"), F.col("x.f.path").alias("_from"))
    mine = own.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_oh"), F.col("license").alias("_own"), "similarity")
    out = slim.select("doc_id", "path", "_h").join(mine, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_oh")), "left")
    out = out.join(near, parent(F.col("path")) == F.col("_dir"), "left")
    return out.select(
        "doc_id", "path", F.coalesce("_own", "_inherited").alias("license"), "similarity",
        F.when(F.col("_own").isNotNull(), "own").when(F.col("_inherited").isNotNull(), "inherited").alias("found"),
        F.when(F.col("_own").isNull(), F.col("_from")).alias("licensed_by"),
    )


def as_files(documents: DataFrame) -> DataFrame:
    """The documents as a tree of files: source, language, then a folder of 64 ids; short texts stand in for licence files."""
    folder = F.format_string("d%d", F.floor(F.col("doc_id") / 64))
    short = F.coalesce(F.length("text") <= 800, F.lit(False))
    return documents.select("doc_id", "text", F.concat_ws("/", F.col("source"), F.col("lang"), folder, F.col("doc_id").cast("string")).alias("path"), short.alias("is_license_file"))
