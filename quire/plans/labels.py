"""Queries of the label operators, over documents cut into tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import bindings as B
from quire.bindings import with_sql
from quire.operators import labels as L
from quire.plans.registry import query

#: Labels that occur in the stand-in texts.
ALIASES = (("license", "license"), ("license", "under the license:"), ("version", "version"), ("released", "released under the"), ("token", "token #"))


@query()
def c12_find_labels(spark, sf_dir):
    aliases = spark.createDataFrame(list(ALIASES), "field_key string, label string")
    found = L.find_labels(B.ocr_token(spark, sf_dir, placed=True), aliases)
    words = F.transform("tokens", lambda x: F.concat_ws(":", x["line_number"].cast("string"), x["word_number"].cast("string")))
    return found.select("page_id", "field_key", "label", "score", "inline", F.array_join(words, ",").alias("tokens"))


@query(with_sql("ocr_token", """WITH l AS (SELECT page_id, line_number AS ll, word_number AS lw, x0 AS lx0, x1 AS lx1, y1 AS ly1 FROM ocr_token WHERE lower(token_text) = 'die'),
m AS (SELECT t.*, ll, lw, token_text LIKE '%:' OR lower(token_text) IN ('die', 'und') AS lab FROM ocr_token t JOIN l USING (page_id) WHERE y0 >= ly1 - 0.005::DOUBLE AND y0 <= ly1 + greatest(0.015::DOUBLE * 2.5, 0.06::DOUBLE) AND x0 < lx1 + 0.06::DOUBLE AND x1 > lx0 - 0.03::DOUBLE AND NOT (line_number = ll AND word_number = lw)),
f AS (SELECT *, arg_min(line_number, struct_pack(a := y0, b := x0, c := line_number)) FILTER (NOT lab) OVER (PARTITION BY page_id, ll, lw) AS fv FROM m),
o AS (SELECT *, sum((line_number > fv + 1)::INTEGER) OVER (PARTITION BY page_id, ll, lw ORDER BY y0, x0, line_number, word_number ROWS UNBOUNDED PRECEDING) AS over FROM f)
SELECT page_id, ll AS label_line, lw AS label_word, place, token_text FROM (SELECT *, row_number() OVER (PARTITION BY page_id, ll, lw ORDER BY y0, x0, line_number, word_number)::INTEGER AS place FROM o WHERE over = 0 AND line_number >= fv AND NOT lab) WHERE place <= 4"""))
def e8_below_label(spark, sf_dir):
    t = B.ocr_token(spark, sf_dir)
    at = t.where(F.lower("token_text") == "die").select("page_id", F.col("line_number").alias("label_line"), F.col("word_number").alias("label_word"), F.col("x0").alias("lx0"), F.col("x1").alias("lx1"), F.col("y1").alias("ly1"), F.lit(0.015).alias("row"))
    return L.below_label(t, at, ("die", "und"))


@query(with_sql("page", "SELECT job_id, field_key, page_number FROM (SELECT *, row_number() OVER (PARTITION BY job_id, field_key ORDER BY n DESC, page_number) AS r FROM (SELECT *, count(*) OVER (PARTITION BY job_id, page_number) AS n FROM (SELECT job_id, page_number, unnest(['a', 'b', 'c'][1:1 + word_count % 3]) AS field_key FROM page))) WHERE r = 1"))
def e6_top_page_first(spark, sf_dir):
    keys = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), 1 + F.col("word_count") % 3)
    found = B.page(spark, sf_dir).select("job_id", "page_number", F.explode(keys).alias("field_key"))
    return L.top_page_first(found).select("job_id", "field_key", "page_number")
