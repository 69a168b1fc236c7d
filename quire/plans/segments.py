"""Queries of the segmentation operators, over conversations as composite faxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import bindings as B
from quire.bindings import with_sql
from quire.operators import segments as S
from quire.plans.merge import _payer_sql
from quire.plans.registry import query


def _pages(spark, sf_dir):
    """A page's payer is the first letter class of its text; its confidence follows the page's number of words."""
    p = B.page(spark, sf_dir).drop("payer", "text")
    key = (F.col("word_count") + F.col("page_number")) % 4
    return p.withColumns({"payer": F.when(key == 0, "ANTHEM").when(key == 1, "MOLINA").when(key == 2, "HUMANA"), "payer_confidence": F.col("word_count") % 10 / 10.0})


_PAGES = """pages AS (SELECT job_id, page_number, is_cover, word_count, word_count < 20 AS sparse, word_count % 10 / 10.0::DOUBLE AS payer_confidence,
  CASE (word_count + page_number) % 4 WHEN 0 THEN 'ANTHEM' WHEN 1 THEN 'MOLINA' WHEN 2 THEN 'HUMANA' END AS payer FROM page)"""
_BOUNDED = f"""{_PAGES}, a AS (SELECT *, row_number() OVER w AS i, sum(is_cover::INTEGER) OVER (w ROWS UNBOUNDED PRECEDING) - (first_value(is_cover) OVER w)::INTEGER AS epoch,
  lag(sparse) OVER w AS sparse1, lag(is_cover) OVER w AS cover1, lag(payer, 2) OVER w AS payer2 FROM pages WINDOW w AS (PARTITION BY job_id ORDER BY page_number)),
b AS (SELECT *, last_value(CASE WHEN i = 1 OR NOT is_cover AND payer_confidence >= 0.5::DOUBLE THEN payer END IGNORE NULLS) OVER (PARTITION BY job_id, epoch ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM a),
bounded AS (SELECT *, CASE WHEN i = 1 THEN 'start' WHEN is_cover THEN 'cover_page' WHEN payer IS NOT NULL AND payer_confidence >= 0.5::DOUBLE AND prev IS NOT NULL AND payer <> prev THEN 'payer_change'
  WHEN sparse1 AND NOT sparse AND NOT cover1 AND payer IS NOT NULL AND payer_confidence >= 0.5::DOUBLE AND payer2 <> payer THEN 'sparse_separator' END AS reason FROM b),
seg AS (SELECT *, (sum((reason IS NOT NULL)::INTEGER) OVER (PARTITION BY job_id ORDER BY page_number ROWS UNBOUNDED PRECEDING) - 1)::INTEGER AS segment FROM bounded)"""
_VOTES = f"""{_BOUNDED}, votes AS (SELECT job_id, segment, pages, first_page, has_cover, payer, round(coalesce(v / pages, 0.0), 4) AS payer_confidence FROM (
  SELECT job_id, segment, count(*) AS pages, min(page_number) AS first_page, arg_min(is_cover, page_number) AS has_cover FROM seg GROUP BY ALL) LEFT JOIN (
  SELECT job_id, segment, payer, v FROM (SELECT job_id, segment, payer, round(sum(payer_confidence), 6) AS v, min(page_number) AS f FROM seg WHERE payer IS NOT NULL AND NOT is_cover GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY job_id, segment ORDER BY v DESC, f) = 1) USING (job_id, segment))"""


@query(with_sql("page", f"WITH {_BOUNDED} SELECT job_id, page_number, reason FROM bounded"))
def e3_boundaries(spark, sf_dir):
    return S.boundaries(_pages(spark, sf_dir)).select("job_id", "page_number", "reason")


@query(with_sql("page", f"WITH {_BOUNDED} SELECT job_id, page_number, reason FROM bounded"))
def e3_boundaries_scan(spark, sf_dir):
    return S.scanned_boundaries(_pages(spark, sf_dir))


@query(with_sql("page", f"WITH {_BOUNDED} SELECT job_id, page_number, segment FROM seg"))
def e4_segments(spark, sf_dir):
    return S.numbered(S.boundaries(_pages(spark, sf_dir))).select("job_id", "page_number", "segment")


@query(with_sql("page", f"""WITH {_BOUNDED} SELECT job_id, page_number, (sum(s) OVER (PARTITION BY job_id ORDER BY page_number ROWS UNBOUNDED PRECEDING) - 1)::INTEGER AS segment FROM (
SELECT *, (reason IS NOT NULL AND (count(*) OVER (PARTITION BY job_id, segment) >= 2 OR i = 1))::INTEGER AS s FROM seg)"""))
def e4_merged_segments(spark, sf_dir):
    return S.merged(S.numbered(S.boundaries(_pages(spark, sf_dir))), 2).select("job_id", "page_number", "segment")


@query(with_sql("page", f"WITH {_VOTES} SELECT * FROM votes"))
def d18_segment_payers(spark, sf_dir):
    return S.payer_votes(S.numbered(S.boundaries(_pages(spark, sf_dir))))


@query(with_sql("page", f"""WITH {_VOTES} SELECT job_id, segment, payer FROM votes QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY payer_confidence DESC, segment) = 1 AND sum(pages) OVER (PARTITION BY job_id) >= 4 AND count(*) OVER (PARTITION BY job_id) > 1"""))
def i21_active_segment(spark, sf_dir):
    return S.active(S.payer_votes(S.numbered(S.boundaries(_pages(spark, sf_dir)))))


@query(with_sql("page", f"""WITH {_BOUNDED} SELECT job_id, page_number, segment FROM seg QUALIFY NOT (page_number = min(page_number) OVER (PARTITION BY job_id, segment) AND is_cover AND count(*) OVER (PARTITION BY job_id, segment) > 1)"""))
def n4_content_pages(spark, sf_dir):
    return S.content_pages(S.numbered(S.boundaries(_pages(spark, sf_dir)))).select("job_id", "page_number", "segment")


#: Words that occur in the stand-in texts, often enough for changes of payer.
_COVER_WORDS = ("with", "from", "and.")
_SIGNATURES = {"FIRST": (("this", "tion"), ("with", "that"), ("license",)), "SECOND": (("ther",), ("from", "eron", "erin", "the,"), ()), "THIRD": ((), ("than", "und", "les", "the."), ("this",))}
_TEXT_PAGES = f"""documents AS (SELECT conv_id::VARCHAR || ':' || turn AS doc_id, coalesce(text, '') AS text FROM conversations), named AS ({_payer_sql(0.3, "NULL", _SIGNATURES)}),
pages AS (SELECT job_id, page_number, is_cover OR ({" + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INTEGER" for w in _COVER_WORDS)}) >= 2 AS is_cover, coalesce(word_count, 0) < 20 AS sparse, score::DOUBLE AS payer_confidence, named.payer AS payer
  FROM page JOIN named ON doc_id = job_id::VARCHAR || ':' || page_number)"""


@query(with_sql("page", f"""WITH {_VOTES.replace(_PAGES, _TEXT_PAGES)}, moved AS (SELECT job_id, page_number, segment AS before, reason,
  (sum((reason IS NOT NULL AND (n >= 2 OR i = 1))::INTEGER) OVER (PARTITION BY job_id ORDER BY page_number ROWS UNBOUNDED PRECEDING) - 1)::INTEGER AS segment FROM (SELECT *, count(*) OVER (PARTITION BY job_id, segment) AS n FROM seg)),
made AS (SELECT job_id, segment, string_agg(page_number::VARCHAR, ',' ORDER BY page_number) AS page_numbers, min(before) AS before, arg_min(reason, page_number) AS reason FROM moved GROUP BY ALL)
SELECT made.job_id, made.segment, made.page_numbers, payer, payer_confidence, has_cover, reason, count(*) OVER (PARTITION BY made.job_id) > 1 AS composite FROM made JOIN votes ON votes.job_id = made.job_id AND votes.segment = made.before"""))
def i24_document_segments(spark, sf_dir):
    texts = B.page(spark, sf_dir).select("job_id", "page_number", "text", F.col("is_cover").alias("known_cover"))
    out = S.detected(texts, _COVER_WORDS, _SIGNATURES, least=2)
    return out.withColumn("page_numbers", F.array_join(F.transform("page_numbers", lambda n: n.cast("string")), ","))
