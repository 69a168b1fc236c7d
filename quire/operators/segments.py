"""Composite documents: boundaries, segments and their payers (E3, E4, D18, I21, N4), and all of it from page texts (I24). Pages: job_id, page_number, payer, payer_confidence, is_cover, word_count."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import classify
from quire.rules import PAYER_SIGNATURES

SPARSE = 20
BOUNDARIES = "job_id long, page_number long, reason string"


def boundaries(pages: DataFrame, threshold: float = 0.50) -> DataFrame:
    """Every page with ``reason``, set where a document starts: the first page, a cover, a change of payer, a sparse separator.

    The payer that a page is compared with is the last one seen with enough confidence since the last cover: a last
    value over a frame that a cover cuts. The first page's payer counts whatever its confidence.
    """
    order = Window.partitionBy("job_id").orderBy("page_number")
    p = pages.withColumns({"_i": F.row_number().over(order), "_covers": F.sum(F.col("is_cover").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    # The first page is the start whether it is a cover or not, and its payer is remembered either way.
    epoch = F.when(F.first("is_cover").over(order), F.col("_covers") - 1).otherwise(F.col("_covers"))
    p = p.withColumn("_epoch", epoch)
    seen = F.when((F.col("_i") == 1) | (~F.col("is_cover") & (F.col("payer_confidence") >= threshold)), F.col("payer"))
    before = Window.partitionBy("job_id", "_epoch").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("_prev", F.last(seen, ignorenulls=True).over(before))
    sure = F.col("payer").isNotNull() & (F.col("payer_confidence") >= threshold)
    change = sure & F.col("_prev").isNotNull() & (F.col("payer") != F.col("_prev"))
    sparse = F.col("word_count") < SPARSE
    gap = F.lag(sparse).over(order) & ~sparse & ~F.lag("is_cover").over(order) & sure & (F.lag("payer", 2).over(order) != F.col("payer"))
    reason = F.when(F.col("_i") == 1, "start").when(F.col("is_cover"), "cover_page").when(change, "payer_change").when(gap, "sparse_separator")
    return p.withColumn("reason", reason).drop("_i", "_covers", "_epoch", "_prev")


def scanned_boundaries(pages: DataFrame, threshold: float = 0.50) -> DataFrame:
    """The same rule as a plain scan of each job's pages, to hold ``boundaries`` against."""

    def scan(job: pd.DataFrame) -> pd.DataFrame:
        job = job.sort_values("page_number").reset_index(drop=True)
        known = lambda x: x is not None and x == x
        reasons, tracked = [], None
        for i, row in job.iterrows():
            payer, sure = row["payer"], known(row["payer"]) and row["payer_confidence"] >= threshold
            if i == 0:
                reasons.append("start")
                tracked = payer if known(payer) else None
                continue
            if row["is_cover"]:
                reasons.append("cover_page")
                tracked = None
                continue
            if sure and tracked is not None and payer != tracked:
                reasons.append("payer_change")
                tracked = payer
                continue
            last = job.iloc[i - 1]
            older = job.iloc[i - 2]["payer"] if i >= 2 else None
            separated = last["word_count"] < SPARSE <= row["word_count"] and not last["is_cover"] and sure and known(older) and older != payer
            reasons.append("sparse_separator" if separated else None)
            tracked = payer if sure else tracked
        return pd.DataFrame({"job_id": job["job_id"], "page_number": job["page_number"], "reason": reasons})

    slim = pages.select("job_id", "page_number", "payer", "payer_confidence", "is_cover", "word_count")
    return slim.groupBy("job_id").applyInPandas(scan, BOUNDARIES)


def numbered(bounded: DataFrame) -> DataFrame:
    """Pages of ``boundaries`` with ``segment``, from 0 in each job."""
    order = Window.partitionBy("job_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    return bounded.withColumn("segment", (F.sum(F.col("reason").isNotNull().cast("int")).over(order) - 1).cast("int"))


def merged(segments: DataFrame, least: int) -> DataFrame:
    """Segments of fewer than ``least`` pages joined to the one before; the first stays."""
    size = F.count("*").over(Window.partitionBy("job_id", "segment"))
    order = Window.partitionBy("job_id").orderBy("page_number")
    start = (F.col("reason").isNotNull()) & ((F.col("_size") >= least) | (F.row_number().over(order) == 1))
    s = segments.withColumn("_size", size).withColumn("_start", start.cast("int"))
    return s.withColumn("segment", (F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_size", "_start")


def payer_votes(segments: DataFrame) -> DataFrame:
    """One row per segment: pages, whether it opens with a cover, and the payer with the most confidence over pages that are no cover, divided by all pages; ties go to the payer seen first."""
    votes = segments.where(F.col("payer").isNotNull() & ~F.col("is_cover")).groupBy("job_id", "segment", "payer").agg(F.sum("payer_confidence").alias("votes"), F.min("page_number").alias("first"))
    best = votes.groupBy("job_id", "segment").agg(F.min(F.struct((-F.round("votes", 6)).alias("minus"), "first", "payer")).alias("b"))
    size = segments.groupBy("job_id", "segment").agg(F.count("*").alias("pages"), F.min("page_number").alias("first_page"), F.min_by("is_cover", "page_number").alias("has_cover"))
    met = size.join(best, ["job_id", "segment"], "left")
    return met.select("job_id", "segment", "pages", "first_page", "has_cover", F.col("b.payer").alias("payer"), F.round(F.coalesce(-F.col("b.minus") / F.col("pages"), F.lit(0.0)), 4).alias("payer_confidence"))


def active(votes: DataFrame, least_pages: int = 4) -> DataFrame:
    """The segment to go on with of each job that has several and at least ``least_pages`` pages: the surest payer, the first of equals."""
    jobs = votes.groupBy("job_id").agg(F.sum("pages").alias("n"), F.count("*").alias("segments"), F.min(F.struct((-F.col("payer_confidence")).alias("minus"), "segment", "payer")).alias("b"))
    return jobs.where((F.col("n") >= least_pages) & (F.col("segments") > 1)).select("job_id", F.col("b.segment").alias("segment"), F.col("b.payer").alias("payer"))


def content_pages(segments: DataFrame) -> DataFrame:
    """Pages of segments without the cover they open with, if it is not all they have."""
    w = Window.partitionBy("job_id", "segment")
    first = F.col("page_number") == F.min("page_number").over(w)
    return segments.withColumn("_drop", first & F.col("is_cover") & (F.count("*").over(w) > 1)).where("NOT _drop").drop("_drop")


def described(texts: DataFrame, cover_keywords: Sequence[str], signatures: Mapping = PAYER_SIGNATURES) -> DataFrame:
    """Pages as ``boundaries`` takes them, from job_id, page_number, text and known_cover. A null text names nothing and has no words."""
    text = F.coalesce("text", F.lit(""))
    payer, sure = classify.page_payer(text, signatures)
    cover = F.coalesce("known_cover", F.lit(False)) | classify.is_cover(text, cover_keywords)
    words = F.size(F.array_remove(F.split(text, r"(?U)\s+", -1), ""))
    return texts.select("job_id", "page_number", payer.alias("payer"), sure.alias("payer_confidence"), cover.alias("is_cover"), words.alias("word_count"))


def detected(texts: DataFrame, cover_keywords: Sequence[str], signatures: Mapping = PAYER_SIGNATURES, least: int = 1, threshold: float = 0.50) -> DataFrame:
    """One row for each document within a job: segment, page_numbers, payer, payer_confidence, has_cover, reason, composite.

    Segments of fewer than ``least`` pages add their pages to the one before, which keeps its own payer and confidence.
    """
    first = numbered(boundaries(described(texts, cover_keywords, signatures), threshold))
    known = payer_votes(first).join(first.where("reason IS NOT NULL").select("job_id", "segment", "reason"), ["job_id", "segment"])
    pages = merged(first.withColumn("_before", F.col("segment")), least) if least > 1 else first.withColumn("_before", F.col("segment"))
    lists = pages.groupBy("job_id", "segment").agg(F.array_sort(F.collect_list("page_number")).alias("page_numbers"), F.min("_before").alias("_before"))
    out = lists.join(known.withColumnRenamed("segment", "_before"), ["job_id", "_before"])
    composite = F.count("*").over(Window.partitionBy("job_id")) > 1
    return out.select("job_id", "segment", "page_numbers", "payer", "payer_confidence", "has_cover", "reason", composite.alias("composite"))
