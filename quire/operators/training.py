"""Training sets: labels from jobs, export groups, balanced sampling, questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRUSTED = ("TEMPLATE_OCR", "HUMAN_REVIEW")
PLACEHOLDERS = ("", "n/a", "none", "unknown", "-", "null")


def trainable(fields: DataFrame, keys: Sequence[str], trusted: Sequence[str] = TRUSTED, sure: float = 0.80, least: float = 0.50) -> DataFrame:
    """Field values fit to learn from: a wanted field, a trusted method or a high confidence, and no placeholder."""
    good = F.col("method").isin(*trusted) | (F.col("confidence") >= sure)
    return fields.where(F.col("field_key").isin(*keys) & good & (F.col("confidence") >= least) & ~F.lower(F.trim("value")).isin(*PLACEHOLDERS))


def valid_truth(value: Column, pattern: str | None = None) -> Column:
    v = F.trim(value)
    return (F.length(v) >= 2) & ~F.lower(v).isin(*PLACEHOLDERS) & (v.rlike(pattern) if pattern else F.lit(True))


def new_labels(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Labels whose (job, field) is not labelled yet."""
    return found.join(existing.select("job_id", "field_key"), ["job_id", "field_key"], "left_anti")


def export_groups(labels: DataFrame) -> DataFrame:
    """Per page the JSON of field to value: of several labels of a field the oldest, and the newest label's payer."""
    oldest = Window.partitionBy("page_id", "field_key").orderBy("created_s", "label_id")
    kept = labels.withColumn("_n", F.row_number().over(oldest)).where("_n = 1")
    truth = kept.groupBy("page_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_key", "value"))))).alias("gt_parse"))
    payer = labels.groupBy("page_id").agg(F.max_by("payer", F.struct("created_s", "label_id")).alias("payer"))
    return truth.join(payer, "page_id")


def review_labels(corrections: DataFrame, pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """A label for each corrected field of a review, on the first page of its job that is no cover.

    corrections: job_id, field_key, corrected_value, reviewer_id; pages: job_id, page_number, is_cover; jobs: job_id, payer,
    doc_type. Jobs that have only covers, or are not there, give no label; of several corrections of a field each gives one.
    """
    first = pages.where(~F.coalesce("is_cover", F.lit(False))).groupBy("job_id").agg(F.min("page_number").alias("page_number"))
    met = corrections.join(first, "job_id").join(jobs.select("job_id", "payer", "doc_type"), "job_id")
    return met.select("job_id", "page_number", "field_key", F.col("corrected_value").alias("ground_truth_value"), "payer", "doc_type", F.lit("human_review").alias("source"), F.col("reviewer_id").alias("created_by"))


def export_lines(groups: DataFrame) -> DataFrame:
    """One JSON line per page, as the trainer reads them: file_name and ground_truth, itself JSON."""
    truth = F.concat(F.lit('{"gt_parse":'), F.col("gt_parse"), F.lit("}"))
    return groups.select(F.to_json(F.struct(F.concat(F.lit("page_"), "page_id", F.lit(".png")).alias("file_name"), truth.alias("ground_truth"))).alias("line"))


def balanced(pairs: DataFrame, key: str, order: str, seed: int = 42) -> DataFrame:
    """Each class as often as the largest: every row once, and the rest drawn again by a seeded hash, the lowest first, round after round.

    A row's place in its class is the number of rows in the cells of the hash before its own, and its place in the cell, so a
    class is spread over its 65,536 cells. Rows without a class are left out.
    """
    hashed = pairs.where(F.col(key).isNotNull()).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(order).cast("string"))))
    hashed = hashed.withColumn("_cell", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    cells = hashed.groupBy(key, "_cell").agg(F.count("*").alias("_c"))
    every = Window.partitionBy(key)
    before = F.coalesce(F.sum("_c").over(every.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(F.col(key).alias("_key"), F.col("_cell").alias("_at"), before.alias("_before"), F.sum("_c").over(every).alias("_n"))
    top = hashed.groupBy(key).agg(F.count("*").alias("_c")).agg(F.max("_c").alias("_top"))
    own = F.row_number().over(Window.partitionBy(key, "_cell").orderBy("_h", order)) - 1
    p = hashed.withColumn("_own", own).join(cells, (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_at"))).crossJoin(F.broadcast(top))  # one row
    whole = F.floor(F.col("_top") / F.col("_n"))
    times = whole + F.when(F.col("_before") + F.col("_own") < F.col("_top") - whole * F.col("_n"), 1).otherwise(0)
    return p.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*pairs.columns, "copy")


def retrain_due(labels: DataFrame, models: DataFrame, kind: str, least: int = 20) -> DataFrame:
    """One row: labels made since the last model of a kind, and whether they are enough to train again."""
    last = models.where(F.upper("model_type") == kind.upper()).agg(F.coalesce(F.max("created_s"), F.lit(-(2**62))).alias("last"))
    n = labels.crossJoin(F.broadcast(last)).agg(F.count_if(F.col("created_s") > F.col("last")).alias("new_labels"))  # one row
    return n.withColumn("due", F.col("new_labels") >= least)


def questions(labels: DataFrame, asked: Mapping[str, Sequence[str]]) -> DataFrame:
    """A row for each label and each way to ask for its field."""
    table = labels.sparkSession.createDataFrame([(k, q) for k, qs in sorted(asked.items()) for q in qs], "field_key string, question string")
    return labels.join(F.broadcast(table), "field_key")  # as many rows as there are ways to ask


# The states of jobs, the methods and the marks of file names that the training set goes by.
TRAINING_STATES = ("COMPLETED", "NEEDS_REVIEW", "REVIEW_REQUIRED")
TRAINING_METHODS = ("TEMPLATE_OCR", "OCR_LABEL", "LAYOUTLM", "HUMAN_REVIEW")
TEMPLATE_FILES = ("humana", "anthem", "molina", "caresource", "buckeye", "amerihealth", "paramount", "promedica")


def best_pages(pages: DataFrame, target: int = 1) -> DataFrame:
    """Per job the page to learn from: no cover if there is another page, the target page if it is there, else the first.

    ``pages``: job_id, page_id, page_number, is_cover, raw_key, preprocessed_key; the result has ``page_key``, the
    preprocessed image's if there is one. Of equal page numbers the smallest page_id is taken.
    """
    rank = F.struct(F.coalesce("is_cover", F.lit(False)).alias("cover"), (F.col("page_number") != target).alias("other"), "page_number", "page_id")
    key = F.coalesce(F.nullif("preprocessed_key", F.lit("")), F.nullif("raw_key", F.lit("")))
    one = pages.withColumn("_key", key).groupBy("job_id").agg(F.min_by(F.struct("page_id", "page_number", F.col("_key").alias("page_key")), rank).alias("p"))
    return one.select("job_id", "p.*")


def is_template_file(name: Column, marks: Sequence[str] = TEMPLATE_FILES) -> Column:
    return F.coalesce(F.lower(name).rlike("|".join(marks)), F.lit(False))


def training_labels(jobs: DataFrame, fields: DataFrame, pages: DataFrame, existing: DataFrame, keys: Sequence[str], least: float, source: str = "all") -> DataFrame:
    """The labels to add to the training set (J11): one for each field fit to learn from and not labelled yet.

    ``jobs``: job_id, filename, payer, doc_type, status; those in a final state with a known payer count. ``fields``: job_id,
    field_key, value, confidence, method, one row for each key of a job. ``existing``: job_id, field_key. ``source`` is
    all, templates or batch3 (what is no template's file). Jobs without a page, and pages without an image, give nothing.
    """
    template = is_template_file(F.col("filename"))
    j = jobs.where(F.col("status").isin(*TRAINING_STATES) & ~F.col("payer").isin("UNKNOWN", "")).withColumn("_template", template)
    j = j.where(F.col("_template") == (source == "templates")) if source != "all" else j
    value, sure = F.trim(F.coalesce("value", F.lit(""))), F.coalesce("confidence", F.lit(0.0))
    method = F.upper(F.coalesce("method", F.lit("")))
    good = F.col("field_key").isin(*keys) & ~F.lower(value).isin(*PLACEHOLDERS) & (sure >= least) & (method.isin("", *TRAINING_METHODS) | (sure >= 0.80))
    f = fields.where(good).select("job_id", "field_key", value.alias("value"))
    f = f.join(existing.select("job_id", "field_key").distinct(), ["job_id", "field_key"], "left_anti")
    page = best_pages(pages).where("page_key IS NOT NULL").drop("page_number")
    made = f.join(j.select("job_id", F.upper("payer").alias("payer"), F.upper("doc_type").alias("doc_type"), "_template"), "job_id").join(page, "job_id")
    origin = F.when(F.col("_template"), "synthetic_template").otherwise("batch3_extraction")
    return made.select("job_id", "page_id", "field_key", "value", "page_key", "payer", "doc_type", origin.alias("source"))
