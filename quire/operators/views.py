"""Views of jobs, pages and fields that users ask for: listings, projections, summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_ROWS = 500
# How methods are called in front of clients.
METHOD_NAMES = {"TEMPLATE_OCR": "Template", "LAYOUTLM": "LayoutLM"}


def jobs_page(jobs: DataFrame, tenant: str | None = None, status: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of jobs, the newest first; paging is the feature, and a page has at most ``MOST_ROWS`` rows."""
    j = jobs.where(F.col("tenant_id") == tenant) if tenant else jobs
    j = j.where(F.col("status") == status) if status else j
    return j.orderBy(F.col("created_s").desc(), "job_id").offset(offset).limit(min(limit, MOST_ROWS))


def duplicate_uploads(jobs: DataFrame) -> DataFrame:
    """Files that a tenant sent more than once, with the first job that has them."""
    return jobs.groupBy("sha256", "tenant_id").agg(F.min("job_id").alias("first_job"), F.count("*").alias("n")).where("n > 1")


def oldest(jobs: DataFrame, status: str, limit: int = 50) -> DataFrame:
    return jobs.where(F.col("status") == status).orderBy("created_s", "job_id").limit(limit)


def needing_review(jobs: DataFrame, tenant: str) -> DataFrame:
    return jobs.where(F.col("needs_review") & (F.col("tenant_id") == tenant)).orderBy("created_s", "job_id")


def jobs_of_template(jobs: DataFrame, template: int) -> DataFrame:
    return jobs.where(F.col("template_id") == template).orderBy(F.col("created_s").desc(), "job_id")


def job_search(jobs: DataFrame, fields: DataFrame, text: str, tenant: str | None = None, limit: int = 50) -> DataFrame:
    """Jobs that have a field whose value contains the text, whatever its case, with the keys it was found in; the newest first."""
    found = fields.where(F.contains(F.lower("value"), F.lit(text.lower()))).groupBy("job_id").agg(F.array_sort(F.collect_set("field_key")).alias("found_in"))
    j = jobs.where(F.col("tenant_id") == tenant) if tenant else jobs
    return j.join(found, "job_id").orderBy(F.col("created_s").desc(), "job_id").limit(min(limit, MOST_ROWS))


def content_pages(pages: DataFrame) -> DataFrame:
    return pages.where("NOT is_cover").orderBy("job_id", "page_number")


def label_pages(pages: DataFrame) -> DataFrame:
    """Per job its first page and the page that labels are taken from: the first that is no cover."""
    return pages.groupBy("job_id").agg(F.min("page_number").alias("first_page"), F.min(F.when(~F.col("is_cover"), F.col("page_number"))).alias("label_page"), F.count("*").alias("pages"))


def model_worklist(fields: DataFrame, least: float = 0.75, most: int = 8) -> DataFrame:
    """Of each job the first ``most`` fields, by key, that are less certain than ``least``: those a model is asked about."""
    w = Window.partitionBy("job_id").orderBy("field_key", "ord")
    return fields.where(F.col("confidence") < least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def client_projection(fields: DataFrame, names: Mapping[str, str] = METHOD_NAMES) -> DataFrame:
    """What a client sees of a field: value, rounded confidence, where it is from, and whether it is there at all."""
    shown = F.col("method")
    for method, name in names.items():
        shown = F.when(F.col("method") == method, name).otherwise(shown)
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    best = fields.groupBy("job_id", "field_key", "value", "method").agg(F.round(F.max("confidence"), 4).alias("confidence"))
    return best.select("job_id", "field_key", "value", "confidence", shown.alias("source"), blank.alias("not_present"))


def field_metrics(fields: DataFrame) -> DataFrame:
    """Per job how many fields it has, how many are certain (0.85) or not (0.70), and how many are blank."""
    f = fields.groupBy("job_id", "field_key").agg(F.max("confidence").alias("c"), F.max(F.trim("value")).alias("v"))
    return f.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(F.col("c") >= 0.85).alias("high"), F.count_if(F.col("c") < 0.70).alias("low"), F.count_if(F.col("v") == "").alias("not_present"))


def repeated_values(fields: DataFrame, method: str, least: int = 3) -> DataFrame:
    """Values that a method gave for ``least`` fields of a job or more, as a model does that confuses dates."""
    c = fields.where((F.col("method") == method) & (F.col("value") != ""))
    return c.groupBy("job_id", "value").agg(F.countDistinct("field_key").alias("fields")).where(F.col("fields") >= least)


def merged_evidence(fields: DataFrame) -> DataFrame:
    c = fields.where("value <> ''")
    return c.groupBy("job_id", "field_key").agg(F.array_join(F.array_sort(F.collect_set("value")), " | ").alias("evidence"))


def distinct_codes(text: Column, pattern: str) -> Column:
    """Codes in a text, each once, in the order of their first place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def outside(words: Column, known: Column) -> Column:
    """Words that are not among the known ones, repeated ones too."""
    return F.filter(words, lambda x: ~F.array_contains(known, x))


def is_subset(words: Column, known: Column) -> Column:
    return F.size(F.array_except(words, known)) == 0


def alias_union(*aliases: Column) -> Column:
    """Lists of names as one, each once whatever its case."""
    return F.array_distinct(F.transform(F.flatten(F.array(*aliases)), F.lower))


def page_predicates(width: Column, height: Column, quality: Column, least: float) -> dict[str, Column]:
    """``landscape``, ``aspect`` and ``low_quality`` of a page; a page without height has aspect 0, one without quality is not low."""
    aspect = F.round(F.coalesce(F.try_divide(width.cast("double"), height.cast("double")), F.lit(0.0)), 4)
    return {"landscape": width > height, "aspect": aspect, "low_quality": F.coalesce(quality < least, F.lit(False))}


def with_parent(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """``rows`` with what they belong to, kept also where nothing does."""
    return rows.join(parents, F.col(key) == F.col(parent_key), "left")


def tree(roots: DataFrame, children: DataFrame, leaves: DataFrame, root_key: tuple[str, str], leaf_key: tuple[str, str], per: str) -> DataFrame:
    """Roots with their children and these with their leaves, childless ones too; ``samples`` counts the rows of each ``per``."""
    t = children.join(roots, F.col(root_key[0]) == F.col(root_key[1])).join(leaves, F.col(leaf_key[0]) == F.col(leaf_key[1]), "left")
    return t.withColumn("samples", F.count("*").over(Window.partitionBy(per)))


def items_of_each(heads: DataFrame, items: DataFrame, key: str, item_key: str, number: str) -> DataFrame:
    """Each head with how many items it has and their numbers in order; heads without any too."""
    j = heads.join(items, F.col(item_key) == F.col(key), "left").groupBy(key)
    return j.agg(F.count(item_key).alias("items"), F.array_join(F.transform(F.array_sort(F.collect_list(number)), lambda x: x.cast("string")), ",").alias("lines"))


def label_lines(tokens: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Lines with tokens that look like labels: those that end in a colon or are one of the words."""
    t = tokens.where(F.col("token_text").endswith(":") | F.lower("token_text").isin(*words))
    return t.groupBy("page_id", "line_number").agg(F.min("word_number").alias("first_word"), F.count("*").alias("n"))


def field_accuracy(feedback: DataFrame) -> DataFrame:
    g = feedback.groupBy("field_key").agg(F.count("*").alias("total"), F.count_if(F.col("feedback_type") == "correction").alias("corrected"))
    return g.withColumn("accuracy", F.round(1 - F.col("corrected") / F.col("total"), 4))


def hourly_trend(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy(F.expr("created_s div 3600").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("feedback_type") == "correction").alias("corrections"))


def mismatches(feedback: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of an extracted and a corrected value of a field that occur ``least`` times or more, with when they last did."""
    c = feedback.where((F.col("feedback_type") == "correction") & (F.col("original_value") != F.col("corrected_value")))
    return c.groupBy("field_key", "original_value", "corrected_value").agg(F.count("*").alias("n"), F.max("created_s").alias("last_s")).where(F.col("n") >= least)


def summary(jobs: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row of figures over all jobs and all feedback: two aggregates of a row each, put side by side."""
    j = jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if("needs_review").alias("in_review"), F.round(F.avg("overall_conf"), 4).alias("avg_confidence"))
    f = feedback.agg(F.count("*").alias("feedback"), F.count_if(F.col("feedback_type") == "correction").alias("corrections"), F.countDistinct("field_key").alias("fields"))
    return j.crossJoin(F.broadcast(f))


def labels_by(rows: DataFrame, *keys: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def training_filter(labels: DataFrame, payer: str | None = None, field_key: str | None = None, verified: bool | None = True, limit: int = 10_000) -> DataFrame:
    """The newest labels that are asked for; ``limit`` is the feature, a bound on a training request."""
    for column, value in (("payer", payer), ("field_key", field_key), ("is_verified", verified)):
        labels = labels.where(F.col(column) == value) if value is not None else labels
    return labels.orderBy(F.col("created_s").desc(), "label_id").limit(limit)
