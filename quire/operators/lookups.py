"""Lookups over templates, fields, feedback and models, write-backs, and what a reviewer is shown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.state import last_of_each

# The queue of each kind of task; others go to the default one.
TASK_QUEUES = {"process_fax": "fax_processing", "ocr_page": "fax_processing", "template_match": "default", "extract_fields": "fax_processing", "validate_extraction": "default", "create_review": "default"}
DEFAULT_QUEUE, NORMAL_PRIORITY = "default", 6


def page_scan(rows: DataFrame, key: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of ``rows`` in the order of their key (A13); null keys come first."""
    return rows.orderBy(F.col(key).asc_nulls_first()).offset(offset).limit(limit)


def known(asked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``asked`` (a column ``key``) with ``exists``: whether ``rows`` have the key. A null key is never there."""
    there = rows.select(F.col(key).alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_there", F.lit(True))
    return asked.join(there, F.col(key) == F.col("_k"), "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_k", "_there")


def where(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have the wanted values; a wanted None leaves a column open."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def active_templates(templates: DataFrame, payer: str | None = None, doc_type: str | None = None) -> DataFrame:
    return where(templates.where("is_active"), payer=payer, doc_type=doc_type)


def of_active_versions(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """``rows`` (template_version_id, ...) of versions that are active, with their template."""
    active = versions.where("is_active").select("template_version_id", "template_id")
    return rows.join(active, "template_version_id")


def version_fields(fields: DataFrame, required: bool | None = None, key: str | None = None, page: int | None = None) -> DataFrame:
    """Template fields by what is asked for, with their ``place`` in the order of keys within a version."""
    place = F.row_number().over(Window.partitionBy("template_version_id").orderBy("field_key", "target_page"))
    return where(fields, is_required=required, field_key=key, target_page=page).withColumn("place", place)


def corrections_of(feedback: DataFrame, field_key: str, limit: int = 100) -> DataFrame:
    """The newest corrections of a field; ``limit`` is the feature, a top-k."""
    found = feedback.where((F.col("field_key") == field_key) & (F.col("feedback_type") == "correction"))
    return found.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(limit)


def correction_rows(changes: DataFrame, by: Column) -> DataFrame:
    """Feedback rows of reviewers' changes (job_id, review_id, field_key, original_value, corrected_value)."""
    kept = changes.select("job_id", "review_id", "field_key", "original_value", "corrected_value")
    return kept.withColumns({"feedback_type": F.lit("correction"), "feedback_source": F.lit("human_review"), "created_by": by})


def models(versions: DataFrame, kind: str | None = None, active: bool | None = None) -> DataFrame:
    """Model versions; kinds are upper case."""
    return where(versions, kind=kind and kind.upper(), is_active=active)


def registered(versions: DataFrame, new: DataFrame, once: bool = True) -> DataFrame:
    """``versions`` with ``new`` (version_id, kind, metrics) added, inactive; a version that is there already stays as it is.

    ``once``: one that comes again in ``new`` is added once; otherwise every row of it is.
    """
    fresh = (last_of_each(new, ["version_id"]) if once else new).join(versions.select("version_id"), "version_id", "left_anti").select("version_id", F.upper("kind").alias("kind"), "metrics", F.lit(False).alias("is_active"))
    return versions.unionByName(fresh)


def with_metrics(versions: DataFrame, measured: DataFrame, *order: str) -> DataFrame:
    """``versions`` with the last metrics of ``measured`` (version_id, metrics) by ``order``, where there are any: new entries win over old."""
    m = last_of_each(measured, ["version_id"], *order).select("version_id", F.col("metrics").alias("_new"))
    return versions.join(m, "version_id", "left").withColumn("metrics", _merged(F.col("metrics"), F.col("_new"))).drop("_new")


def _merged(old: Column, new: Column) -> Column:
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))


@dataclass(frozen=True)
class TenantScope:
    """What a user may see. Everyone but an admin sees their own tenant; asking for another is an error in production only."""

    tenant: str
    admin: bool = False
    production: bool = True

    def visible(self, rows: DataFrame) -> DataFrame:
        return rows if self.admin else rows.where(F.col("tenant_id") == self.tenant)

    def asked(self, rows: DataFrame) -> DataFrame:
        """Rows that were asked for by id, with ``allowed``: false stands for a refusal."""
        own = F.lit(self.admin or not self.production) | (F.col("tenant_id") == self.tenant)
        return rows.withColumn("allowed", F.coalesce(own, F.lit(False)))


def review_packet(fields: DataFrame, candidates: DataFrame, flags: DataFrame) -> DataFrame:
    """One row per job and field: value, confidence, its candidates in order, and whether and why it is flagged."""
    c = candidates.groupBy("job_id", "field_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value", "method", "confidence"))), lambda x: x.dropFields("ord")).alias("candidates"))
    why = flags.select("job_id", "field_key", F.coalesce("reason", F.lit("LOW_CONFIDENCE")).alias("flag_reason"))
    key = ["job_id", "field_key"]
    return fields.join(c, key, "left").join(why, key, "left").withColumn("is_flagged", F.col("flag_reason").isNotNull())


def result_summary(fields: DataFrame, flags: DataFrame) -> DataFrame:
    """Per job how many fields it has, how many were found, and the keys that are flagged, in the order of the flags."""
    found = F.coalesce(F.trim("value") != "", F.lit(False))
    f = fields.groupBy("job_id").agg(F.count("*").alias("total_fields"), F.count_if(found).alias("fields_found"))
    g = flags.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "field_key"))), lambda x: x["field_key"]).alias("flagged_keys"))
    keys = F.coalesce("flagged_keys", F.array().cast("array<string>"))
    out = f.join(g, "job_id", "left").withColumns({"fields_not_present": F.col("total_fields") - F.col("fields_found"), "flagged_keys": keys})
    return out.withColumn("fields_flagged", F.size("flagged_keys").cast("long"))


def nearby_boxes(boxes: Column, distance: float = 0.01) -> Column:
    """Boxes (x0, y0, x1, y1) joined from top left on: each to the union before it if it is no farther than ``distance``."""
    start = F.array().cast("array<struct<y0:double,x0:double,x1:double,y1:double>>")
    near = lambda a, b: (b["x0"] <= a["x1"] + distance) & (b["y0"] <= a["y1"] + distance) & (b["y1"] >= a["y0"] - distance)

    def step(held: Column, box: Column) -> Column:
        last = F.element_at(held, -1)
        union = F.struct(F.least(last["y0"], box["y0"]).alias("y0"), F.least(last["x0"], box["x0"]).alias("x0"), F.greatest(last["x1"], box["x1"]).alias("x1"), F.greatest(last["y1"], box["y1"]).alias("y1"))
        grown = F.array_append(F.slice(held, 1, F.size(held) - 1), union)
        return F.when(F.size(held) == 0, F.array(box)).when(near(last, box), grown).otherwise(F.array_append(held, box))

    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct(*(b[c].cast("double").alias(c) for c in ("y0", "x0", "x1", "y1")))))
    return F.aggregate(ordered, start, step)


def ranked(scores: DataFrame, by: list[str]) -> DataFrame:
    """Every template's score for a page with its ``place``, the best first; equal scores by template."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "template_id")))


def without_corrected(flags: Column, keys: Column) -> Column:
    """Flags (an array with field_key) of fields that nobody has corrected."""
    return F.filter(F.coalesce(flags, F.array().cast("array<struct<field_key:string,reason:string>>")), lambda f: ~F.coalesce(F.array_contains(keys, f["field_key"]), F.lit(False)))


def routed_task(name: Column, priority: Column | None = None) -> Column:
    """``queue`` and ``priority`` of a task by the last part of its name."""
    kind = F.replace(F.element_at(F.split(name, r"\.", -1), -1), F.lit("_task"), F.lit(""))
    queue = F.lit(DEFAULT_QUEUE)
    for task, to in TASK_QUEUES.items():
        queue = F.when(kind == task, to).otherwise(queue)
    given = F.lit(NORMAL_PRIORITY) if priority is None else F.coalesce(priority, F.lit(NORMAL_PRIORITY))
    return F.struct(queue.alias("queue"), given.cast("int").alias("priority"))


def with_validation(fields: DataFrame, results: DataFrame, *order: str) -> DataFrame:
    """``fields`` (job_id, field_key, method, ...) with the outcome of the last validation, by ``order``, in every method's row of a field."""
    r = last_of_each(results, ["job_id", "field_key"], *order).select("job_id", "field_key", F.col("passed").alias("_p"), F.coalesce("errors", F.array().cast("array<string>")).alias("_e"))
    met = fields.join(r, ["job_id", "field_key"], "left")
    hit = F.col("_p").isNotNull()
    return met.withColumns({"validation_passed": F.when(hit, F.col("_p")).otherwise(F.col("validation_passed")), "validation_errors": F.when(hit, F.col("_e")).otherwise(F.col("validation_errors"))}).drop("_p", "_e")


def with_candidate(candidates: Column, value: Column, method: Column, confidence: Column) -> Column:
    """The candidates of a field with one more at the end."""
    return F.array_append(candidates, F.struct(value.alias("value"), method.alias("method"), confidence.alias("confidence")))


def review_status(as_of: int, expiry: int = 1800) -> dict[str, Column]:
    """``is_claimed``, ``is_submitted`` and ``is_expired`` of reviews at a time in seconds."""
    claimed = F.col("claimed_by").isNotNull() & F.col("submitted_s").isNull()
    return {"is_claimed": claimed, "is_submitted": F.col("submitted_s").isNotNull(), "is_expired": claimed & F.coalesce(as_of > F.col("claimed_at") + expiry, F.lit(False))}


def job_status() -> dict[str, Column]:
    return {"is_completed": F.col("status") == "COMPLETED", "is_failed": F.col("status") == "FAILED"}


def raw_ocr(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row per page (job_id, page_number, page_id), also without tokens: their number, mean confidence, and text in reading order."""
    token = F.struct("word_number", "token_text", "confidence")
    return raw_ocr_of_lines(pages, tokens.groupBy("page_id", "line_number").agg(F.array_sort(F.collect_list(token)).alias("tokens")))


def raw_ocr_of_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """``raw_ocr`` of tokens that come by line (page_id, line_number, tokens in order): a line's text, not its tokens, is shuffled."""
    of = lambda c: F.transform("tokens", lambda t: t[c])
    line = F.struct("line_number", F.array_join(of("token_text"), " ").alias("text"), F.array_compact(of("confidence")).alias("said"))
    each = lines.select("page_id", F.size("tokens").alias("n"), line.alias("line")).groupBy("page_id").agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list("line")).alias("lines"))
    total = F.aggregate("lines", F.lit(0.0), lambda a, x: F.aggregate(x["said"], a, lambda b, c: b + c))  # in reading order, as it decides the last digit
    number = F.aggregate("lines", F.lit(0), lambda a, x: a + F.size(x["said"]))
    read = each.select("page_id", "n_tokens", F.try_divide(total, number).alias("confidence"), F.array_join(F.transform("lines", lambda x: x["text"]), " ").alias("text"))
    return pages.join(read, "page_id", "left").withColumns({"n_tokens": F.coalesce("n_tokens", F.lit(0)).cast("long"), "text": F.coalesce("text", F.lit(""))})
