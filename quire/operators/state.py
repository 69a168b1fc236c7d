"""State folded from event logs, and upserts without a MERGE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def job_state(events: DataFrame) -> DataFrame:
    """Per job the latest status, when it first started and when it was completed; a review sets no completion."""
    at = F.struct("at", "seq")
    return events.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"), F.min(F.when(F.col("status") == "PROCESSING", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("status") == "COMPLETED", F.col("at"))).alias("completed_at"), F.count("*").alias("events"),
    )


def last_of_each(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row of each key: the last by ``order``, and of those that come there together the greatest as JSON. Null is a key too."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    place = F.struct(*order, F.to_json(F.struct(*rest)))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("_last")).select(*keys, "_last.*").select(*rows.columns)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys are not among those of ``gone``; null keys are equal."""
    named = gone.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(named, on, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The last row of each key of ``new``, by ``order``, and the rows of ``old`` whose keys are not among them; null keys are equal."""
    return without(old, new, keys).unionByName(last_of_each(new, keys, *order))


def delete_by(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of each key the row that comes first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def claims(attempts: DataFrame, expiry: int = 1800) -> DataFrame:
    """Who holds a review: attempts (review_id, user_id, at, seq) in order, each granted if no one else holds it then.

    A claim holds for ``expiry`` seconds from its last grant. The fold walks a review's attempts, which are few.
    """
    ordered = F.array_sort(F.collect_list(F.struct("at", "seq", "user_id")))
    start = F.struct(F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("granted"), F.lit(0).alias("refused"))

    def step(s: Column, x: Column) -> Column:
        free = s["user_id"].isNull() | (s["user_id"] == x["user_id"]) | (x["at"] - s["at"] > expiry)
        return F.struct(
            F.when(free, x["user_id"]).otherwise(s["user_id"]).alias("user_id"), F.when(free, x["at"]).otherwise(s["at"]).alias("at"),
            (s["granted"] + F.when(free, 1).otherwise(0)).alias("granted"), (s["refused"] + F.when(free, 0).otherwise(1)).alias("refused"),
        )

    folded = attempts.groupBy("review_id").agg(F.aggregate(ordered, start, step).alias("s"))
    return folded.select("review_id", F.col("s.user_id").alias("claimed_by"), F.col("s.at").alias("claimed_at"), F.col("s.granted").alias("granted"), F.col("s.refused").alias("refused"))


def unclaimed(reviews: DataFrame, as_of: int, expiry: int = 1800) -> DataFrame:
    """Reviews not submitted that nobody holds at ``as_of``: urgent ones first, then the oldest."""
    free = F.col("claimed_by").isNull() | (as_of - F.col("claimed_at") > expiry)
    return reviews.where(F.col("submitted_s").isNull() & free).orderBy(F.col("priority").desc(), "created_s", "review_id")


def submitted(reviews: DataFrame, submits: DataFrame) -> DataFrame:
    """Submits (review_id, user_id, at) that come from the one who holds the review, with the seconds it took."""
    met = submits.join(reviews, "review_id").where((F.col("user_id") == F.col("claimed_by")) & (F.col("at") >= F.col("claimed_at")))
    return met.groupBy("review_id").agg(F.min("at").alias("submitted_s"), F.min(F.col("at") - F.col("claimed_at")).alias("seconds"))


def promoted(promotions: DataFrame, group: str) -> DataFrame:
    """The version that is active in each group: the last one promoted."""
    return promotions.groupBy(group).agg(F.max_by("version_id", F.struct("at", "version_id")).alias("active_version"), F.count("*").alias("promotions"))


def missing_fields(jobs: DataFrame, fields: DataFrame, required: list[str]) -> DataFrame:
    """(job, field) that is required and that the job does not have."""
    want = jobs.select("job_id").distinct().select("job_id", F.explode(F.array(*(F.lit(r) for r in required))).alias("field_key"))
    return want.join(fields.select("job_id", "field_key"), ["job_id", "field_key"], "left_anti")


def coalesce_update(rows: DataFrame, updates: DataFrame, keys: list[str], columns: list[str], *order: str | Column) -> DataFrame:
    """``rows`` with the columns that the last update of their key, by ``order``, sets; a null leaves the old value."""
    u = last_of_each(updates, keys, *order).select(*(F.col(k) for k in keys), *(F.col(c).alias(f"_u_{c}") for c in columns))
    return rows.join(u, keys, "left").withColumns({c: F.coalesce(f"_u_{c}", c) for c in columns}).drop(*(f"_u_{c}" for c in columns))
