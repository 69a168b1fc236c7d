"""Streaming queries run over the events table to its end, and compared with a batch answer.

A last window that the watermark has not passed is not in an append-mode result; a closing event far in the future, which is left out again, makes the stream complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import bindings as B
from quire.bindings import with_sql
from quire.plans.registry import query
from quire.sources.scratch import folder as _scratch
from quire.streaming import jobs as J

FAR = 4102444800  # 2100-01-01


PIECES = 4


def _stream(df: DataFrame, folder: str, at: str, closing: DataFrame, pieces: int = PIECES) -> tuple[DataFrame, str]:
    """``df`` as a stream of about so many micro-batches in the order of ``at`` (seconds), so that state passes from one to the
    next, and then of ``closing``; and how late rows may come in it.

    A piece is as many files as ``df`` has partitions. A batch may take some of the next piece's, so a row is late by no
    more than a piece.
    """
    timed = df.withColumn("_at", F.expr(at).cast("double"))
    ends = timed.approxQuantile("_at", [i / pieces for i in range(pieces + 1)], 0.01)
    cuts = list(zip([float("-inf"), *ends[1:-1]], [*ends[1:-1], float("inf")])) if ends else []
    for start, end in cuts:
        timed.where((F.col("_at") > start) & (F.col("_at") <= end)).drop("_at").write.mode("append").parquet(f"{folder}/in")
    closing.write.mode("append").parquet(f"{folder}/in")
    spark = df.sparkSession
    files = spark.read.schema(df.schema).parquet(f"{folder}/in").select(F.col("_metadata.file_path")).distinct().count()
    late = int(max((b - a for a, b in zip(ends, ends[1:])), default=0)) + 1
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files // pieces)).parquet(f"{folder}/in")
    return stream, f"{late} seconds"


def _feedback(spark, sf_dir):
    return B.feedback(spark, sf_dir).select("job_id", "review_id", "field_key", "feedback_type", "created_at")


_CREATED = "unix_seconds(created_at)"


def _last(df):
    return df.limit(1).withColumn("at", F.lit(FAR).cast("long"))


def _closing(df):
    return df.limit(1).withColumn("created_at", F.timestamp_seconds(F.lit(FAR)))


@query(with_sql("feedback", "SELECT created_s // 3600 * 3600 AS hour_s, field_key, count(*) AS n, count(DISTINCT job_id) FILTER (feedback_type = 'correction') AS corrected_jobs FROM feedback GROUP BY ALL"))
def k2_hourly_stream(spark, sf_dir):
    f, folder = _feedback(spark, sf_dir), _scratch(spark, "stream")
    stream, late = _stream(f, folder, _CREATED, _closing(f))
    out = J.run_available(J.hourly(stream, late), f"{folder}/out", f"{folder}/state")
    return out.where(F.col("hour_s") < FAR)


@query(with_sql("feedback", "SELECT review_id, field_key, count(*) AS n FROM (SELECT DISTINCT job_id, review_id, field_key FROM feedback) GROUP BY ALL"))
def k4_first_uploads(spark, sf_dir):
    f, folder = _feedback(spark, sf_dir), _scratch(spark, "stream")
    twice = f.unionByName(f)
    stream, late = _stream(twice, folder, _CREATED, twice.limit(0))
    out = J.run_available(J.first_uploads(stream, ["job_id", "review_id", "field_key"], "created_at", late), f"{folder}/out", f"{folder}/state")
    return out.groupBy("review_id", "field_key").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS new FROM events),
s AS (SELECT user_id, ts, sum(new::INTEGER) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id AS review_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*) AS n FROM s GROUP BY user_id, k""")
def k2_session_stream(spark, sf_dir):
    f, folder = _feedback(spark, sf_dir), _scratch(spark, "stream")
    stream, late = _stream(f, folder, _CREATED, _closing(f))
    out = J.run_available(J.sessions(stream, late=late), f"{folder}/out", f"{folder}/state")
    return out.where(F.col("start_s") < FAR)


_WALK = """WITH RECURSIVE e AS (SELECT event_id % 40 AS review_id, (user_id % 7)::BIGINT AS user_id, floor(epoch(ts))::BIGINT AS t, event_id AS seq, row_number() OVER (PARTITION BY event_id % 40 ORDER BY floor(epoch(ts))::BIGINT, event_id) AS i FROM events),
walk AS (SELECT *, user_id AS holder, t AS since, true AS granted FROM e WHERE i = 1
UNION ALL SELECT a.review_id, a.user_id, a.t, a.seq, a.i, CASE WHEN f THEN a.user_id ELSE holder END, CASE WHEN f THEN a.t ELSE since END, f FROM (SELECT e.*, holder, since, holder = e.user_id OR e.t - since > 1800 AS f FROM walk JOIN e ON e.review_id = walk.review_id AND e.i = walk.i + 1) a)"""


@query(f"{_WALK} SELECT review_id, user_id, count(*) FILTER (granted) AS granted, count(*) FILTER (NOT granted) AS refused FROM walk GROUP BY ALL")
def k5_claim_stream(spark, sf_dir):
    folder = _scratch(spark, "stream")
    e = B.table(spark, sf_dir, "events")
    a = e.select((F.col("event_id") % 40).alias("review_id"), (F.col("user_id") % 7).cast("long").alias("user_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    stream, late = _stream(a, folder, "at", _last(a))
    out = J.run_available(J.claims(stream, late=late), f"{folder}/out", f"{folder}/state").where(F.col("at") < FAR)
    return out.groupBy("review_id", "user_id").agg(F.count_if("granted").alias("granted"), F.count_if(~F.col("granted")).alias("refused"))


_BUCKET = """WITH RECURSIVE e AS (SELECT (user_id % 20)::BIGINT AS client, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id % 20 ORDER BY floor(epoch(ts))::BIGINT, event_id) AS i FROM events),
walk AS (SELECT *, 3.0::DOUBLE - 1.0::DOUBLE AS tokens, true AS passed FROM e WHERE i = 1
UNION ALL SELECT a.client, a.t, a.i, have - (have >= 1)::INTEGER, have >= 1 FROM (SELECT e.*, CASE WHEN e.t - walk.t > 6000 THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, tokens + (e.t - walk.t) * 0.03::DOUBLE / 60.0::DOUBLE) END AS have FROM walk JOIN e ON e.client = walk.client AND e.i = walk.i + 1) a)"""


@query(f"{_BUCKET} SELECT client, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS refused FROM walk GROUP BY 1")
def k6_rate_limit_stream(spark, sf_dir):
    folder = _scratch(spark, "stream")
    e = B.table(spark, sf_dir, "events")
    r = e.select((F.col("user_id") % 20).cast("long").alias("client"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    stream, late = _stream(r, folder, "at", _last(r))
    out = J.run_available(J.limited(stream, per_minute=0.03, burst=3, evict=6000, late=late), f"{folder}/out", f"{folder}/state").where(F.col("at") < FAR)
    return out.groupBy("client").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("refused"))
