"""Structured Streaming: hourly mismatch windows, duplicate uploads, claims that expire, rate limits, idempotent writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# How often mismatches are gathered, and how often training again is looked into.
HOURLY, WEEKLY = "1 hour", "7 days"


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Per hour and field: feedback, and the different jobs among its corrections. ``events`` has created_at, a timestamp.

    Distinct counts are not there for streams, so a job's first correction in an hour and field stands for all; the state is
    a row for each of those, dropped with its hour. Late rows are taken for an hour.
    """
    timed = events.withWatermark("created_at", late).withColumn("w", F.window("created_at", "1 hour"))
    first = timed.where("feedback_type = 'correction' AND job_id IS NOT NULL").dropDuplicates(["w", "field_key", "job_id"])
    each = timed.select("w", "field_key", F.lit(1).alias("n"), F.lit(0).alias("c")).unionByName(first.select("w", "field_key", F.lit(0).alias("n"), F.lit(1).alias("c")))
    g = each.groupBy("w", "field_key").agg(F.sum("n").alias("n"), F.sum("c").alias("corrected_jobs"))
    return g.select(F.unix_seconds("w.start").alias("hour_s"), "field_key", "n", "corrected_jobs")


def first_uploads(uploads: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first upload of each key; one that comes again while the watermark still remembers it is dropped."""
    return uploads.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


#: Rows of a piece of state, and of a piece of output.
BLOCK = 1 << 16


def _blocks(rows: np.ndarray) -> list[tuple[bytes]]:
    """Rows of whole numbers as pieces of state; a row of its own costs a message and an entry each time it is put or read."""
    return [(rows[i : i + BLOCK].tobytes(),) for i in range(0, len(rows), BLOCK)]


class _InOrder(StatefulProcessor):
    """Folds each key's rows in the order of event time, however they are dealt to micro-batches.

    A row waits until the watermark has passed its time, so none that counts can come before it any more; then ``fold(state,
    rows)`` takes what is due, sorted by time and ``seq``, and returns the new state and a column of answers. State that
    has not been used for ``keep`` seconds of event time is dropped by a timer, which also runs by event time alone.
    Waiting rows, all of whole numbers, are kept in blocks.
    """

    def __init__(self, row: str, state: str, keep: int, fold: Callable[[tuple | None, list[list]], tuple[tuple, list]], answer: str, key: str):
        self.row, self.state, self.keep, self.fold, self.answer, self.key = row, state, keep, fold, answer, key
        self.columns = [c.split()[0] for c in row.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")
        self.held = handle.getValueState("held", self.state + ", used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([part[self.columns].to_numpy(np.int64) for part in rows])
        self.waiting.appendList(_blocks(new))
        self._wake(int(new[:, 0].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        rows = [np.frombuffer(b, np.int64).reshape(-1, len(self.columns)) for (b,) in (self.waiting.get() if self.waiting.exists() else ())]
        rows = np.concatenate(rows) if rows else np.zeros((0, len(self.columns)), np.int64)
        due, later = rows[rows[:, 0] <= now], rows[rows[:, 0] > now]
        due = due[np.lexsort(due.T[::-1])]
        state = tuple(self.held.get()) if self.held.exists() else None
        if len(due):
            self.waiting.put(_blocks(later)) if len(later) else self.waiting.clear()
        for i in range(0, len(due), BLOCK):
            part = due[i : i + BLOCK].tolist()
            state, answers = self.fold(state and state[:-1], part)
            state = (*state, part[-1][0])
            yield pd.DataFrame({self.key: key[0], **dict(zip(self.columns, zip(*part))), self.answer: answers})
        if len(due):
            self.held.update(state)
        if len(later):
            self._wake(int(later[:, 0].min()))
        elif state is not None and now > state[-1] + self.keep:
            self.held.clear()
        elif state is not None:
            self._wake(state[-1] + self.keep + 1)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at * 1000)

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, key: str, columns: str, late: str, **how) -> DataFrame:
    """The stream ``rows`` (key, ``columns``: at in seconds first, then seq) with the column ``answer``, in the order of time."""
    timed = rows.withColumn("_ts", F.timestamp_seconds("at")).withWatermark("_ts", late)
    out = f"{key} long, {columns}, {how['answer']} boolean"
    return timed.groupBy(key).transformWithStateInPandas(_InOrder(columns, key=key, **how), out, "Append", "EventTime")


class _Sessions(StatefulProcessor):
    """Sessions of a bucket of reviews. What waits is kept in blocks, as sessions that are still open (gone, review, start, last, n;
    times in microseconds, gone: 1 for no review), and merged when the watermark has passed the end of one of them."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([part[["gone", "review", "at"]].to_numpy(np.int64) for part in rows])
        new = np.column_stack([new, new[:, 2], np.ones(len(new), np.int64)])
        self.waiting.appendList(_blocks(new))
        self._wake(new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [np.frombuffer(b, np.int64).reshape(-1, 5) for (b,) in (self.waiting.get() if self.waiting.exists() else ())]
        if not rows:
            return
        found = merged(np.concatenate(rows), self.gap)
        over = found[:, 3] + self.gap <= now
        done, open_ = found[over], found[~over]
        if not len(done):
            return
        self.waiting.put(_blocks(open_)) if len(open_) else self.waiting.clear()
        if len(open_):
            self._wake(open_)
        for i in range(0, len(done), BLOCK):
            part = done[i : i + BLOCK]
            review = pd.Series(part[:, 1], dtype="Int64").mask(part[:, 0] == 1)
            yield pd.DataFrame({"review_id": review, "start_s": part[:, 2] // 1_000_000, "n": part[:, 4]})

    def _wake(self, rows: np.ndarray) -> None:
        self.handle.registerTimer(int(rows[:, 3].min() + self.gap) // 1000 + 1)

    def close(self) -> None:
        pass


def merged(rows: np.ndarray, gap: int) -> np.ndarray:
    """Pieces of sessions (gone, review, start, last, n) put together where one begins less than ``gap`` after those of its review before it."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    other = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    until = pd.Series(rows[:, 3]).groupby(np.cumsum(other)).cummax().to_numpy()
    begins = np.flatnonzero(other | np.concatenate([[True], rows[1:, 2] - until[:-1] >= gap]))
    return np.column_stack([rows[begins, :3], np.maximum.reduceat(rows[:, 3], begins), np.add.reduceat(rows[:, 4], begins)])


def sessions(events: DataFrame, gap: int = 1800, late: str = "1 hour", buckets: int = 128) -> DataFrame:
    """review_id, start_s and n of sessions: events of a review less than ``gap`` seconds apart. An event that comes later than ``late`` behind the newest is dropped.

    Reviews are dealt to ``buckets``, whose open sessions are merged at once: a session window of Spark's own puts and reads an
    entry of state for each session in each batch.
    """
    at = F.unix_micros("created_at")
    timed = events.where("created_at IS NOT NULL").withWatermark("created_at", late)
    rows = timed.select("created_at", F.col("review_id").isNull().cast("long").alias("gone"), F.coalesce("review_id", F.lit(0)).cast("long").alias("review"), at.alias("at"), F.pmod(F.xxhash64("review_id"), F.lit(buckets)).cast("long").alias("_b"))
    return rows.groupBy("_b").transformWithStateInPandas(_Sessions(gap * 1_000_000), "review_id long, start_s long, n long", "Append", "EventTime")


def claims(attempts: DataFrame, expiry: int = 1800, late: str = "10 minutes") -> DataFrame:
    """Claim attempts (review_id, user_id, at in seconds, seq) as a stream of grants and refusals; the state is who holds a review since when.

    A claim expires by the attempts' own time: it is dropped once the watermark is ``expiry`` seconds past it. Attempts that
    come later than ``late`` behind the newest are dropped; the others are judged in order, however they are batched.
    """

    def fold(state: tuple | None, rows: list[list]) -> tuple[tuple, list]:
        holder, since = state or (None, None)
        granted = []
        for at, _, user in rows:
            ok = holder is None or holder == user or at - since > expiry
            granted.append(ok)
            if ok:
                holder, since = user, at
        return (holder, since), granted

    return _in_order(attempts, "review_id", "at long, seq long, user_id long", late, state="holder long, since long", keep=expiry, fold=fold, answer="granted")


def limited(requests: DataFrame, per_minute: float = 60, burst: int = 10, evict: int = 300, late: str = "10 minutes") -> DataFrame:
    """Requests (client, at in seconds, seq) with whether a token bucket lets them pass, in the order of their own time.

    The bucket of a client that is silent for more than ``evict`` seconds is forgotten, and the client's next one is full.
    """

    def fold(state: tuple | None, rows: list[list]) -> tuple[tuple, list]:
        tokens, last = state or (float(burst), None)
        passed = []
        for at, _ in rows:
            silent = 0 if last is None else at - last
            tokens = float(burst) if silent > evict else min(float(burst), tokens + silent * per_minute / 60.0)
            last = at
            passed.append(tokens >= 1.0)
            tokens -= passed[-1]
        return (tokens, last), passed

    return _in_order(requests, "client", "at long, seq long", late, state="tokens double, last long", keep=evict, fold=fold, answer="passed")


def idempotent_sink(path: str, key: str = "batch_id"):
    """A ``foreachBatch`` function that writes each micro-batch to a partition of its own, so that a batch that is sent again replaces itself."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{key}={batch_id}")

    return write


#: Keeps the state of operators with timers on the executors' disks, with changes and snapshots in the checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote."""
    spark, key = df.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(idempotent_sink(path))
    try:
        spark.conf.set(key, STATE_STORE)
        q = writer.start()
    finally:
        spark.conf.set(key, before)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path).drop("batch_id")


def scheduled(arrivals: DataFrame, check: Callable[[DataFrame, int], None], checkpoint: str, period: str = WEEKLY) -> StreamingQuery:
    """Runs ``check(new rows, batch)`` once a period over what has arrived in it (K3); the caller stops the query.

    A period without arrivals runs nothing. After a failure a batch is sent again under its number, so ``check`` has to be
    one that may run twice, as a look at ``training.retrain_due`` is.
    """
    return arrivals.writeStream.trigger(processingTime=period).option("checkpointLocation", checkpoint).foreachBatch(check).start()
