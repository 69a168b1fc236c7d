"""Claims and token buckets by event time: the same rows however they are batched, with pauses, and over a restart."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.streaming import jobs as J

CLAIMS = "review_id long, user_id long, at long, seq long"
FAR = 10**9


def attempts(n=160):
    r = random.Random(5)
    return [(r.randrange(4), r.randrange(3), 1000 + i * 90 + r.randrange(90), i) for i in range(n)]


def granted(rows):
    held, out = {}, []
    for review, user, at, seq in sorted(rows, key=lambda x: (x[2], x[3])):
        holder, since = held.get(review, (None, None))
        ok = holder is None or holder == user or at - since > 1800
        held[review] = (user, at) if ok else (holder, since)
        out.append((review, user, at, seq, ok))
    return sorted(out)


def put(spark, rows, path, schema, batches):
    r = random.Random(1)
    size = -(-len(rows) // batches)
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        r.shuffle(part)  # rows of a batch come in any order
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)


@pytest.mark.parametrize("batches", [1, 4, 16])
def test_claims_do_not_depend_on_batches(spark, tmp_path, batches):
    rows = sorted(attempts(), key=lambda x: x[2])
    put(spark, rows, str(tmp_path / "in"), CLAIMS, batches)
    put(spark, [(0, 0, FAR, 0)], str(tmp_path / "in"), CLAIMS, 1)
    stream = spark.readStream.schema(CLAIMS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = J.run_available(J.claims(stream, late="20 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(tuple(r[c] for c in ("review_id", "user_id", "at", "seq", "granted")) for r in out.where(F.col("at") < FAR).collect()) == granted(rows)


def test_buckets_go_on_after_a_restart_and_a_pause(spark, tmp_path):
    r = random.Random(8)
    rows = [(r.randrange(3), 5000 + i * 7 + r.randrange(3) + (4000 if i > 60 else 0), i) for i in range(120)]
    schema = "client long, at long, seq long"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        return J.run_available(J.limited(stream, per_minute=6, burst=3, evict=300, late="30 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))

    put(spark, rows[:50], str(tmp_path / "in"), schema, 4)
    run()
    time.sleep(1.5)
    put(spark, rows[50:], str(tmp_path / "in"), schema, 4)
    put(spark, [(0, FAR, 0)], str(tmp_path / "in"), schema, 1)
    got = run().where(F.col("at") < FAR)
    held, want = {}, []
    for client, at, seq in sorted(rows, key=lambda x: (x[1], x[2])):
        tokens, last = held.get(client, (3.0, None))
        silent = 0 if last is None else at - last
        tokens = 3.0 if silent > 300 else min(3.0, tokens + silent * 6 / 60)
        want.append((client, at, seq, tokens >= 1))
        held[client] = (tokens - (tokens >= 1), at)
    assert sorted(tuple(r[c] for c in ("client", "at", "seq", "passed")) for r in got.collect()) == sorted(want)


def test_waiting_rows_are_kept_in_blocks():
    import numpy as np

    rows = np.arange(3 * (J.BLOCK + 5)).reshape(-1, 3)
    blocks = J._blocks(rows)
    assert len(blocks) == 2 and (np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 3) for (b,) in blocks]) == rows).all()


@pytest.mark.parametrize("batches", [1, 5])
def test_sessions_do_not_depend_on_batches(spark, tmp_path, batches):
    from datetime import datetime, timedelta, timezone

    r, schema = random.Random(7), "review_id long, created_at timestamp"
    at = lambda us: datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=us)
    rows = [(r.choice([1, 2, 3, -5, None]), 10**12 + i * 400_000_000 + r.choice([0, 0, 1, 399_999_999])) for i in range(300)]
    rows += [(9, 10**12), (9, 10**12 + 1_799_999_999), (8, 10**12), (8, 10**12 + 1_800_000_000)]  # just under the gap, and the gap
    rows.sort(key=lambda x: x[1])
    put(spark, [(i, at(us)) for i, us in rows], str(tmp_path / "in"), schema, batches)
    put(spark, [(0, at(10**15)), (0, None)], str(tmp_path / "in"), schema, 1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = J.run_available(J.sessions(stream, late="1000 minutes", buckets=3), str(tmp_path / "out"), str(tmp_path / "state"))
    want, last = {}, {}
    for i, us in rows:
        if i not in last or us - last[i][1] >= 1_800_000_000:
            last[i] = (us, us)
        last[i] = (last[i][0], us)
        want[i, last[i][0] // 10**6] = want.get((i, last[i][0] // 10**6), 0) + 1
    got = [((x.review_id, x.start_s), x.n) for x in out.where("start_s < 900000000").collect()]
    assert len(got) == len(want) == len(dict(got)) and dict(got) == want and any(i is None for i, _ in want)


def test_pieces_of_sessions_are_merged_whatever_their_order():
    import numpy as np

    rows = np.array([[0, 1, 50, 50, 1], [0, 1, 0, 40, 3], [0, 1, 10, 12, 2], [0, 1, 60, 61, 2], [0, 2, 45, 45, 1], [1, 0, 45, 45, 1]])
    assert J.merged(rows, 11).tolist() == [[0, 1, 0, 61, 8], [0, 2, 45, 45, 1], [1, 0, 45, 45, 1]]
    assert J.merged(rows, 10).tolist() == [[0, 1, 0, 40, 5], [0, 1, 50, 50, 1], [0, 1, 60, 61, 2], [0, 2, 45, 45, 1], [1, 0, 45, 45, 1]]
