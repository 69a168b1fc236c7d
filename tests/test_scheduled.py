"""A scheduled check sees what has arrived, in each period once."""

from quire.operators import training as T
from quire.streaming import jobs as J


def test_scheduled(spark, tmp_path):
    seen = []
    models = spark.createDataFrame([("LAYOUTLM", 100)], "model_type string, created_s long")

    def check(labels, batch):
        seen.append(tuple(T.retrain_due(labels, models, "layoutlm", least=2).first()))

    put = lambda *at: spark.createDataFrame([(t,) for t in at], "created_s long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(50, 150)
    stream = spark.readStream.schema("created_s long").parquet(str(tmp_path / "in"))
    query = J.scheduled(stream, check, str(tmp_path / "state"), "1 second")
    try:
        query.processAllAvailable()
        put(160, 170)
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen == [(1, False), (2, True)]
