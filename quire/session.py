"""SparkSession factory with the settings every query of the engine expects."""

from __future__ import annotations

import os

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
DRIVER_MEMORY = "8g"
#: For this machine only: a cluster keeps its own number of partitions.
LOCAL_DEFAULTS = {"spark.sql.shuffle.partitions": "8"}


def get_session(app: str = "quire", cpus: int | None = None, **extra: str) -> SparkSession:
    """A session in UTC with AQE. What the submit command or ``spark-defaults.conf`` set stays; ``extra`` and ``cpus`` win.

    ``cpus`` asks for a session on this machine with so many threads; without it the master is left alone, or all of this
    machine where there is none.
    """
    running = SparkSession.getActiveSession()
    if running is not None:
        for key, value in extra.items():
            running.conf.set(key, value)
        return running
    # The JVM reads its memory when it starts; what the submit command says comes after this and wins.
    SparkContext._ensure_initialized(conf=SparkConf(loadDefaults=False).set("spark.driver.memory", DRIVER_MEMORY))
    given = SparkConf()
    chosen = {key: value for key, value in DEFAULTS.items() if not given.contains(key)}
    if cpus is not None or not (given.contains("spark.master") or os.environ.get("SPARK_MASTER_URL")):
        chosen["spark.master"] = f"local[{cpus or '*'}]"
        chosen = LOCAL_DEFAULTS | chosen if not given.contains("spark.sql.shuffle.partitions") else chosen
    spark = SparkSession.builder.appName(app).config(map={**chosen, **extra}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
