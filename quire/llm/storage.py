"""Where intermediate tables and files go: the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of our own only where that is unset, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or _own(spark)


def _own(spark: SparkSession) -> str:
    found = spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"file://{tempfile.mkdtemp(prefix='quire-')}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that its lineage ends there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint, and read by column.

    What was shuffled for it goes once it is written, instead of when the driver happens to collect its garbage. ``few`` is
    for tables of ids, links and counts: a task for each core writes a file of several partitions, as they have few rows each.
    """
    spark = df.sparkSession
    df = df.coalesce(max(1, spark.sparkContext.defaultParallelism)) if few else df
    path = fresh_dir(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a file of sums, counts or keys.
FILE_ROWS = 250_000


def files_for(rows: int) -> int:
    """Files, or partitions, that a table of sums, counts or keys is dealt to."""
    return 1 + rows // FILE_ROWS


def write_packed(df: DataFrame, path: str) -> int:
    """Writes ``df``, a table of sums, counts or keys, in as few files as its rows call for, and returns how many rows there are.

    Such a table has a few rows a partition, and creating a file for each costs more than the rows do: in a folder on local
    disk, Hadoop's client starts a program for every file that it creates. The rows wait on the executors' disks.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        rows = held.count()
        held.coalesce(files_for(rows)).write.parquet(path)
    finally:
        held.unpersist()
    return rows


def packed(df: DataFrame, name: str) -> DataFrame:
    """``df``, a table of sums, counts or keys, as ``stored`` keeps it, but in few files."""
    path = fresh_dir(df.sparkSession, name)
    write_packed(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most bytes that a broadcast may hold in memory; a driver and executors with a gigabyte of heap have room for it.
BROADCAST_BYTES = 128 << 20
#: Bytes that a broadcast holds of a row beside its columns, and of a column that is neither array nor string.
ROW_BYTES, COLUMN_BYTES = 32, 8


def held_bytes(df: DataFrame) -> int:
    """About what ``df``, a stored table, takes in memory: rows, columns and what arrays and strings hold."""
    fixed, measured = ROW_BYTES, [F.lit(0)]
    for f in df.schema.fields:
        fixed += COLUMN_BYTES
        if isinstance(f.dataType, ArrayType):
            inner = f.dataType.elementType
            width = COLUMN_BYTES * (1 + len(inner.fields)) if isinstance(inner, StructType) else COLUMN_BYTES
            measured.append(F.coalesce(F.size(f.name), F.lit(0)) * width)
        elif isinstance(f.dataType, (StringType, BinaryType)):
            measured.append(F.coalesce(F.octet_length(f.name), F.lit(0)))
    rows, more = df.agg(F.count("*"), F.sum(sum(measured[1:], measured[0]).cast("long"))).first()
    return rows * fixed + (more or 0)


def sized_broadcast(df: DataFrame, most: int | None = None) -> DataFrame:
    """A stored table, to be broadcast if it holds at most ``most`` bytes in memory and left to a shuffle otherwise."""
    return F.broadcast(df) if held_bytes(df) <= (BROADCAST_BYTES if most is None else most) else df.hint("shuffle_merge")


#: Rows of an Arrow batch of whole texts: with the usual 10,000 a batch would take hundreds of MB of a worker.
TEXT_BATCH = 256


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, once its session sends texts to Python in batches of at most ``TEXT_BATCH`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= TEXT_BATCH:
        df.sparkSession.conf.set(key, TEXT_BATCH)
    return df
