"""The corpus pipeline: five stages, each with an operator of quire.llm, from ``documents`` to a training mix.

Every stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the columns of
``documents``; the last adds ``epoch``. Stages are written as Parquet and read again in between.

Defined results: null and empty texts fail the quality rules and go; null ids stay, and are never anyone's copy; of rows that
repeat id and text one stays; null sources and languages are groups of their own in the mix; columns beside those of
``documents`` are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontamination, jaccard_join, quality_rules, secret_scans, source_mixing
from quire.llm.queries import MIX
from quire.llm.storage import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.apply_cascade(docs.select(*COLUMNS))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id."""
    return jaccard_join.keep_one(docs.select(*COLUMNS))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows the text."""
    return secret_scans.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the training mix, one row for each epoch that has it."""
    return source_mixing.mixed_documents(docs.select(*COLUMNS), MIX)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality),
    ("jaccard_join", keep_one_of_each),
    ("decontamination", keep_clean),
    ("secret_scans", hide_secrets),
    ("source_mixing", mix),
]

#: The near-duplicate components and the measured order of rules are beyond SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
