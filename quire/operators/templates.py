"""Administration of templates on a committed table: create, update, delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.state import last_of_each

#: What an update may set; a null leaves the old value.
EDITABLE = ("template_name", "description", "is_active")


def checked(requests: DataFrame, payers: Sequence[str], doc_types: Sequence[str]) -> DataFrame:
    """``requests`` to create templates with payer and document type in upper case, and ``error``: what is wrong with them, or null."""
    upper = requests.withColumns({c: F.upper(c) for c in ("payer_name", "doc_type")})
    wrong = lambda c, allowed: F.when(~F.coalesce(F.col(c).isin(*allowed), F.lit(False)), F.concat(F.lit(f"Invalid {c}: "), F.coalesce(c, F.lit(""))))
    return upper.withColumn("error", F.coalesce(wrong("payer_name", payers), wrong("doc_type", doc_types)))


def created(requests: DataFrame) -> DataFrame:
    """New templates of the ``checked`` requests without an error; they are active."""
    return requests.where("error IS NULL").drop("error").withColumn("is_active", F.lit(True))


def updated(templates: DataFrame, updates: DataFrame, *order: str) -> DataFrame:
    """The templates that the last of ``updates`` (template_id, and what it may set) of each changes, as they are then; ids that are not there change nothing."""
    last = last_of_each(updates, ["template_id"], *order)
    new = last.select(F.col("template_id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in EDITABLE if c in updates.columns))
    met = templates.join(new, F.col("template_id") == F.col("_id"))
    return met.withColumns({c: F.coalesce(f"_{c}", c) for c in EDITABLE if c in updates.columns}).select(*templates.columns)
