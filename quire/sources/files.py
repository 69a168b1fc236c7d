"""Sources and sinks: uploaded files, token and embedding tables, citations, audit, training export, template seeds."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import magic_type, sanitized_name, storage_key

MOST_BYTES = 50 << 20


def uploads(spark: SparkSession, path: str, tenant: str, at: str, most: int = MOST_BYTES) -> DataFrame:
    """Files of a folder with their type, a safe name, a hash and a storage key; ``error`` says why one is turned away.

    Spark's reader passes over files without any bytes, so those are not listed.
    """
    files = spark.read.format("binaryFile").load(path)
    files = files.withColumns({"kind": magic_type(F.col("content")), "name": sanitized_name(F.element_at(F.split("path", "/"), -1)), "sha256": F.sha2("content", 256)})
    error = F.when(F.col("length") == 0, "EMPTY").when(F.col("length") > most, "TOO_LARGE").when(F.col("kind").isNull(), "BAD_TYPE")
    key = storage_key(F.lit(tenant), F.lit(at).cast("timestamp"), F.col("sha256"), F.col("name"))
    return files.select("name", "kind", "sha256", "length", key.alias("storage_key"), error.alias("error"))


def append(df: DataFrame, path: str, *by: str) -> None:
    """Adds rows to a Parquet table, partitioned by columns if any are named."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrites only the partitions that ``df`` has, so that a job that is done again replaces its own rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def citations(hits: DataFrame, query_id: str) -> DataFrame:
    return hits.select(F.lit(query_id).alias("query_id"), "embedding_id", F.left(F.col("source_text"), F.lit(500)).alias("cited_text"), "similarity")


def audit_rows(requests: DataFrame, action: str) -> DataFrame:
    """One row per access: the first forwarded address, or the peer's, and at most 500 characters of the user agent."""
    address = F.coalesce(F.nullif(F.trim(F.get(F.split("x_forwarded_for", ","), 0)), F.lit("")), F.col("peer"))
    return requests.select(F.lit(action).alias("action"), "user_id", "resource_id", address.alias("ip_address"), F.left(F.col("user_agent"), F.lit(500)).alias("user_agent"), "at")


def rules(spark: SparkSession, parsed: Mapping[str, Mapping]) -> DataFrame:
    """Payer rules as rows: payer, critical fields, thresholds and the rules of each field as JSON; no file means no rows."""
    import json

    rows = [(p, r.get("display_name"), list(r.get("critical_fields", [])), {k: float(v) for k, v in r.get("confidence_thresholds", {}).items()}, {k: json.dumps(v, sort_keys=True) for k, v in r.get("field_validations", {}).items()}) for p, r in sorted(parsed.items())]
    return spark.createDataFrame(rows, "payer string, display_name string, critical_fields array<string>, thresholds map<string,double>, validations map<string,string>")


def threshold_of(thresholds: Column, key: Column, default: float = 0.70) -> Column:
    return F.coalesce(F.try_element_at(thresholds, key), F.lit(default))


def template_fields(spark: SparkSession, seeds: list[Mapping]) -> DataFrame:
    """One row per template and field from seed definitions (payer, doc_type, template_name, fields: key to page, label, labels, roi...)."""
    rows = []
    for s in seeds:
        for key, f in s["fields"].items():
            roi = f.get("roi", {})
            rows.append((s["payer"], s["doc_type"], s["template_name"], key, int(f.get("page", 1)), f.get("label"), list(f.get("labels", [])), bool(f.get("is_required", False)), f.get("expected_type", "text"), *(float(roi.get(c, 0.0)) for c in ("x0", "y0", "x1", "y1"))))
    return spark.createDataFrame(rows, "payer string, doc_type string, template_name string, field_key string, page int, label string, labels array<string>, is_required boolean, expected_type string, roi_x0 double, roi_y0 double, roi_x1 double, roi_y1 double")


def pages_of(files: DataFrame, split: Callable, most: int = 100) -> DataFrame:
    """Pages of files by a function of your own from an iterator of pandas frames (sha256, content) to (sha256, page_number, image).

    ``error`` says why there is no image: an encrypted file is one row without a page, and never reaches the function; pages
    beyond the ``most`` first ones are told, not kept.
    """
    locked = F.coalesce((magic_type(F.col("content")) == "application/pdf") & F.contains("content", F.lit(b"/Encrypt")), F.lit(False))
    pages = files.where(~locked).select("sha256", "content").mapInPandas(split, "sha256 string, page_number int, image binary")
    over = F.col("page_number") > most
    pages = pages.select("sha256", "page_number", F.when(~over, F.col("image")).alias("image"), F.when(over, "BEYOND_PAGE_LIMIT").alias("error"))
    none = F.lit(None)
    return pages.unionByName(files.where(locked).select("sha256", none.cast("int").alias("page_number"), none.cast("binary").alias("image"), F.lit("ENCRYPTED").alias("error")))


def hook(send: Callable[[list], None], limit: int = 1000):
    """A ``foreachBatch`` sink that hands rows, a partition at a time, to a client such as a case system."""

    def write(df: DataFrame, batch_id: int) -> None:
        def each(rows):
            held = []
            for row in rows:
                held.append(row.asDict())
                if len(held) == limit:
                    send(held)
                    held = []
            if held:
                send(held)

        df.foreachPartition(each)

    return write
