"""OCR tokens of four shapes to one schema, by semi-structured values.

Stored: token_text, bbox_x0 ... bbox_y1. Detected: text and an object bbox with x0 ... y1. Flat: text, x0 ... y1. Loose: text or
token_text, and whatever of the others there is. Missing places, confidences and line numbers are 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.once import once

BOX = ("x0", "y0", "x1", "y1")
#: All that the shapes have, as text; a record is read once.
RECORD = "struct<token_text:string,text:string," + ",".join(f"bbox_{c}:string" for c in BOX) + ",bbox:struct<" + ",".join(f"{c}:string" for c in BOX) + ">," + ",".join(f"{c}:string" for c in BOX) + ",confidence:string,line_number:string>"


def normalised(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """``raw`` without ``payload`` (JSON), with text, box, confidence, line_number, ``shape``, and ``reason``: why a record is none, or null.

    Records are kept in any case: bad JSON, what is no object, fields of another kind (a text where the box should be), what has
    no text, and numbers that are none.
    """
    rows = once(raw, "_v", F.try_parse_json(payload))
    opens = F.ltrim(F.col(payload), F.lit(" \t\n\r")).startswith("{")  # what is JSON and begins so is an object
    rows = once(rows.withColumn("_object", opens), "_s", F.try_variant_get("_v", "$", RECORD))
    given = {**{f"bbox_{c}": F.col(f"_s.bbox_{c}") for c in BOX}, **{f"bbox.{c}": F.col(f"_s.bbox.{c}") for c in BOX}, **{c: F.col(f"_s.{c}") for c in (*BOX, "confidence", "line_number")}}
    rows = once(rows, "_n", F.struct(*(v.try_cast("double").alias(k.replace(".", "-")) for k, v in given.items())))
    number = {k: F.col("_n")[k.replace(".", "-")] for k in given}
    spoilt = reduce(lambda a, b: a | b, (v.isNotNull() & number[k].isNull() for k, v in given.items()))  # no lambda: those are not compiled
    text = F.coalesce("_s.token_text", "_s.text")
    shape = F.when(F.col("_s.token_text").isNotNull() & given["bbox_x0"].isNotNull(), "stored").when(F.col("_s.text").isNotNull() & given["bbox.x0"].isNotNull(), "detected").when(F.col("_s.text").isNotNull() & given["x0"].isNotNull(), "flat").otherwise("loose")
    reason = F.when(F.col("_v").isNull(), "no json").when(~F.col("_object"), "no object").when(F.col("_s").isNull(), "no such fields").when(text.isNull(), "no text").when(spoilt, "no number")
    first = lambda *keys: F.coalesce(*(number[k] for k in keys), F.lit(0.0))
    out = {"text": text, **{c: first(f"bbox_{c}", f"bbox.{c}", c) for c in BOX}, "confidence": first("confidence"), "line_number": first("line_number").cast("int"), "shape": shape}
    rows = once(rows, "reason", reason)
    return rows.select(*(c for c in raw.columns if c != payload), *(F.when(F.col("reason").isNull(), e).alias(c) for c, e in out.items()), "reason")
