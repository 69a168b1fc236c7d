"""Values of fields next to their labels, over whole jobs (I24): where a label stands (C12), what it holds, what is right of it
or below it (E7, E8), by the field's type (H20-H23), from the page with the most labels (E6).

Tokens have job_id, page_number, page_id, line_number, word_number, token_text, a box and a confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import ocr_fold
from quire.functions.trim import filtered_by, trimmed, without_label
from quire.operators.corrections import extraction_confidence, label_confidence
from quire.operators.labels import find_labels, looks_like_label
from quire.sources.scratch import stored

#: Most tokens of a value, and the widest gap between two of them.
MOST, GAP = 4, 0.10
#: Boxes of values are at least and at most so wide and high.
WIDE, HIGH = (0.005, 0.9), (0.003, 0.3)
# Words by which a page is told to be a cover, and fields whose values are lists of codes.
COVER_WORDS, STATEMENT, STATEMENT_TOKENS = ("fax cover", "cover page"), "confidentiality statement", 30
CODES = ("service_code", "cpt_code", "hcpc_code")


def form_pages(tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """page_id, job_id, page_number and ``labels`` (how many different labels the page's text has) of pages that are no covers."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("line_number", "word_number", F.lower("token_text").alias("t")))), lambda x: x["t"])
    pages = tokens.groupBy("page_id", "job_id", "page_number").agg(F.count("*").alias("_n"), F.array_join(order, " ").alias("_text"))
    has = lambda words: F.contains("_text", words)
    cover = has(F.lit(COVER_WORDS[0])) | has(F.lit(COVER_WORDS[1])) | (has(F.lit(STATEMENT)) & (F.col("_n") < STATEMENT_TOKENS))
    phrases = aliases.select(F.regexp_replace(F.regexp_replace(F.lower("label"), ":+$", ""), "#+$", "").alias("p")).distinct().agg(F.collect_list("p").alias("_phrases"))
    scored = pages.where(~cover).crossJoin(F.broadcast(phrases))  # one row
    return scored.select("page_id", "job_id", "page_number", F.size(F.filter("_phrases", lambda p: F.contains("_text", p))).alias("labels"))


def _inside(text: Column, last: Column, label: Column, labels: Column, several: Column) -> Column:
    """What a label's tokens hold beyond the label: after a colon, pipe or hash if a label stands before it, or digits that run on from it; else null."""
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[:#|]+$", ""))
    solid = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    real = lambda x: F.when(x.rlike(r"[\p{L}\p{N}]"), x)
    either = lambda a, b: F.contains(a, b) | F.contains(b, a)
    known = lambda part: F.exists(labels, lambda c: either(plain(c), part) | either(solid(plain(c)), solid(part)) | either(ocr_fold(solid(plain(c))), ocr_fold(solid(part))))
    first = F.when(F.contains(text, F.lit(":")), ":").when(F.contains(text, F.lit("|")), F.lit("|")).otherwise("#")
    after = lambda t, sep: F.trim(F.substring(t, F.instr(t, sep) + 1, F.length(t)))
    before = lambda t, sep: plain(F.trim(F.substring(t, F.lit(1), F.instr(t, sep) - 1)))
    own = F.regexp_extract(last, r"[:|#]", 0)
    single = F.when(known(before(last, own)), real(after(last, own)))
    joined = F.when(real(after(last, own)).isNotNull() & known(before(text, first)), real(after(text, first)))
    runs_on = [F.when((at > 0) & rest.rlike(r"^[0-9/(\-]"), rest) for fold in (F.lower, lambda x: ocr_fold(F.lower(x))) for at in (F.instr(fold(last), fold(plain(label))),) for rest in (F.trim(F.substring(last, at + F.length(plain(label)), F.length(last))),)]
    return F.when(own == "", F.coalesce(*runs_on)).when(several, joined).otherwise(single)


def cleaned(key: Column, value: Column) -> Column:
    """A value without its label, quotes around it, a number said twice, and what follows a field's codes."""
    v = F.trim(without_label(key, value))
    quoted = v.rlike("^[\"'].*[\"']$") & (F.length(v) > 1)
    v = F.when(quoted, F.trim(F.substring(v, F.lit(2), F.length(v) - 2))).otherwise(v)
    parts = F.array_remove(F.split(v, r"\s+", -1), "")
    twice = (key == "units_requested") & (F.size(parts) > 1) & (F.size(F.array_distinct(parts)) == 1)
    bare = lambda w: F.regexp_replace(w, r"^[()\[\]{}.,;:]+|[()\[\]{}.,;:]+$", "")
    as_read = F.transform(parts, lambda w: F.when(bare(w).rlike("^11[0-9]{4}$"), F.concat(F.lit("H"), F.substring(bare(w), F.lit(3), F.lit(4)))).otherwise(w))
    code = lambda w: bare(w).rlike(r"^[A-Za-z0-9.\-]{1,10}$") & bare(w).rlike("[0-9]")
    stop = F.array_position(F.transform(as_read, code), False)
    codes = F.slice(as_read, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(as_read)).cast("int"))
    return F.when(twice, F.get(parts, 0)).when(key.isin(*CODES) & (F.size(codes) > 0), F.array_join(codes, " ")).otherwise(v)


def _fits(box: Column) -> Column:
    return (box["x1"] - box["x0"]).between(*WIDE) & (box["y1"] - box["y0"]).between(*HIGH)


def _union(tokens: Column) -> Column:
    edge = lambda c: (F.array_min if c[1] == "0" else F.array_max)(F.transform(tokens, lambda t: t[c]))
    return F.struct(*(edge(c).alias(c) for c in ("x0", "y0", "x1", "y1")))


def _beside(tokens: DataFrame, places: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """page_id, field_key, ``right`` and ``below``: the tokens of the value right of each label and, from the first line with a value, below it."""
    p = places.select(F.col("page_id").alias("_p"), "field_key", "box", "own", "limit", F.greatest(F.col("box.y1") - F.col("box.y0"), F.lit(0.01)).alias("row"))
    right = (F.abs(F.col("y0") - F.col("box.y0")) < F.col("row") * 0.7) & (F.col("x0") >= F.col("box.x1") - 0.01) & (F.col("x0") < F.coalesce("limit", F.lit(float("inf"))))
    reach = F.col("box.y1") + F.greatest(F.col("row") * 2.5, F.lit(0.06))
    below = F.col("y0").between(F.col("box.y1") - 0.005, reach) & (F.col("x0") < F.col("box.x1") + 0.06) & (F.col("x1") > F.col("box.x0") - 0.03)
    met = tokens.join(p, (F.col("page_id") == F.col("_p")) & (right | below) & ~F.array_contains("own", F.struct("line_number", "word_number")))
    item = F.struct("x0", "y0", "line_number", "word_number", "x1", "y1", F.col("token_text").alias("text"), "confidence", looks_like_label(F.col("token_text"), words).alias("label"))
    by_y = F.struct("y0", "x0", "line_number", "word_number", item.alias("t"))
    near = met.select("page_id", "field_key", F.when(right, item).alias("r"), F.when(below, by_y).alias("b"))
    near = near.groupBy("page_id", "field_key").agg(F.array_sort(F.collect_list("r")).alias("r"), F.transform(F.array_sort(F.collect_list("b")), lambda x: x["t"]).alias("b"))
    run = F.slice("r", 1, MOST)
    over = F.transform(run, lambda t, i: t["label"] | ((i > 0) & F.coalesce(t["x0"] - F.get(run, i - 1)["x1"] > GAP, F.lit(False))))
    stop = F.array_position(over, True)
    first = F.get(F.filter("b", lambda t: ~t["label"]), 0)["line_number"]
    past = F.array_position(F.transform("b", lambda t: t["line_number"] > first + 1), True)
    within = F.slice("b", F.lit(1), F.when(past > 0, past - 1).otherwise(F.size("b")).cast("int"))
    lines = F.slice(F.filter(within, lambda t: (t["line_number"] >= first) & ~t["label"]), 1, MOST)
    return near.select("page_id", "field_key", F.slice(run, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(run)).cast("int")).alias("right"), lines.alias("below"))


def label_words(aliases: DataFrame) -> tuple[str, ...]:
    """The words of the labels, those of more than two letters, and labels of one word; ``aliases`` is a stated table."""
    labels = {r.label.lower().rstrip(":").rstrip("#").strip() for r in aliases.select("label").where("label IS NOT NULL").distinct().collect()}
    words = {w.rstrip(":").rstrip("#") for x in labels for w in x.split()}
    return tuple(sorted({w for w in words if len(w) > 2} | {x for x in labels if x and " " not in x}))


def label_values(tokens: DataFrame, aliases: DataFrame, words: tuple[str, ...] | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Per job and field the value next to its label: value, confidence, box and page_number.

    ``aliases``: field_key and label, a stated table. ``words``, those of all labels if they are not given, are taken for labels wherever they stand. Without
    ``regions``, a value right of its label that has not the field's type ends the search of that page; the page with the
    most labels that has a value wins, then the first. With ``regions`` (field_key, page_number, roi_x0 ... roi_y1, a
    stated table too: a template's fields) a field is looked for on its page alone, up to its region's right edge, below the
    label where nothing right of it has the type, and the confidence follows how near the value is to the region.
    """
    words = label_words(aliases) if words is None else words
    pages = stored(form_pages(tokens, aliases), "form-pages")
    more = ["x0", "y0", "x1", "y1", "confidence"]
    here = tokens.join(pages.select(F.col("page_id").alias("_id")), F.col("page_id") == F.col("_id"), "left_semi")
    named = aliases.groupBy(F.col("field_key").alias("_f")).agg(F.collect_set(F.lower(F.trim("label"))).alias("labels"))
    found = find_labels(here, aliases, more).drop("inline").join(pages.withColumnRenamed("labels", "n_labels"), "page_id").join(named, F.col("field_key") == F.col("_f"))
    if regions is not None:
        roi = [F.col(f"roi_{c}") for c in ("x0", "y0", "x1", "y1")]
        found = found.join(regions.select(F.col("field_key").alias("_rf"), F.col("page_number").alias("_rp"), *roi), (F.col("field_key") == F.col("_rf")) & (F.col("page_number") == F.col("_rp")))
    limit = F.col("roi_x1") + 0.05 if regions is not None else F.lit(None).cast("double")
    last = F.element_at("tokens", -1)
    text = F.trim(F.array_join(F.transform("tokens", lambda t: t["token_text"]), " "))
    inside = _inside(text, F.trim(last["token_text"]), F.col("label"), F.col("labels"), F.size("tokens") > 1)
    found = found.withColumns({"box": _union(F.col("tokens")), "own": F.transform("tokens", lambda t: F.struct(t["line_number"].alias("line_number"), t["word_number"].alias("word_number"))), "limit": limit, "inside": inside, "last": last})
    found = stored(found.drop("tokens", "labels"), "label-places")
    last = F.col("last")
    beside = _beside(here, found, words).withColumnsRenamed({"page_id": "_p", "field_key": "_k"})
    key = F.col("field_key")
    met = found.join(beside, (F.col("page_id") == F.col("_p")) & (key == F.col("_k")), "left")
    item = F.struct(*(last[c].alias(c) for c in ("x0", "y0", "line_number", "word_number", "x1", "y1")), F.col("inside").alias("text"), last["confidence"].alias("confidence"), F.lit(False).alias("label"))
    none = F.slice(F.array(item), 1, 0)
    inline = F.when(F.col("inside").isNotNull(), filtered_by(key, F.array(item))).otherwise(none)
    of = lambda c: F.coalesce(c, none)
    tried = stored(met.withColumns({"_inline": inline, "_right": of(F.col("right")), "_below": of(F.col("below"))}), "label-values")
    right, below = filtered_by(key, F.col("_right")), filtered_by(key, F.col("_below"))
    met = stored(tried.withColumns({"_has": F.size("_right") > 0, "_right": right, "_below": below}), "values-by-type")
    beside_ = F.when(F.size("_right") > 0 if regions is not None else F.col("_has"), F.col("_right")).otherwise(F.col("_below"))
    finish = trimmed if regions is not None else cleaned
    value = lambda ts: finish(key, F.trim(F.array_join(F.transform(ts, lambda t: t["text"]), " ")))
    met = met.withColumns({"_in": F.slice("_inline", 1, 1), "_out": beside_})
    met = stored(met.withColumns({"_inv": value(F.col("_in")), "_outv": value(F.col("_out"))}), "cleaned-values")
    holds = (F.size("_in") > 0) & (F.col("_inv") != "") & (_fits(_union(F.col("_in"))) if regions is None else F.lit(True))
    met = met.withColumns({"_holds": holds, "_v": F.when(holds, F.col("_in")).otherwise(F.col("_out")), "value": F.when(holds, F.col("_inv")).otherwise(F.col("_outv"))}).where(F.size("_v") > 0)
    met = met.withColumn("evidence", _union(F.col("_v"))).where((F.col("value") != "") & (F.col("_holds") | _fits(F.col("evidence"))))
    mean = F.aggregate("_v", F.lit(0.0), lambda a, t: a + t["confidence"]) / F.size("_v")
    if regions is None:
        confidence = label_confidence(mean)
    else:
        middle = lambda a, b: (F.col(a) + F.col(b)) / 2
        apart = F.sqrt(F.pow(middle("evidence.x0", "evidence.x1") - middle("roi_x0", "roi_x1"), 2) + F.pow(middle("evidence.y0", "evidence.y1") - middle("roi_y0", "roi_y1"), 2))
        confidence = extraction_confidence(mean, F.lit(True), apart)
    best = Window.partitionBy("job_id", "field_key").orderBy(F.col("n_labels").desc(), "page_number")
    met = met.withColumn("confidence", F.round(confidence, 6)).withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return met.select("job_id", "field_key", "value", "confidence", "evidence", "page_number")
