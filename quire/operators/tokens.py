"""Token and page operators (B7-B12, D9-D12, E1, E2, E7, E8, E10, C11, C13). Tokens have a box in unit coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import geometry as G
from quire.sources.scratch import stored

BOX = ("x0", "y0", "x1", "y1")


def box() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in BOX)


def by_page(tokens: DataFrame, limit: int = 10_000) -> DataFrame:
    """The first tokens of each page in reading order; the limit is the reference's page size."""
    w = Window.partitionBy("page_id").orderBy("line_number", "word_number")
    return tokens.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def in_roi(tokens: DataFrame, roi: tuple[float, float, float, float], threshold: float = 0.5) -> DataFrame:
    """Tokens with at least ``threshold`` of their area in a region: a loose box filter, then the ratio."""
    r = tuple(F.lit(x) for x in roi)
    near = (F.col("x0") < roi[2]) & (F.col("x1") > roi[0]) & (F.col("y0") < roi[3]) & (F.col("y1") > roi[1])
    kept = tokens.where(near)
    return kept if threshold <= 0 else kept.where(G.overlap_ratio(box(), r) >= threshold)


def inside_roi(tokens: DataFrame, roi: tuple[float, float, float, float]) -> DataFrame:
    return tokens.where(G.contains(tuple(F.lit(x) for x in roi), box()))


def center_in_roi(tokens: DataFrame, roi: tuple[float, float, float, float]) -> DataFrame:
    cx, cy = G.center(box())
    return tokens.where((cx >= roi[0]) & (cx <= roi[2]) & (cy >= roi[1]) & (cy <= roi[3]))


def is_numeric(text: Column) -> Column:
    """Digits with commas, points and hyphens among them."""
    return text.rlike(r"^[,.-]*[0-9][0-9,.-]*$")


def is_date_like(text: Column) -> Column:
    """Five loose forms; a number of one or two digits and a month's first letters count."""
    return text.rlike(r"^(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|\d{1,2}$|\d{4}$|(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))")


def page_confidence(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("page_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"), F.count("*").alias("tokens"))


def line_text(tokens: DataFrame) -> DataFrame:
    """Words of a line in order, a blank between them."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("word_number", "token_text"))), lambda x: x["token_text"])
    return tokens.groupBy("page_id", "line_number").agg(F.array_join(words, " ").alias("line"))


def page_text(tokens: DataFrame) -> DataFrame:
    """Lines of a page in order, each on its own line."""
    return text_of_lines(line_text(tokens))


def text_of_lines(lines: DataFrame) -> DataFrame:
    """``page_text`` of lines (page_id, line_number, line)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_number", "line"))), lambda x: x["line"])
    return lines.groupBy("page_id").agg(F.array_join(ordered, "\n").alias("text"))


def document_text(pages: DataFrame) -> DataFrame:
    """Pages of a job in order, an empty line between them: all of them, and those that are no cover."""
    ordered = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("page_number", "text")))), lambda x: x["text"]), "\n\n")
    return pages.groupBy("job_id").agg(F.trim(ordered(F.lit(True))).alias("full_text"), F.trim(ordered(~F.col("is_cover"))).alias("content_text"))


def ocr_quality(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """Per job the mean of its content pages' means, not of their tokens."""
    per_page = tokens.groupBy("job_id", "page_number").agg(F.avg("confidence").alias("confidence"))
    return per_page.join(pages.where("NOT is_cover").select("job_id", "page_number"), ["job_id", "page_number"]).groupBy("job_id").agg(F.avg("confidence").alias("quality"))


def seed_lines(detections: DataFrame, gap: float = 0.015, ties: tuple[str, ...] = ()) -> DataFrame:
    """As ``assign_lines`` does it for the seeds of templates (E2): lines from 1, a smaller gap, and no new line below a centre at 0 or above the page."""
    lines = assign_lines(detections, gap, ties, below=0.0)
    return lines.withColumn("line_number", F.col("line_number") + 1)


def assign_lines(detections: DataFrame, gap: float = 0.02, ties: tuple[str, ...] = (), below: float | None = None) -> DataFrame:
    """Lines and words of detections (page_id, x0, y0, x1, y1, ...): a new line where the centre is more than ``gap``
    below that of the detection before it, and, if ``below`` is given, that one's is greater than it; words by x within a
    line; ``ties`` order equal boxes."""
    cy = (F.col("y0") + F.col("y1")) / 2
    order = Window.partitionBy("page_id").orderBy("_cy", "x0", "x1", *ties)
    d = detections.withColumn("_cy", cy)
    before = F.lag("_cy").over(order)
    apart = F.col("_cy") - before > gap
    d = d.withColumn("_new", F.coalesce((apart if below is None else apart & (before > below)).cast("int"), F.lit(0)))
    d = d.withColumn("line_number", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    words = Window.partitionBy("page_id", "line_number").orderBy("x0", "x1", "_cy", *ties)
    return d.withColumn("word_number", F.row_number().over(words) - 1).drop("_cy", "_new")


def chunks(pages: DataFrame, size: int = 256, overlap: int = 32, key: str = "doc_id") -> DataFrame:
    """Overlapping runs of words, the last one short; texts of at most ``size`` words are one chunk."""
    step = size - overlap
    words = F.filter(F.split("text", r"[ \n\t\r\f\x0B]+", -1), lambda x: x != "")
    w = pages.select(key, words.alias("w")).where(F.size("w") > 0)
    last = F.when(F.size("w") <= size, 0).otherwise(F.ceil((F.size("w") - size) / step)).cast("int")
    each = w.select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    part = F.slice("w", F.col("chunk_index") * step + 1, F.lit(size))
    return each.select(key, "chunk_index", F.size(part).alias("n_words"), F.array_join(part, " ").alias("chunk"))


def field_tokens(tokens: DataFrame, fields: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Each field's tokens by its region on its page: equal page, then a range and a ratio; ``fields`` is a small table."""
    f = fields.select("field_key", F.col("page_id").alias("_page"), *(F.col(f"roi_{c}") for c in BOX))
    on = (F.col("page_id") == F.col("_page")) & (F.col("x0") < F.col("roi_x1")) & (F.col("x1") > F.col("roi_x0")) & (F.col("y0") < F.col("roi_y1")) & (F.col("y1") > F.col("roi_y0"))
    met = tokens.join(f, on)
    return met.where(G.overlap_ratio(box(), tuple(F.col(f"roi_{c}") for c in BOX)) >= threshold).drop("_page", *(f"roi_{c}" for c in BOX))


def right_of_label(tokens: DataFrame, label: str, most: int = 4, gap: float = 0.10) -> DataFrame:
    """The run of tokens right of each label token on its line, until another label, a gap, or ``most`` tokens."""
    labels = tokens.where(F.lower("token_text") == label).select(F.col("page_id").alias("_p"), F.col("line_number").alias("_l"), F.col("word_number").alias("label_word"))
    met = tokens.join(labels, (F.col("page_id") == F.col("_p")) & (F.col("line_number") == F.col("_l")) & (F.col("word_number") >= F.col("label_word")) & (F.col("word_number") <= F.col("label_word") + most))
    w = Window.partitionBy("page_id", "line_number", "label_word").orderBy("word_number")
    stop = (F.col("x0") - F.lag("x1").over(w) > gap) | (F.col("token_text").endswith(":") & (F.col("word_number") > F.col("label_word")))
    run = met.withColumn("_stop", F.coalesce(stop.cast("int"), F.lit(0))).withColumn("_stops", F.sum("_stop").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where((F.col("_stops") == 0) & (F.col("word_number") > F.col("label_word"))).select("page_id", "line_number", "label_word", "word_number", "token_text")


#: Longest word that is looked up by its forms with characters deleted; longer ones are looked up by segments.
LONG = 24


def _deleted(word: Column, most: int) -> Column:
    """The forms of a word with up to ``most`` characters deleted."""
    forms = F.array(word)
    for _ in range(most):
        shorter = F.transform(forms, lambda f: F.transform(F.sequence(F.lit(1), F.greatest(F.length(f), F.lit(1))), lambda i: F.concat(F.substring(f, F.lit(1), i - 1), F.substring(f, i + 1, F.length(f)))))
        forms = F.array_distinct(F.concat(forms, F.flatten(shorter)))
    return forms


def _segments(word: Column, length: Column, shift: Column, most: int) -> Column:
    """For words of ``length`` characters, the ``most`` + 1 segments of it that ``word`` has, moved by ``shift``."""
    parts = most + 1
    start = lambda i: F.floor(length * i / parts).cast("int")
    one = lambda i: F.concat_ws(":", F.lit(i), length, F.substring(word, F.greatest(start(i) + 1 + shift, F.lit(1)), start(i + 1) - start(i)))
    return F.array(*(one(i) for i in range(parts)))


def _token_keys(word: Column, most: int) -> Column:
    steps = F.array(*(F.lit(i) for i in range(-most, most + 1)))
    long = F.flatten(F.flatten(F.transform(steps, lambda more: F.transform(steps, lambda shift: _segments(word, F.length(word) + more, shift, most)))))
    return F.when(F.length(word) <= LONG, _deleted(word, most)).when(F.length(word) > LONG + most, long).otherwise(F.concat(_deleted(word, most), long))


def _value_keys(word: Column, most: int) -> Column:
    return F.when(F.length(word) <= LONG, _deleted(word, most)).otherwise(_segments(word, F.length(word), F.lit(0), most))


def near_words(tokens: DataFrame, words: DataFrame, most: int = 2) -> DataFrame:
    """(token, word, distance) of the different ``tokens`` and ``words``, each a column of that name, at most ``most`` edits apart.

    Words that are at most so many edits apart have a form in common, each with at most so many characters deleted, so an
    equi-join of forms finds them. A long word has too many of those: of its ``most`` + 1 segments one is left untouched by
    the edits and stands in the token, moved by no more than their number.
    """
    if most == 0:
        return tokens.join(words, F.col("token") == F.col("word")).select("token", "word", F.lit(0).alias("distance"))
    w = words.where("word IS NOT NULL").distinct()
    lengths = w.select(F.explode(F.sequence(F.length("word") - most, F.length("word") + most)).alias("n")).agg(F.collect_set("n").alias("_ok"))
    t = tokens.crossJoin(F.broadcast(lengths)).where(F.array_contains("_ok", F.length("token"))).select("token").distinct()  # one row
    keyed = lambda df, c, keys: df.select(c, F.explode(F.array_distinct(keys(F.col(c), most))).alias("_key"))
    met = keyed(t, "token", _token_keys).join(keyed(w, "word", _value_keys), "_key").select("token", "word").distinct()
    return met.withColumn("distance", F.levenshtein("token", "word")).where(F.col("distance") <= most)


def nearest_token(tokens: DataFrame, values: DataFrame, most: int = 2) -> DataFrame:
    """For each value word of a page the token within ``most`` edits that is closest, the first of equals; case does not count.

    Only different tokens and words are compared (``near_words``); what is near is then found on the pages.
    """
    named = tokens.select("page_id", "line_number", "word_number", "token_text", F.upper("token_text").alias("_t"))
    wanted = values.select(F.col("page_id").alias("_p"), F.upper("word").alias("word")).distinct()
    near = stored(near_words(named.select(F.col("_t").alias("token")), wanted.select("word"), most), "near-words")
    met = named.join(near, F.col("_t") == F.col("token"))
    best = met.groupBy("page_id", "word").agg(F.min(F.struct("distance", "line_number", "word_number", "token_text")).alias("b"))
    best = best.join(wanted.withColumnRenamed("word", "_w"), (F.col("page_id") == F.col("_p")) & (F.col("word") == F.col("_w")), "left_semi")
    return best.select("page_id", "word", "b.distance", "b.line_number", "b.word_number", "b.token_text")
