"""Answer spans for question answering (N21, J13): where a label's value stands among a page's words, by windows of the page.

words: page_id, place (0-based, without gaps), text. labels: page_id, field_key, answer. White space and case do not count.
Answers that have their page's text with them need neither a join nor the page's words (``text_spans``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.once import once
from quire.operators.training import questions

#: Words of a window, how far the next one begins after it, and the share of an answer's characters that may differ.
WINDOW, STRIDE, ERRORS = 384, 128, 0.2


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _nearest(words: Column, a: Column, errors: float) -> Column:
    """distance, first and last (indexes of ``words``) of the run of about as many words that is nearest to ``a`` within a band of edits, or null."""
    most = F.floor(F.length(a) * errors).cast("int")
    count = F.size(F.split(a, " "))
    sizes = F.array_distinct(F.array(F.greatest(count - 1, F.lit(1)), count, count + 1))
    text = lambda i, n: F.array_join(F.slice(words, i + 1, n), " ")
    about = lambda i, n: (i + n <= F.size(words)) & (F.abs(F.length(text(i, n)) - F.length(a)) <= most)
    run = lambda i, n: F.when(about(i, n), F.struct(F.levenshtein(text(i, n), a).alias("distance"), i.alias("first"), (i + n - 1).alias("last")))
    runs = F.flatten(F.transform(words, lambda x, i: F.transform(sizes, lambda n: run(i, n))))
    return F.when(most > 0, F.array_min(F.filter(runs, lambda r: r["distance"] <= most)))


def _span(distance: Column, first: Column, last: Column) -> Column:
    return F.struct(distance.cast("int").alias("distance"), first.cast("int").alias("first"), last.cast("int").alias("last"))


def _found(met: DataFrame, exact: Column, near: Column) -> DataFrame:
    """The spans of ``met``, which has _from (where the plain answer stands on the page, or -1); each page is looked at once."""
    out = once(met, "_s", F.when(F.col("_from") >= 0, exact).otherwise(near)).where("_s IS NOT NULL")
    return out.select("page_id", "field_key", "answer", "_s.first", "_s.last", "_s.distance")


def answer_spans(words: DataFrame, labels: DataFrame, errors: float = ERRORS) -> DataFrame:
    """page_id, field_key, answer, first and last (places of words) and ``distance`` (edits): the best run of words for each answer.

    An answer that stands on the page as it is is found by the characters' offsets, so it may begin and end inside words; the
    first place counts. For another one, runs of about as many words are compared within a band of edits, up to ``errors`` of
    its length; the fewest edits win, then the first and shortest run. Answers that stand nowhere, and empty ones, are left out.
    """
    w = words.where(F.trim("text") != "").select("page_id", "place", _plain(F.col("text")).alias("t"))
    by = Window.partitionBy("page_id").orderBy("place")
    at = F.sum(F.length("t") + 1).over(by) - F.length("t") - 1
    w = w.select("page_id", "place", "t", at.alias("at"))
    asked = labels.select("page_id", "field_key", "answer", _plain(F.col("answer")).alias("a")).where("a <> ''").distinct()
    pages = w.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", "t", "at"))).alias("w"))
    met = once(asked.join(pages, "page_id"), "_from", F.instr(F.array_join(F.col("w.t"), " "), F.col("a")) - 1)
    holds = lambda x, c: (x["at"] <= c) & (c <= x["at"] + F.length(x["t"]))
    place = lambda c: F.get(F.filter("w", lambda x: holds(x, c)), 0)["place"]
    exact = _span(F.lit(0), place(F.col("_from")), place(F.col("_from") + F.length("a") - 1))
    met = once(met, "_n", F.when(F.col("_from") < 0, _nearest(F.col("w.t"), F.col("a"), errors)))
    own = lambda c: F.get("w", F.col(f"_n.{c}"))["place"]
    return _found(met, exact, F.when(F.col("_n").isNotNull(), _span(F.col("_n.distance"), own("first"), own("last"))))


def text_spans(asked: DataFrame, errors: float = ERRORS) -> DataFrame:
    """``answer_spans`` of answers that have their page's text with them (page_id, field_key, answer, text), whose words are parted
    by white space. Nothing is shuffled, and a text is put into words only where the answer does not stand as it is: the
    place of a word is the number of blanks before it."""
    met = once(asked, "_a", _plain(F.col("answer"))).where("_a <> ''")
    met = once(once(met, "_t", _plain(F.col("text"))), "_from", F.instr("_t", F.col("_a")) - 1)
    upto = lambda c: F.substring("_t", F.lit(1), c)
    place = lambda c: F.length(upto(c)) - F.length(F.replace(upto(c), F.lit(" "), F.lit("")))
    exact = _span(F.lit(0), place(F.col("_from")), place(F.col("_from") + F.length("_a") - 1))
    near = _nearest(F.array_remove(F.split("_t", " "), ""), F.col("_a"), errors)
    return _found(met, exact, near)


def windows(spans: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """``spans`` with the window of the page that holds the whole span and has it nearest to its middle, the first of equals:
    ``window`` (its number), ``start`` and ``end``, the span's places in it. A span longer than a window is left out."""
    low = F.greatest(F.ceil((F.col("last") - size + 1) / stride), F.lit(0))
    high = F.floor(F.col("first") / stride)
    wanted = F.round(((F.col("first") + F.col("last")) / 2 - size / 2) / stride)
    window = F.least(F.greatest(wanted, low), high).cast("long")
    placed = spans.where((low <= high) & (F.col("last") - F.col("first") < size)).withColumn("window", window)
    return placed.withColumns({"start": F.col("first") - F.col("window") * stride, "end": F.col("last") - F.col("window") * stride})


def rows_of(spans: DataFrame, asked: Mapping[str, Sequence[str]], size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """A row for each span and each way to ask for its field: question, window, start and end."""
    return questions(windows(spans, size, stride), asked).select("page_id", "field_key", "question", "answer", "window", "start", "end", "distance")


def training_rows(words: DataFrame, labels: DataFrame, asked: Mapping[str, Sequence[str]], size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """``rows_of`` the spans of labels among a page's words."""
    return rows_of(answer_spans(words, labels), asked, size, stride)
