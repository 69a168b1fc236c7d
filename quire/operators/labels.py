"""Label-anchored extraction: where a label stands on a page (C12), and the values below it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.once import once
from quire.functions.text import inline_value, ocr_fold
from quire.sources.scratch import stored

#: Share of a label's words that must be found, and how many tokens beyond them are looked at.
SHARE, SLACK = 0.6, 5


def _clean(text: Column) -> Column:
    """Lower case without the colons and hashes at the end, or before an end of line there."""
    t = F.lower(F.trim(text))
    ends = lambda *marks: reduce(or_, (F.endswith(t, F.lit(m)) for m in marks))
    cut = F.regexp_replace(F.regexp_replace(t, ":+$", ""), "#+$", "")
    return F.when(ends(":", "#", "\n", "\r", "\x85", "\u2028", "\u2029"), cut).otherwise(t)  # few tokens end so


def _same(token: Column, word: Column) -> Column:
    """Either contains the other, as read or with the digits that OCR takes for letters."""
    a, b = ocr_fold(word), ocr_fold(token)
    return token.contains(word) | word.contains(token) | b.contains(a) | a.contains(b)


def _parts(text: Column, least: int, most: Column) -> Column:
    """All parts of a text of ``least`` to ``most`` characters."""
    upto = F.least(F.length(text), most)
    sizes = F.when(upto >= least, F.sequence(F.lit(least), upto)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))))


#: Characters of a gram: a word has to share one with each token that contains it, shorter words themselves.
GRAM = 3


def _alike(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(t, w) of the different ``tokens`` and ``words`` that are alike, found by an index of both readings of either.

    A token inside a word is one of the word's parts. A word inside a token shares its first ``GRAM`` characters, or all of
    a shorter word, with it; the token's grams are looked up. Words are those of a stated set of labels, so they are short.
    """
    both = lambda c: F.array_distinct(F.array(F.col(c), ocr_fold(F.col(c))))
    inside = words.select("w", F.explode(F.array_distinct(F.flatten(F.transform(both("w"), lambda x: F.concat(F.array(F.lit("")), _parts(x, 1, F.length(x))))))).alias("key"))
    held = tokens.select("t", F.explode(both("t")).alias("key"))
    heads = words.where("w <> ''").select("w", F.explode(F.transform(both("w"), lambda x: F.substring(x, 1, GRAM))).alias("key"))
    known = heads.agg(F.collect_set("key").alias("_known"))
    parts = F.array_distinct(F.flatten(F.transform(both("t"), lambda x: _parts(x, 1, F.lit(GRAM)))))
    grams = tokens.crossJoin(F.broadcast(known)).select("t", F.explode(F.array_intersect(parts, "_known")).alias("key"))  # one row
    met = held.join(inside, "key").select("t", "w").unionByName(grams.join(heads, "key").select("t", "w"))
    everything = tokens.crossJoin(F.broadcast(words.where("w = ''").limit(1))).select("t", "w")  # an empty word, of which there is one at most, is in all
    return met.where("w <> ''").where(_same(F.col("t"), F.col("w"))).unionByName(everything).distinct()


def _label_words(aliases: DataFrame) -> DataFrame:
    """field_key, label, n (its words), and its words (k, w, weight). A word that is empty once cleaned is like every token, so the
    token of the word before it takes it as well: it adds to that word's weight."""
    words = F.transform(F.split(F.lower(F.trim("label")), r"\s+"), _clean)
    start = F.array().cast("array<struct<w:string,weight:int>>")
    last = lambda s: F.element_at(s, -1)
    longer = lambda s: F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(last(s)["w"].alias("w"), (last(s)["weight"] + 1).alias("weight"))))
    step = lambda s, w: F.when((w == "") & (F.size(s) > 0), longer(s)).otherwise(F.concat(s, F.array(F.struct(w.alias("w"), F.lit(1).alias("weight")))))
    named = aliases.select("field_key", "label").distinct().select("field_key", "label", F.size(words).alias("n"), F.aggregate(words, start, step).alias("words"))
    return named.select("field_key", "label", "n", F.col("words.weight").alias("weights"), F.posexplode("words").alias("k", "x")).select("field_key", "label", "n", "weights", "k", "x.w")


def _walk(ahead: Column, weights: Column, n: Column) -> Column:
    """Matches of a label's words, in order, from a token on: ``found`` words, and the tokens' indexes ``at``.

    ``ahead`` has the tokens from there on that are like some word of the label (i, line, ks: the words). A token takes as
    many of the next words as it is like; one that takes none is passed over; the walk ends beyond the next line, and
    ``SLACK`` tokens after as many as the label has words.
    """
    first = F.get(ahead, 0)
    near = F.filter(ahead, lambda x: (x["i"] < first["i"] + n + SLACK) & (F.abs(x["line"] - first["line"]) <= 1))
    state = F.struct(F.lit(0).alias("k"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, x: Column) -> Column:
        run = F.aggregate(F.sequence(F.lit(0), F.size(weights)), s["k"], lambda k, _: F.when(F.array_contains(x["ks"], k), k + 1).otherwise(k))
        return F.struct(run.alias("k"), F.when(run > s["k"], F.concat(s["at"], F.array(x["i"]))).otherwise(s["at"]).alias("at"))

    total = lambda s: F.aggregate(F.slice(weights, F.lit(1), s["k"]), F.lit(0), lambda a, w: a + w)
    return F.aggregate(near, state, step, lambda s: F.struct(total(s).alias("found"), s["at"].alias("at")))


#: So many different words of labels are looked for in each token; more are compared with the different tokens only, by an index.
FEW_WORDS = 32


def _by_words(words: list) -> tuple[Column, Column]:
    """Of a cleaned token ``_f``, as OCR reads it: whether it is like any of the ``words`` (rows of ``_label_words``), and its ``labels``, as of ``_by_index``, but with
    null for labels that it is not like, and with -1 for such words.

    Both are in lower case, so what one reading holds the other holds as OCR reads it, and one comparison is enough. Parts of
    the words are looked up, as most tokens are none; nothing but columns that are compiled, as they see every token.
    """
    fold = lambda w: w.replace("0", "o").replace("1", "l")
    t = F.col("_f")
    folded = sorted({fold(r.w) for r in words})
    parts = sorted({w[i:j] for w in folded for i in range(len(w) + 1) for j in range(i, len(w) + 1)})
    like = {w: F.contains(t, F.lit(w)) | t.isin([x for x in parts if x in w]) for w in folded}
    holds = lambda some: reduce(or_, (F.contains(t, F.lit(w)) for w in some), F.lit(False))
    by_label = {}
    for r in sorted(words, key=lambda r: (r.field_key or "", r.label, r.k)):
        by_label.setdefault((r.field_key, r.label, r.n, tuple(r.weights)), []).append((r.k, fold(r.w)))
    ints = lambda xs: F.array(*map(F.lit, xs))
    found = [
        F.when(reduce(or_, (like[w] for _, w in ks)), F.struct(F.lit(key).cast("string").alias("field_key"), F.lit(label).alias("label"), F.lit(n).alias("n"), ints(weights).alias("weights"), F.array(*(F.when(like[w], k).otherwise(-1) for k, w in ks)).alias("ks")))
        for (key, label, n, weights), ks in by_label.items()
    ]
    return (holds(folded) | t.isin(parts) if words else F.lit(False)), F.array(*found) if words else None


def _by_index(named: DataFrame, words: DataFrame) -> DataFrame:
    """t and ``labels`` of the different tokens of ``named`` that are like some word: the labels, and which of their words (ks)."""
    like = stored(_alike(named.select(F.col("_t").alias("t")).distinct(), words.select("w").distinct()), "alike")
    of = like.join(words.withColumnRenamed("w", "_w"), F.col("w") == F.col("_w"))
    of = of.groupBy("t", "field_key", "label", "n", "weights").agg(F.array_sort(F.collect_set("k")).alias("ks"))  # no more than a label's words
    return stored(of.groupBy("t").agg(F.collect_list(F.struct("field_key", "label", "n", "weights", "ks")).alias("labels")), "label-tokens")


def find_labels(tokens: DataFrame, aliases: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Per page and field the best place of any of its labels: label, score, line and word of each token, inline value.

    ``more`` names columns of ``tokens`` that come along with each token. Where ``tokens`` has ``place`` (a token's number on its
    page, in order), that is taken; else it is counted, which sorts all tokens.

    ``aliases``: field_key, label, a small table. A label of one word scores the share of the token it makes up; one of
    several scores the share of its words found, if that is at least ``SHARE``. Ties go to fewer tokens, then to a label
    with a value in its last token, then to the label and the place that come first.

    Few words are looked for in every token as it is read (``_by_words``); more are compared with the different tokens only
    (``_by_index``). Order and gaps are looked at where tokens are like some word. Tokens that come dealt by page stay where they are.
    """
    named = tokens.where("page_id IS NOT NULL").select("page_id", "line_number", "word_number", "token_text", *more, *(["place"] if "place" in tokens.columns else []))
    words = stored(_label_words(aliases), "label-words")
    known = words.limit(FEW_WORDS * FEW_WORDS + 1).collect()  # of a small table
    few = len(known) <= FEW_WORDS * FEW_WORDS and len({r.w for r in known}) <= FEW_WORDS
    if "place" not in tokens.columns:
        named = named.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("line_number", "word_number", "token_text")) - 1)
    named = once(named, "_t", _clean(F.col("token_text")))
    if few:
        any_of, labels = _by_words(known)
        read = lambda df: once(df, "_f", F.replace(F.replace("_t", F.lit("0"), F.lit("o")), F.lit("1"), F.lit("l")))
        placed, labelled = read(named).where(any_of), lambda df: read(df).withColumn("labels", labels)
    else:
        of = _by_index(named, words)
        labelled = lambda df: df.join(of, F.col("_t") == F.col("t"))
        placed = labelled(named)
    placed = stored(placed.select("page_id", F.col("place").cast("int").alias("i"), "_t", F.struct("line_number", "word_number", "token_text", *more).alias("raw")), "label-candidates")
    # Shuffled once, by page, as all that follows is, and before a token has its labels and is there once for each of them.
    each = labelled(placed.repartition("page_id"))
    each = each.select("page_id", "i", "raw", F.length("_t").alias("_size"), F.explode("labels").alias("l")).where("l IS NOT NULL").select("page_id", "i", "raw", "_size", "l.*")
    length = F.length(_clean(F.lower(F.trim("label"))))
    single = each.where("n = 1").select("page_id", "field_key", "label", (length / F.greatest(F.col("_size"), F.lit(1))).alias("score"), F.array("i").alias("at"), F.array("raw").alias("tokens"))
    reach = (words.agg(F.max("n")).first()[0] or 0) + SLACK
    ahead = Window.partitionBy("page_id", "field_key", "label").orderBy("i").rowsBetween(0, reach)
    item = F.struct("i", F.col("raw.line_number").alias("line"), "ks", "raw")
    several = each.where("n > 1").withColumn("ahead", F.collect_list(item).over(ahead)).where(F.array_contains("ks", 0))
    several = several.withColumn("h", _walk(F.col("ahead"), F.col("weights"), F.col("n"))).withColumn("score", F.col("h.found") / F.col("n")).where(F.col("score") >= SHARE)
    at = F.transform("h.at", lambda i: F.element_at(F.filter("ahead", lambda x: x["i"] == i), 1)["raw"])
    start = single.unionByName(several.select("page_id", "field_key", "label", "score", F.col("h.at").alias("at"), at.alias("tokens")))
    start = start.withColumn("inline", inline_value(F.element_at("tokens", -1)["token_text"]))
    order = F.struct((-F.col("score")).alias("a"), F.size("at").alias("b"), (F.col("inline") == "").alias("c"), F.col("label").alias("d"), F.col("at").alias("e"))
    best = start.groupBy("page_id", "field_key").agg(F.min_by(F.struct("label", "score", "inline", "tokens"), order).alias("m"))
    return best.select("page_id", "field_key", "m.label", F.round("m.score", 6).alias("score"), "m.inline", "m.tokens")


def looks_like_label(text: Column, words: tuple[str, ...] = ()) -> Column:
    return text.endswith(":") | (F.lower(text).isin(*words) if words else F.lit(False))


def below_label(tokens: DataFrame, labels: DataFrame, words: tuple[str, ...] = (), most: int = 4) -> DataFrame:
    """The values below labels (page_id, label_line, label_word, lx0, lx1, ly1, row): in the label's column, from the first
    line below with a token that is no label, over at most two lines, labels skipped, the first ``most`` tokens."""
    reach = F.col("ly1") + F.greatest(F.col("row") * 2.5, F.lit(0.06))
    near = (F.col("y0") >= F.col("ly1") - 0.005) & (F.col("y0") <= reach) & (F.col("x0") < F.col("lx1") + 0.06) & (F.col("x1") > F.col("lx0") - 0.03)
    own = (F.col("line_number") == F.col("label_line")) & (F.col("word_number") == F.col("label_word"))
    met = tokens.join(labels.withColumnRenamed("page_id", "_p"), (F.col("page_id") == F.col("_p")) & near & ~own)
    met = met.withColumn("_label", looks_like_label(F.col("token_text"), words))
    label = Window.partitionBy("page_id", "label_line", "label_word")
    order = label.orderBy("y0", "x0", "line_number", "word_number")
    met = met.withColumn("_first", F.min(F.when(~F.col("_label"), F.struct("y0", "x0", "line_number"))).over(label)["line_number"])
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("_over", F.sum((F.col("line_number") > F.col("_first") + 1).cast("int")).over(run))
    kept = met.where((F.col("_over") == 0) & (F.col("line_number") >= F.col("_first")) & ~F.col("_label"))
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("page_id", "label_line", "label_word", "place", "token_text")


def top_page_first(found: DataFrame) -> DataFrame:
    """Of a field's values on several pages of a job that of the page with the most labels, then the first page."""
    n = F.count("*").over(Window.partitionBy("job_id", "page_number"))
    w = Window.partitionBy("job_id", "field_key").orderBy(F.col("_n").desc(), "page_number")
    return found.withColumn("_n", n).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_n", "_r")
