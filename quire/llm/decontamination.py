"""Benchmark decontamination: a hash set of normalised benchmark n-grams against every token window of a corpus.

The n-grams of a benchmark of at most ``max_windows`` windows travel with the plan as hash sets, so documents are
scanned where they lie and nothing is shuffled. A window is looked up by its first word, then by a 64-bit hash of its
words, and is verified word for word. The windows of a larger benchmark are a table of hashes: the hashes of the
documents' windows are joined with it, by a broadcast as long as it holds at most ``BROADCAST_BYTES`` in memory and by a
shuffle of (document, place, hash) beyond; only what is met goes back to the documents and is verified word for word
there. The result is the same in all three ways.

Defined results: null and empty texts have no words, hit nothing and are hit by nothing; an item of fewer words than
the window, but not none, is one window of its own length; equal items count each, items with a null id not; an id is
taken as a string and may be empty or hold commas; rows with equal ids are kept apart by a hash of the text; other columns
of the documents pass through ``clean``, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.native import ascii_lower, let, window_starts
from quire.llm.storage import sized_broadcast, stored

WINDOW = 10
#: Most benchmark windows that travel with the plan; beyond it they are joined.
MAX_WINDOWS = 40_000
BROADCAST_BYTES = 256 << 20
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HITS = "array<struct<i:int,n:int,k:string>>"


def item_words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A to Z lower-cased."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), GAP, -1), ""), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``n``, the words of a window joined by a space ``k``, their hash ``h`` and the ids ``items`` that have it."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(window))
    each = words.select("item", "w", width.alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - width)).alias("i"))
    part = F.slice("w", F.col("i") + 1, F.col("n"))
    keyed = each.select("item", "n", F.array_join(part, " ").alias("k"), F.xxhash64(part).alias("h"), F.element_at("w", F.col("i") + 1).alias("first"))
    return keyed.groupBy("n", "k", "h", "first").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in sorted(values))  # the words have no quotes or backslashes


def _hits_by_set(words: str, windows: list) -> Column:
    """``[i, n, k]`` of each benchmark window in the column ``words``; a long IN list is hashed once a task."""
    by_width = defaultdict(list)
    for row in windows:
        by_width[row["n"]].append(row)
    found = []
    for n, rows in sorted(by_width.items()):
        part = f"slice(w, i + 1, {n})"
        hashes = ", ".join(f"{h}L" for h in sorted({r["h"] for r in rows}))
        hit = f"get(w, i) IN ({_quoted({r['first'] for r in rows})}) AND xxhash64({part}) IN ({hashes}) AND array_join({part}, ' ') IN ({_quoted({r['k'] for r in rows})})"
        starts = f"CASE WHEN size(w) >= {n} THEN sequence(0, size(w) - {n}) ELSE CAST(array() AS array<int>) END"
        found.append(f"transform(filter({starts}, i -> {hit}), i -> named_struct('i', i, 'n', {n}, 'k', array_join({part}, ' ')))")
    return F.expr(f"get(transform(array({words}), w -> concat({', '.join(found)})), 0)") if found else F.array().cast(_HITS)


def _place(n: int):
    """A function of a start: the window of ``n`` words there. (A default argument would pass for an index.)"""
    return lambda i: F.struct(i.alias("i"), F.lit(n).alias("n"), F.xxhash64(F.slice("_w", i + 1, n)).alias("h"))


def _hits_by_join(docs: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """``doc_id``, ``_h``, ``_met``: windows that may stand in a document, by their hashes, with the words and items to verify."""
    starts = F.flatten(F.array(*(F.transform(window_starts(F.size("_w"), n), _place(n)) for n in widths)))
    each = docs.select("doc_id", "_h", F.explode(starts).alias("p")).select("doc_id", "_h", "p.n", "p.i", "p.h")
    side = sized_broadcast(windows.select("n", "h", "k", "items"), BROADCAST_BYTES)
    met = each.join(side, ["n", "h"]).groupBy("doc_id", "_h")
    return met.agg(F.collect_set(F.struct("i", "n", "k", "items")).alias("_met"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS, text: str = "text") -> DataFrame:
    """``docs`` with ``_w`` (its words), ``_hits`` (start, width, words) and ``_items`` (ids as strings)."""
    windows = benchmark_windows(benchmark, window)
    rows = windows.limit(max_windows + 1).collect()
    docs = docs.withColumn("_w", item_words(F.col(text)))
    if len(rows) <= max_windows:
        docs = docs.withColumn("_hits", _hits_by_set("_w", rows))
        if not rows:
            return docs.withColumn("_items", F.array().cast("array<string>"))
        quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        array = lambda values: f"CAST(array({', '.join(values)}) AS array<string>)"
        items = F.expr(f"map_from_arrays({array(quoted(r['k']) for r in rows)}, array({', '.join(array(map(quoted, r['items'])) for r in rows)}))")
        return docs.withColumn("_items", F.array_distinct(F.flatten(F.transform(F.array_distinct(F.transform("_hits", lambda x: x["k"])), lambda k: F.element_at(items, k)))))
    windows = stored(windows, "benchmark-windows")
    widths = [r["n"] for r in windows.select("n").distinct().collect()]  # at most ``window`` of them
    docs = docs.withColumn("_h", F.xxhash64(text, F.length(text)))
    met = stored(_hits_by_join(docs, windows, widths).withColumnsRenamed({"doc_id": "_id", "_h": "_mh"}), "benchmark-hits")
    joined = docs.join(sized_broadcast(met, BROADCAST_BYTES), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_mh")), "left").drop("_id", "_mh", "_h")
    true = F.filter(F.coalesce("_met", F.array().cast("array<struct<i:int,n:int,k:string,items:array<string>>>")), lambda x: F.array_join(F.slice("_w", x["i"] + 1, x["n"]), " ") == x["k"])
    hits = F.array_sort(F.transform("_met", lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"), x["k"].alias("k"))))
    return joined.withColumn("_met", true).withColumns({"_hits": hits, "_items": F.array_distinct(F.flatten(F.transform("_met", lambda x: x["items"])))}).drop("_met")


def hit_positions(hits: Column) -> Column:
    """0-based positions of the words inside any hit."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["i"], x["i"] + x["n"] - 1))))


def digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", "text"), benchmark, window, max_windows)
    found = found.select("doc_id", F.size("_w").cast("long").alias("n_words"), F.size(hit_positions(F.col("_hits"))).cast("long").alias("n_hit"), "_items")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` without contaminated documents, or with ``remove="spans"`` without the words that are hit.

    A removed span takes the separators inside it along; what follows it stays.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    own = {c: F.col(f"_row.`{c}`").alias(c) for c in docs.columns}
    found = scan(packed, benchmark, window, max_windows)
    if remove == "documents":
        return found.where(F.size("_hits") == 0).select(*own.values())
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    rebuilt = let(
        F.struct(hit_positions(F.col("_hits")).alias("hit"), F.split("text", word, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(word), F.lit(0)).alias("w")),
        lambda p: F.concat(F.get(p["gaps"], 0), F.array_join(F.transform(p["w"], lambda x, i: F.when(F.array_contains(p["hit"], i), F.when(F.array_contains(p["hit"], i + 1), "").otherwise(F.get(p["gaps"], i + 1))).otherwise(F.concat(x, F.get(p["gaps"], i + 1)))), "")),
    )
    return found.select(*(own | {"text": F.when(F.size("_hits") > 0, rebuilt).otherwise(F.col("text")).alias("text")}).values())
