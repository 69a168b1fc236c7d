"""Quality rules as a short-circuit cascade whose order comes from measured cost and selectivity.

Each rule rejects a text on a few counts. A sample of the corpus gives every rule's cost (the time its
counts take, beyond that of a job that does nothing) and selectivity (the share it rejects of what the rules before it
leave); rules then run in descending rejection per cost, and a text that one rule rejects is not put to the later ones. ``verdicts`` has to report the base counts
of every text, so there the rules on counts cost nothing more; the others run only on texts that the base lets pass. The order changes the work, never the verdict: a text
is kept if and only if no rule rejects it.

Defined results: a null or empty text has no words and fails the base rule; a null id is carried along; repeated
rows each get their own row; other columns of the input pass through ``apply_cascade`` untouched, and those with a
clashing name are replaced only in the digest of ``measure``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.native import let, unused, window_starts, words_of
from quire.llm.storage import stored

REPEAT_WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: About as many rows, chosen by a hash of id and text, as cost and selectivity are estimated on; verdicts never depend on it.
SAMPLE_ROWS = 2000
ELLIPSIS = r"(?:\.\.\.|\x{2026})[\x20\x09-\x0D]*\z"
BULLET = r"\A[\x20\x09-\x0D]*[-*\x{2022}]"


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points that are not white space."""
    return F.coalesce(F.length(F.translate(text, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def symbol_count(text: Column) -> Column:
    found = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(text.rlike(f"[{SYMBOLS}]"), found).otherwise(F.lit(0)).cast("long")


def lines_with_words(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.coalesce(lines, F.array().cast("array<string>"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(starts: Column, width: int) -> Column:
    """How many positions windows of ``width`` at the ascending ``starts`` cover."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
        lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(width), at - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def _repeat_starts(words: Column, starts: Column, width: int) -> Column:
    """Starts of the windows whose words occur at another start too, by sorting the windows themselves."""
    keyed = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, width), " ").alias("k"), i.alias("i"))))
    equal = lambda x, y: F.coalesce(x["k"] == y["k"], F.lit(False))
    hits = let(
        keyed,
        lambda s: F.filter(
            F.transform(s, lambda x, j: F.when(equal(x, F.get(s, j - 1)) | equal(x, F.get(s, j + 1)), x["i"])),
            lambda i: i.isNotNull(),
        ),
    )
    return F.array_sort(hits)


def repeated_words(words: Column, width: int = REPEAT_WINDOW) -> Column:
    """Words inside windows of ``width`` words that the text has twice or more, the first included.

    Hashes tell the many texts without a repeat apart from those whose windows are then compared in full.
    """

    def of(w: Column) -> Column:
        windows = lambda each: F.transform(window_starts(F.size(w), width), lambda i: F.xxhash64(*(F.get(each, i + k) for k in range(width))))
        return let(
            let(F.transform(w, lambda x: F.xxhash64(x)), windows),  # a word is hashed once, not in each of its windows
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(_repeat_starts(w, window_starts(F.size(w), width), width), width)),
        )

    return let(words, of).cast("long")


def lines_like(text: Column, pattern: str) -> Column:
    """Lines with a word in which ``pattern`` is found."""
    return F.size(F.filter(lines_with_words(text), lambda x: x.rlike(pattern)))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long")


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules read, as the struct ``_m``."""
    t, w = F.col(text), unused(docs.columns, "_w")
    return docs.withColumn(w, words_of(t)).withColumn(
        "_m",
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            word_chars(t).alias("word_chars"),
            symbol_count(t).alias("n_symbols"),
            F.size(lines_with_words(t)).cast("long").alias("n_lines"),
            duplicate_lines(t).alias("n_dup_lines"),
            repeated_words(F.col(w)).alias("n_repeat_words"),
        ),
    ).drop(w)


@dataclass(frozen=True)
class Rule:
    """``rejects(text)`` is true where the rule turns a text away; it never yields null."""

    name: str
    rejects: Callable[[Column], Column]


def _per(text: Column, part: Callable[[Column], Column], whole: Callable[[Column], Column], percent: int) -> Column:
    return part(text) * 100 > whole(text) * percent


#: Mild rules: each turns away only texts that are mostly not prose.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda t: word_count(t) < 10),
    Rule("repeated_windows", lambda t: _per(t, lambda x: repeated_words(words_of(x)), word_count, 20)),
    Rule("symbols", lambda t: _per(t, symbol_count, word_count, 50)),
    Rule("duplicate_lines", lambda t: _per(t, duplicate_lines, lambda x: F.size(lines_with_words(x)), 50)),
    Rule("word_length", lambda t: let(word_count(t), lambda n: let(word_chars(t), lambda c: (n > 0) & ((c < n * 2) | (c > n * 20))))),
    Rule("ellipsis_lines", lambda t: _per(t, lambda x: lines_like(x, ELLIPSIS), lambda x: F.size(lines_with_words(x)), 30)),
    Rule("bullet_lines", lambda t: _per(t, lambda x: lines_like(x, BULLET), lambda x: F.size(lines_with_words(x)), 90)),
    Rule("letters", lambda t: letters(t) * 100 < word_chars(t) * 50),
)


@dataclass(frozen=True)
class RuleCost:
    name: str
    seconds: float
    rejected: float


def sampled(docs: DataFrame, text: str, rows: int, keys: Sequence[str] = ()) -> DataFrame:
    """About ``rows`` rows, the same ones whenever the table is the same: those whose text and ``keys`` hash to a multiple.

    With an id among the keys, copies of a text are drawn each for itself. Rows that repeat all of it could come together;
    more than four times as many rows never come.
    """
    every = max(1, docs.count() // rows)
    return docs.where(F.pmod(F.xxhash64(text, *keys), F.lit(every)) == 0).limit(4 * rows)


#: Seconds that a rule is timed for at least, beyond a job that does nothing, and most copies of the sample it is put to.
TIMED_SECONDS, MOST_COPIES = 0.1, 256
#: Rejection per cost that differs by no more than this factor counts as equal.
ALIKE = 2.0


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[RuleCost]:
    """Every rule's time over, and rejected share of, a sample of about ``sample_rows`` rows, in the order that they should run.

    What a rule costs for a character is measured once in an application, on the first sample that it is asked for: the rule
    is put to that so often within one job that it takes about ``TIMED_SECONDS`` longer than a job that does nothing, and of
    two such jobs the faster counts; before anything is timed each rule has run once, so that its code is compiled. Times vary,
    but the order does not vary with them from one call to the next. ``rejected`` is a share of what the rules before it leave.
    """
    keys = [c for c in ("doc_id",) if c in docs.columns and c != text]
    slim = docs.select(*keys, F.coalesce(text, F.lit("")).alias(text))
    sample = stored(sampled(slim, text, sample_rows, keys).select(text), "rule-sample")
    patterns = sample.groupBy(F.array(*(r.rejects(F.col(text)) for r in rules)).alias("hit")).agg(F.count("*").alias("n"), F.sum(F.length(text) + 1).alias("chars")).collect()
    chars = sum(p.chars for p in patterns) or 1
    app = docs.sparkSession.sparkContext.applicationId
    if new := [r for r in rules if (app, r) not in _COSTS]:
        for rule, seconds in zip(new, _timed(sample, new, text)):
            _COSTS[app, rule] = seconds / chars
    return in_order({r.name: _COSTS[app, r] * chars for r in rules}, [(frozenset(r.name for r, hit in zip(rules, p.hit) if hit), p.n) for p in patterns])


#: Seconds a character, by application and rule.
_COSTS: dict[tuple[str, Rule], float] = {}


def _timed(sample: DataFrame, rules: Sequence[Rule], text: str) -> list[float]:
    """The seconds that each rule takes for the sample."""

    def job(rejects: Column, copies: int) -> float:
        began = time.perf_counter()
        sample.select(text, F.explode(F.sequence(F.lit(1), F.lit(copies)))).agg(F.count_if(rejects)).first()
        return time.perf_counter() - began

    tests = [r.rejects(F.col(text)) for r in rules]
    for t in tests:
        job(t, 1)
    idle = min(job(F.col(text).isNull(), 1) for _ in range(4))
    copies = [min(MOST_COPIES, ceil(TIMED_SECONDS / max(1e-6, job(t, 1) - idle))) for t in tests]
    return [max(1e-6, min(job(t, n) for _ in range(2)) - idle) / n for t, n in zip(tests, copies)]


def in_order(seconds: dict[str, float], rejected: Sequence[tuple[frozenset[str], int]]) -> list[RuleCost]:
    """The rules by rejection per cost, each by what those before it leave; ``rejected`` counts texts by the rules that reject them.

    Times vary, so rules within ``ALIKE`` of the best are ordered by name, as are those that reject nothing more.
    """
    left, out = [(names, n) for names, n in rejected], []
    rest = sorted(seconds)
    while rest:
        total = sum(n for _, n in left)
        share = {r: sum(n for names, n in left if r in names) / total if total else 0.0 for r in rest}
        most = max(share[r] / seconds[r] for r in rest)
        best = next(r for r in rest if share[r] / seconds[r] * ALIKE >= most)
        out.append(RuleCost(best, seconds[best], share[best]))
        rest.remove(best)
        left = [(names, n) for names, n in left if best not in names]
    return out


def ordered(rules: Sequence[Rule], costs: Sequence[RuleCost]) -> list[Rule]:
    """The rules in the order of ``costs``."""
    place = {c.name: i for i, c in enumerate(costs)}
    return sorted(rules, key=lambda r: place[r.name])


def first_rejection(text: Column, rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects the text, null if none does; later rules are not computed."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(text), F.lit(rule.name)).otherwise(out)
    return out


def apply_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", costs: Sequence[RuleCost] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns; null texts count as empty."""
    order = ordered(rules, costs or estimate(docs, rules, text))
    return docs.where(first_rejection(F.coalesce(F.col(text), F.lit("")), order).isNull())


def measured_rules() -> tuple[Rule, ...]:
    """RULES over a struct of the counts of ``base_measures`` and of the text; those that counts decide read no text."""
    per = lambda m, part, whole, percent: m[part] * 100 > m[whole] * percent
    on_counts = {
        "few_words": lambda m: m["n_words"] < 10,
        "repeated_windows": lambda m: per(m, "n_repeat_words", "n_words", 20),
        "symbols": lambda m: per(m, "n_symbols", "n_words", 50),
        "duplicate_lines": lambda m: per(m, "n_dup_lines", "n_lines", 50),
        "word_length": lambda m: (m["n_words"] > 0) & ((m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 20)),
    }
    of_text = lambda rule: lambda m: rule.rejects(m["text"])
    return tuple(Rule(r.name, on_counts.get(r.name) or of_text(r)) for r in RULES)


def verdicts(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept and the first rule in RULES that rejects it."""
    base, rest = ("few_words", "repeated_windows"), [r for r in RULES if r.name not in ("few_words", "repeated_windows")]
    order = ordered(rest, estimate(docs, rest, text, sample_rows))
    by_name = {r.name: r for r in measured_rules()}
    m = base_measures(docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")))
    m = m.withColumn("_m", F.struct("_m.*", "text"))
    row = F.col("_m")
    failed = by_name[base[0]].rejects(row) | by_name[base[1]].rejects(row)
    kept = F.when(failed, False).otherwise(first_rejection(row, [by_name[r.name] for r in order]).isNull())
    out = m.withColumns({"base_failed": failed, "kept": kept})
    return out.select(
        "doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words",
        "base_failed", "kept", F.when(~F.col("kept"), first_rejection(row, list(by_name.values()))).alias("rejected_by"),
    )
