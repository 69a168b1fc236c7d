"""Mixing sources to target weights by hierarchical budgets.

A tree of levels (domain, language, source) gets a budget of tokens at its root. Each node deals its budget out among
its children by weight; a child that cannot take its share, because its documents times ``max_epochs`` are fewer,
takes all it has, and what is short goes to its siblings by weight, so it reaches the ancestors only when all siblings
are full. A closed node, and so all below it, can take nothing, and a parent's capacity is that of its open leaves. A leaf reads whole epochs while its budget lasts, then the prefix of one more, whose order is a seeded hash.

Dealing is a water-filling in closed form: sorted by capacity per weight, the full children are a prefix, which
running sums find, so a level of the tree is one window over its nodes and no loop. A leaf's prefix is found in two
steps: sums over cells of the hash give the cell in which the budget ends, and only that cell's documents are put in
order. No leaf's documents meet in one task.

Defined results: null and empty texts have no tokens and come along with any prefix they stand in; a null language or
source is a leaf of its own; a leaf without tokens is read whole, once, if it gets a budget at all or not; repeated
rows are each a document; a weight that is not given is 1; a weight of 0 closes a node.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.native import words_of
from quire.llm.storage import BROADCAST_BYTES, cut, sized_broadcast, stored

#: Hex digits of the order hash that name a cell: at most 16^4 cells a leaf.
CELL_DIGITS = 4


@dataclass(frozen=True)
class Mix:
    """``weights``: by level, the weight of a value under any parent. ``share``: the root's budget as a share of all tokens."""

    levels: Sequence[str] = ("domain", "lang", "source")
    weights: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    share: float = 0.6
    max_epochs: int = 3
    seed: int = 42


def domain_of(source: Column) -> Column:
    """Sources named by number: the first five are books, the next five news, the others the web."""
    number = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("bigint")
    return F.when(number < 5, "books").when(number < 10, "news").otherwise("web")


def token_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    out = F.lit(1.0)
    for value, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return out


def _dealt(nodes: DataFrame, parent: list[str], level: str, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``nodes`` (parent..., level, cap, budget of the parent) with ``got``, the node's own budget."""
    full_at = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    n = nodes.withColumn("weight", _weight(level, weights)).withColumn("full_at", full_at)
    group = Window.partitionBy(*parent)
    before = group.orderBy(F.col("full_at"), F.col(level).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    left = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.nullif(F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)), F.lit(0.0))
    n = n.withColumn("line", left).withColumn("full", F.coalesce((F.col("full_at") <= F.col("line")), F.lit(False)))
    line = F.coalesce(F.max(F.when(~F.col("full"), F.col("line"))).over(group), F.lit(0.0))
    return n.withColumn("got", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * line)).drop("weight", "full_at", "line", "full")


def leaf_budgets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """``sizes`` (levels..., tokens, one row per leaf) with ``budget``, in whole tokens."""
    levels = list(mix.levels)
    closed = [_weight(level, mix.weights) <= 0 for level in levels]
    takes = F.when(reduce(Column.__or__, closed), 0).otherwise(F.col("tokens") * mix.max_epochs).cast("long")
    caps = sizes.withColumn("cap", takes)
    root = sizes.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(mix.share)).cast("double").alias("budget"))
    budgets, key = root.withColumn("_root", F.lit(0)), ["_root"]
    for i, level in enumerate(levels):
        at = levels[: i + 1]
        nodes = caps.withColumn("_root", F.lit(0)).groupBy("_root", *at).agg(F.sum("cap").alias("cap"))
        up = budgets.withColumnsRenamed({k: f"_p_{k}" for k in key})
        met = nodes.join(up, [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in key]).drop(*(f"_p_{k}" for k in key))
        dealt = _dealt(met, key, level, mix.weights)
        key = ["_root", *at]
        budgets = dealt.select(*key, F.col("got").alias("budget"))
    leaf = budgets.drop("_root").withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long")).withColumnsRenamed({k: f"_p_{k}" for k in levels})
    return sizes.join(leaf, [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in levels]).drop(*(f"_p_{k}" for k in levels))


def _order(mix: Mix) -> Column:
    """The place of a document in the epoch ``partial``, as hex."""
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("partial").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def select(docs: DataFrame, mix: Mix) -> DataFrame:
    """Chosen documents: those of ``docs`` (doc_id, levels..., n_tokens, and any other columns), ``epoch`` from 0."""
    levels = list(mix.levels)
    own = docs.columns
    sizes = docs.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    leaves = leaf_budgets(sizes, mix)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("int")
    leaves = leaves.withColumn("partial", whole).withColumn("rest", F.col("budget") - F.col("partial") * F.col("tokens"))
    leaves = cut(leaves.select(*(F.col(k).alias(f"_l_{k}") for k in levels), "partial", "rest"))
    placed = docs.join(leaves, [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in levels]).drop(*(f"_l_{k}" for k in levels)).withColumn("_at", _order(mix)).withColumn("_cell", F.substring("_at", 1, CELL_DIGITS))
    cells = placed.where("rest > 0").groupBy(*levels, "_cell", "rest").agg(F.sum("n_tokens").alias("n"))
    by_cell = Window.partitionBy(*levels).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("upto", F.sum("n").over(by_cell))
    ends = cells.where("upto > rest").groupBy(*levels).agg(F.min(F.struct("_cell", (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
    ends = ends.select(*(F.col(k).alias(f"_l_{k}") for k in levels), F.col("e._cell").alias("_end"), F.col("e.before").alias("_before"))
    met = placed.join(ends, [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in levels], "left").drop(*(f"_l_{k}" for k in levels))
    epochs = met.where("partial > 0").select(*own, F.explode(F.sequence(F.lit(0), F.col("partial") - 1)).alias("epoch"))
    inside = met.where((F.col("rest") > 0) & (F.col("_end").isNull() | (F.col("_cell") < F.col("_end")))).select(*own, F.col("partial").alias("epoch"))
    in_order = Window.partitionBy(*levels).orderBy("_at", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = met.where((F.col("rest") > 0) & (F.col("_cell") == F.col("_end"))).withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(in_order))
    return epochs.unionByName(inside).unionByName(last.where("_upto <= rest").select(*own, F.col("partial").alias("epoch")))


def mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and epoch of every chosen document; texts are read once and not moved."""
    slim = cut(docs.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", token_count(F.col("text")).alias("n_tokens")))
    return select(slim, mix)


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of ``docs``, all its columns but an ``epoch`` of their own, that the mix has, with ``epoch``; a row for each epoch.

    What is joined to the texts is their choice, broadcast only if its stored size is at most ``BROADCAST_BYTES``.
    """
    docs = docs.drop("epoch")
    packed = docs.select("doc_id", "lang", "source", "text", F.xxhash64("text", F.length("text")).alias("_h"), F.struct(*docs.columns).alias("_row"))
    key = ["doc_id", "lang", "source", "_h"]
    slim = packed.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", token_count(F.col("text")).alias("n_tokens"), "_h")
    slim = cut(slim)
    chosen = select(slim, mix).groupBy(*key, "epoch").agg(F.count("*").alias("_chosen"))
    rows = slim.groupBy(*(F.col(k).alias(f"_n_{k}") for k in key)).agg(F.count("*").alias("_rows"))
    chosen = chosen.join(rows, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in key))).drop(*(f"_n_{k}" for k in key))
    chosen = stored(chosen.withColumnsRenamed({k: f"_c_{k}" for k in key} | {"epoch": "_epoch"}), "chosen")
    on = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in key))
    out = [*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns), F.col("_epoch").alias("epoch")]
    alone = packed.join(sized_broadcast(chosen.where("_rows = 1"), BROADCAST_BYTES), on).select(*out)
    again = chosen.where("_rows > 1")
    if not again.head(1):
        return alone
    # Rows that repeat id, text, language and source are numbered, and of each group as many come along as were chosen.
    same = packed.join(sized_broadcast(stored(again.select(*(f"_c_{k}" for k in key)).distinct(), "repeated"), BROADCAST_BYTES), on, "left_semi")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("_row")))
    numbered = same.withColumn("_place", place).join(again, on).where("_place <= _chosen")
    return alone.unionByName(numbered.select(*out))
