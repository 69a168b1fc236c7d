"""Chat formatting: reply trees to conversations with a reversible template and a loss mask.

A reply tree is a set of messages with a parent each. Root-to-leaf paths come from iterative self-joins by path
doubling: round k joins every message with its ancestor 2^k replies up, so a path of n messages takes log2(n) rounds,
and a path's score is the sum along it. Branches are ranked by score; the messages of a chosen path are found by
walking the same ancestor tables from the leaf, the longest strides first, so that every ancestor is met once.

Besides the control strings of common templates, a text's own copies of the template's ``open`` are escaped; a template
whose strings could not be told apart from what stands around them is refused.

Defined results: null text and role are empty; null turns come last; equal turns are ordered by role, then text; a
message whose parent is missing is a root; messages in or below a cycle have no root and are left out; a null
conversation id is a conversation of its own; other columns are left out. One conversation is one output row, so its turns meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.native import let, parts_of, running
from quire.llm.storage import stored


@dataclass(frozen=True)
class Template:
    """``open`` role ``sep`` text ``close`` for each turn; ``loss_role`` is the one that is learned from."""

    open: str = "<|im_start|>"
    sep: str = "\n"
    close: str = "<|im_end|>\n"
    loss_role: str = "assistant"


    def __post_init__(self):
        """Refuses templates that cannot be read back: ``open`` must not arise where strings and texts meet."""
        parts = lambda x: [x[i:] for i in range(1, len(x))]
        meets = lambda x, y: any(y.startswith(p) for p in parts(x))
        if len(self.open) < 2 or not self.sep or "\\" in self.open or "%" in self.sep:
            raise ValueError("open needs two characters and no backslash, sep one and no percent sign")
        if meets(self.open, self.open) or meets(self.sep, self.open) or meets(self.open, self.sep) or meets(self.open, self.close) or self.open in self.sep + self.close:
            raise ValueError(f"{self.open!r} could arise where strings of the template meet")
        if not self.is_known() and any(meets(self.open, k) or meets(k, self.open) or k in self.open for k in _KNOWN):
            raise ValueError(f"{self.open!r} overlaps with a control string that is escaped in any case")

    def is_known(self) -> bool:
        return self.open.startswith(_KNOWN)

    def pattern(self, marks: str) -> str:
        """First character, backslashes and rest of a control string; ``marks`` are the backslashes before the third group."""
        known = rf"(?<a>[<\[]){marks}(?=\\*(?:\||/?s>|/?INST\]|</?SYS>))"
        return known if self.is_known() else rf"{known}|(?<b>{_literal(self.open[0])}){marks}(?=\\*{_literal(self.open[1:])})"


# Control strings of common templates. A text that has one gets a backslash after its first character, and one more if it
# had backslashes there already, so no control string is left and taking one backslash away gives the text back.
_KNOWN = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>", "<</SYS>")


def _literal(s: str) -> str:
    return r"\Q" + s + r"\E"


TEMPLATE = Template()


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, template.pattern(""), r"$0\\")


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, template.pattern(r"\\"), "${a}" if template.is_known() else "${a}${b}")


def _coded(template: Template) -> list[tuple[str, str]]:
    """Characters that a role cannot have as they are, and their codes."""
    return [(c, "".join(f"%{b:02X}" for b in c.encode())) for c in dict.fromkeys("%" + template.sep)]


def _escape_role(role: Column, template: Template) -> Column:
    for c, code in _coded(template):
        role = F.replace(role, F.lit(c), F.lit(code))
    return escape(role, template)


def _unescape_role(role: Column, template: Template) -> Column:
    role = unescape(role, template)
    for c, code in reversed(_coded(template)):
        role = F.replace(role, F.lit(code), F.lit(c))
    return role


def reply_chain(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees: each row answers the one before it."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(w).cast("long")
    rows = conversations.select(F.col("conv_id").alias("tree"), node.alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _strides(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """By round k the messages with an ancestor ``up`` 2^k replies above: tree, node, up, ``total`` (scores below up), ``steps``.

    Then those whose path is walked to its root: tree, node, total and steps of the whole path. They leave the rounds.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    there = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    first = nodes.join(there, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_n")), "left")
    now = stored(first.select("tree", "node", F.col("_n").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")), "strides")
    rooted, out, before = now.where("up IS NULL"), [], None
    # Paths have all lengths up to the longest, so each round ends some; when none ends, what is left are cycles.
    while (left := now.where("up IS NOT NULL").count()) and left != before:
        before, active = left, now.where("up IS NOT NULL")
        out.append(active)
        above = active.unionByName(rooted).select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("steps").alias("_steps"))
        met = active.join(above, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("up") == F.col("_n")))
        now = stored(met.select("tree", "node", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"), (F.col("steps") + F.col("_steps")).alias("steps")), "strides")
        rooted = rooted.unionByName(now.where("up IS NULL"))
    return out, rooted


def ranked_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` root-to-leaf paths of each tree by score: tree, path (rank, 1 first), position from the root, node.

    Equal scores rank by length, the longer first, then by leaf.
    """
    strides, rooted = _strides(messages)
    parents = messages.where("parent IS NOT NULL").select(F.col("tree").alias("_t"), F.col("parent").alias("_p")).distinct()
    leaves = rooted.join(parents, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_p")), "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.col("total").desc(), F.col("steps").desc(), F.col("node"))
    if top == 1:
        best = leaves.groupBy("tree").agg(F.max(F.struct("total", "steps", (-F.col("node")).alias("minus"))).alias("b"))
        path = best.select("tree", F.lit(1).alias("path"), (-F.col("b.minus")).alias("node"), F.col("b.steps").alias("position"))
    else:
        path = leaves.withColumn("path", F.row_number().over(rank)).where(F.col("path") <= top).select("tree", "path", "node", F.col("steps").alias("position"))
    for k in range(len(strides) - 1, -1, -1):
        up = strides[k].select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "up")
        more = path.join(up, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
        path = path.unionByName(more.select("tree", "path", F.col("up").alias("node"), (F.col("position") - 2**k).alias("position")))
        path = stored(path, "paths") if k % 2 == 0 else path
    return path


def format_trees(messages: DataFrame, template: Template = TEMPLATE, top: int = 1) -> DataFrame:
    """One row per chosen path: tree, path, ``formatted``, and ``mask``, the [start, end) of what is learned from."""
    path = ranked_paths(messages, top).withColumnsRenamed({"tree": "_t", "node": "_n"})
    rows = messages.join(path, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    turns = rows.groupBy("tree", "path").agg(F.array_sort(F.collect_list(F.struct("position", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    safe = F.transform("turns", lambda x: F.struct((x["role"] == template.loss_role).alias("learned"), F.concat(F.lit(template.open), _escape_role(x["role"], template), F.lit(template.sep)).alias("head"), escape(x["text"], template).alias("text")))
    return turns.withColumn("turns", safe).select(
        "tree", "path",
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["text"], F.lit(template.close))), "").alias("formatted"),
        loss_mask(F.col("turns"), len(template.close)).alias("mask"),
    )


def loss_mask(turns: Column, closing: int) -> Column:
    """[start, end) of the learned texts among ``turns`` (head, text, learned), each followed by ``closing`` characters."""
    steps = F.transform(turns, lambda x: F.length(x["head"]) + F.length(x["text"]) + closing)
    spans = lambda after: F.transform(turns, lambda x, i: F.when(x["learned"], F.struct((F.get(after, i) - closing - F.length(x["text"])).alias("s"), (F.get(after, i) - closing).alias("e"))))
    return let(running(steps, lambda at, x: at + x), lambda after: F.filter(spans(after), lambda x: x.isNotNull()))


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``turns`` (role, text) and ``learned`` (the unescaped texts under the mask) from the output alone."""
    parts = let(F.split("formatted", _literal(template.open), -1), lambda x: F.slice(x, F.lit(2), F.size(x) - 1))
    body = lambda x: F.substring(x, F.lit(1), F.length(x) - len(template.close))
    turn = lambda x: let(F.instr(x, template.sep), lambda at: F.struct(_unescape_role(F.substring(x, F.lit(1), at - 1), template).alias("role"), unescape(F.substring(x, at + len(template.sep), F.length(x)), template).alias("text")))
    learned = F.transform(parts_of(F.col("formatted"), F.col("mask")), lambda x: unescape(x, template))
    return formatted.withColumns({"turns": F.transform(F.transform(parts, body), turn), "learned": learned})


def digest(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row per conversation, from what is read back: see the contract of the query."""
    messages = stored(reply_chain(conversations), "messages")
    back = read_back(format_trees(messages, template), template)
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(F.array_join("learned", "")).cast("long").alias("loss_chars"), F.sha2(F.array_join("learned", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
