"""Secret scans: base patterns, and multipart credentials linked by an interval join.

Base findings stand on their own: an assignment to a secret's name, a long access identifier, a long run of hex.
Weak candidates (a short access identifier, a short assigned value, a token of mixed characters, an endpoint)
mean little alone. They are reported only when the complementary parts of a credential lie in the same scope,
that is, not more than ``scope`` code points away:

* a weak identifier needs a secret (weak, assigned or hex);
* a weak secret needs an identifier (weak or base);
* an endpoint needs an identifier and a secret.

The join deals intervals to fixed-width cells of a document. Per cell and role it keeps the smallest start and the
largest end, both clipped to the cell; as a scope is at least as wide as a cell, these two decide exactly whether a
part reaches into a scope, so no pairs are made however many parts a document has.

Defined results: a null text counts as empty and has no spans; rows with equal ids but different texts are told apart
by a hash of the text; repeated rows each get their own row; a null id is carried along. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.native import let, parts_of, running
from quire.llm.storage import cut

SCOPE = 200

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a run that is long enough starts where the shorter pattern's run starts
ASSIGN_MIN, ACCESS_MIN = 12, 18

WEAK_ASSIGN_MIN, WEAK_ACCESS_MIN = 6, 8
TOKEN = r"[A-Za-z0-9+/=_-]{20,}"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]+"""

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "weak_access", "weak_assign", "weak_token", "endpoint")
IDENTIFIER, SECRET, PLACE = 0, 1, 2
_ROLE = {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET, "weak_access": IDENTIFIER, "weak_assign": SECRET, "weak_token": SECRET, "endpoint": PLACE}
_SPANS = "array<struct<s:int,e:int,k:int>>"


def _matches(text: Column, pattern: str, group: int) -> Column:
    """``[s, e, g]`` of each match, leftmost and non-overlapping: start, end, and the text of ``group``."""

    def of(parts: Column) -> Column:
        whole, gaps = parts["whole"], parts["gaps"]
        steps = F.transform(whole, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return let(
            running(steps, lambda at, x: at + x),
            lambda out: F.transform(whole, lambda m, i: F.struct((F.get(out, i) - F.length(m)).alias("s"), F.get(out, i).alias("e"), F.get(parts["of"], i).alias("g"))),
        )

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("of"),
    )
    none = F.array().cast("array<struct<s:int,e:int,g:string>>")
    return F.when(text.rlike(pattern), let(parts, of)).otherwise(none)


def _spans(found: Column, keep, kind: str) -> Column:
    return F.transform(F.filter(found, keep), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit(KINDS.index(kind)).alias("k")))


def _mixed(token: Column) -> Column:
    """Upper case, lower case and digits, and not a run of hex that the base has."""
    return token.rlike("[0-9]") & token.rlike("[A-Z]") & token.rlike("[a-z]") & ~token.rlike(HEX)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_weak``, arrays of spans (start, end, kind)."""
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("_f", F.struct(_matches(t, ASSIGN, 2).alias("assign"), _matches(t, ACCESS, 0).alias("access"), _matches(t, HEX, 0).alias("hex"), _matches(t, TOKEN, 0).alias("token"), _matches(t, ENDPOINT, 0).alias("endpoint")))
    size = lambda m, least, most=None: (F.length(m["g"]) >= least) & ((F.length(m["g"]) < most) if most else F.lit(True))
    base = F.concat(
        _spans(F.col("_f.assign"), lambda m: size(m, ASSIGN_MIN), "assign"),
        _spans(F.col("_f.access"), lambda m: size(m, ACCESS_MIN), "access"),
        _spans(F.col("_f.hex"), lambda m: F.lit(True), "hex"),
    )
    weak = F.concat(
        _spans(F.col("_f.access"), lambda m: size(m, WEAK_ACCESS_MIN, ACCESS_MIN), "weak_access"),
        _spans(F.col("_f.assign"), lambda m: size(m, WEAK_ASSIGN_MIN, ASSIGN_MIN), "weak_assign"),
        _spans(F.col("_f.token"), lambda m: _mixed(m["g"]), "weak_token"),
        _spans(F.col("_f.endpoint"), lambda m: F.lit(True), "endpoint"),
    )
    return docs.withColumn("_base", F.array_sort(base)).withColumn("_weak", F.array_sort(weak)).drop("_f")


def _role(kind: Column) -> Column:
    return F.get(F.array(*(F.lit(_ROLE[k]) for k in KINDS)), kind)


def link(scanned: DataFrame, keys: list[str], scope: int = SCOPE) -> DataFrame:
    """``keys`` and ``_linked``, the weak spans whose complementary parts co-occur, of each document that has any."""
    everything = F.concat("_base", "_weak")
    has = lambda role: F.exists(everything, lambda x: _role(x["k"]) == role)
    rows = scanned.where((F.size("_weak") > 0) & has(IDENTIFIER) & has(SECRET)).select(*keys, F.explode(everything).alias("p"), F.lit(scope).alias("_b"))
    rows = rows.select(*keys, "p.*", _role(F.col("p.k")).alias("role"), (F.col("p.k") >= KINDS.index("weak_access")).alias("weak"))
    cell = lambda x: F.floor(x / F.lit(scope)).cast("int")
    offers = (
        rows.where(F.col("role") != PLACE)
        .select(*keys, "role", "s", "e", F.explode(F.sequence(cell(F.col("s")), cell(F.col("e") - 1))).alias("cell"))
        .groupBy(*keys, "cell", "role")
        .agg(F.min(F.greatest("s", F.col("cell") * scope)).alias("lo"), F.max(F.least("e", (F.col("cell") + 1) * scope)).alias("hi"))
        .groupBy(*keys, "cell")
        .agg(*(F.max(F.when(F.col("role") == r, F.struct("lo", "hi"))).alias(f"_r{r}") for r in (IDENTIFIER, SECRET)))
    )
    seekers = rows.where("weak").withColumns({"_from": F.greatest(F.col("s") - scope, F.lit(0)), "_to": F.col("e") + scope})
    seekers = seekers.withColumn("cell", F.explode(F.sequence(cell(F.col("_from")), cell(F.col("_to")))))
    reached = lambda r: F.coalesce((F.col(f"_r{r}.lo") <= F.col("_to")) & (F.col(f"_r{r}.hi") >= F.col("_from")), F.lit(False))
    needs = lambda r: F.col("role") == (SECRET if r == IDENTIFIER else IDENTIFIER)
    offers = offers.withColumnsRenamed({k: f"_o_{k}" for k in [*keys, "cell"]})
    on = [*(F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys), F.col("cell") == F.col("_o_cell")]
    joined = seekers.join(offers, on).select(*keys, "s", "e", "k", "role", reached(IDENTIFIER).alias("id"), reached(SECRET).alias("secret"))
    met = joined.groupBy(*keys, "s", "e", "k", "role").agg(F.max("id").alias("id"), F.max("secret").alias("secret"))
    met = met.where((needs(SECRET) & F.col("secret")) | (needs(IDENTIFIER) & F.col("id")) | ((F.col("role") == PLACE) & F.col("id") & F.col("secret")))
    return met.groupBy(*keys).agg(F.collect_set(F.struct("s", "e", "k")).alias("_linked"))


def find(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, ``base`` and ``spans``, sorted arrays of (start, end, kind number)."""
    slim = docs.select("doc_id", F.xxhash64(text, F.length(text)).alias("_h"), text)
    scanned = cut(scan(slim, text).drop(text))  # spans only; three plans read them
    linked = link(scanned, ["doc_id", "_h"], scope).withColumnsRenamed({"doc_id": "_id", "_h": "_lh"})
    on = [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("_h") == F.col("_lh")]
    by = lambda x, y: F.when(x["s"] != y["s"], F.signum(x["s"] - y["s"])).when(x["k"] != y["k"], F.signum(x["k"] - y["k"])).otherwise(F.signum(x["e"] - y["e"])).cast("int")
    return scanned.join(linked, on, "left").select(
        "doc_id", "_h",
        F.array_sort("_base", by).alias("base"),
        F.array_sort(F.concat("_base", F.coalesce("_linked", F.array().cast(_SPANS))), by).alias("spans"),
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return find(docs, text, scope).select(
        "doc_id", *(count(k) for k in ("assign", "access", "hex")),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def _merged(spans: Column) -> Column:
    """Sorted ``spans`` as (s, e), those that overlap or touch as one."""
    furthest = running(F.transform(spans, lambda x: x["e"]), lambda at, e: F.greatest(at, e))

    def of(upto: Column) -> Column:
        first = F.filter(F.transform(spans, lambda x, i: F.when((i == 0) | (x["s"] > F.get(upto, i - 1)), i)), lambda i: i.isNotNull())
        return let(first, lambda at: F.transform(at, lambda i, j: F.struct(F.get(spans, i)["s"].alias("s"), F.get(upto, F.coalesce(F.get(at, j + 1), F.size(spans)) - 1).alias("e"))))

    return let(furthest, of)


def redact(docs: DataFrame, text: str = "text", scope: int = SCOPE, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every reported span but endpoints replaced by ``mark``; overlapping spans become one mark."""
    found = find(docs, text, scope).where(F.size("spans") > 0).dropDuplicates(["doc_id", "_h"])
    merged = let(F.filter("spans", lambda x: x["k"] != KINDS.index("endpoint")), _merged)
    cuts = found.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_fh"), merged.alias("_cuts"))
    keyed = docs.select("doc_id", text, F.xxhash64(text, F.length(text)).alias("_h"), F.struct(*docs.columns).alias("_row"))
    joined = keyed.join(cuts, keyed["doc_id"].eqNullSafe(cuts["_id"]) & (keyed["_h"] == cuts["_fh"]), "left")
    gaps = F.transform("_cuts", lambda x, i: F.struct(F.coalesce(F.get("_cuts", i - 1)["e"], F.lit(0)).alias("s"), x["s"].alias("e")))
    tail = F.substring(F.col(text), F.element_at("_cuts", -1)["e"] + 1, F.length(text))
    clean = F.when(F.coalesce(F.size("_cuts"), F.lit(0)) > 0, F.concat(F.array_join(F.transform(parts_of(F.col(text), gaps), lambda p: F.concat(p, F.lit(mark))), ""), tail)).otherwise(F.col(text))
    return joined.select(*((clean if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
