"""Token counts as delta-maintained rollups with idempotent batch commits.

A batch is a set of signed changes: an insert adds a document's counts, a delete takes them away, a revision takes the
old counts away and adds the new ones. A batch is summed by source, language and tokenizer version, its sums are
written under a name of this attempt's own, and one marker file, created only if no such file exists, makes them count.
So a batch that is committed twice, or by two drivers at once, counts once, and one that broke off counts not at all. A
marker is written under another name and renamed, so one that is there is whole. Where a store lets a file take a name that
is taken (object stores without a conditional put), two drivers must not commit one batch at once.
Totals are the sum of the live deltas. ``compact`` folds the live ones into one that replaces them; a replacement counts only
if all that it replaces is live when its turn comes, so of two that fold the same batch one counts and the other is void.
``tidy`` writes what is live, and the names that are taken, to one manifest, and deletes markers and deltas that it replaces.

Defined results: null and empty texts have no tokens but count as documents; a null source or language is a group of
its own; repeated rows are each a document; a group whose documents are all gone stays out of the totals; texts of any
length are counted whole; columns of any names pass through ``counted``, and ``n_words`` and ``n_bpe`` are replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.llm.native import unused, words_of
from quire.llm.storage import files_for, packed, sized_broadcast, text_batches, write_packed

GROUP = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
# Fixed value: the pattern that the public byte-level vocabularies split text by.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_encoders: dict = {}


def encoder(vocabulary: str):
    """The tokenizer of a rank file, read once per worker."""
    if vocabulary not in _encoders:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_bpe`` (tokens of the vocabulary) and ``n_words``, in place of columns of those names."""
    rest = [c for c in docs.columns if c not in (text, "n_words", "n_bpe")]
    slim = docs.select(*rest, F.size(words_of(F.col(text))).cast("long").alias("n_words"), F.col(text).alias(unused(docs.columns, "_text")))
    schema = StructType([*slim.schema.fields[:-1], StructField("n_bpe", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary).encode_ordinary
        for batch in batches:
            n = pa.array([len(tokens(x)) if (x := t.as_py()) else 0 for t in batch.columns[-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=schema.names)

    return text_batches(slim).mapInArrow(count, schema)


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """``rows`` (source, lang, n_bpe, n_words) as changes of one sign, a row per tokenizer version."""
    versions = F.explode(F.array(F.struct(F.lit("byte_bpe_50k").alias("tokenizer"), F.col("n_bpe").alias("n")), F.struct(F.lit("words").alias("tokenizer"), F.col("n_words").alias("n"))))
    v = rows.select("source", "lang", versions.alias("v"))
    return v.select("source", "lang", "v.tokenizer", F.lit(sign).cast("long").alias("n_docs"), (F.col("v.n") * sign).alias("n_tokens"))


def summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*GROUP).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))


class Rollup:
    """Totals kept in ``folder``, any that Spark's Hadoop client reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.folder}/{name}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def commit(self, batch: str, changes: DataFrame, replaces: list[str] | None = None) -> bool:
        """Makes ``changes`` (source, lang, tokenizer, n_docs, n_tokens, signed) count as ``batch``; False if they do already."""
        marker = self._path(f"commits/{batch}")
        if (self._fs.exists(marker) and self._read(marker) is not None) or batch in self._manifest()["taken"]:
            return False
        attempt = f"deltas/{batch}-{uuid.uuid4().hex}"
        rows = write_packed(summed(changes), f"{self.folder}/{attempt}")
        return self._mark(batch, {"data": attempt, "rows": rows, "replaces": replaces or []})

    def _mark(self, batch: str, what: dict) -> bool:
        marker = self._path(f"commits/{batch}")
        if self._fs.exists(marker) and self._read(marker) is None:  # older ones were written in place, and may have broken off
            self._fs.delete(marker, False)
        return self._put(f"commits/{batch}", what)

    def _put(self, name: str, what: dict) -> bool:
        """Whether ``what`` got the name: it is written under another one first, so no one reads the half of it."""
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(name)
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        if not self._fs.exists(final) and self._fs.rename(draft, final):
            return True
        self._fs.delete(draft, False)
        return False

    def _manifests(self) -> list[int]:
        folder = self._path("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self) -> dict:
        """The newest manifest: ``live`` batches by name, and all names ``taken`` by batches whose markers are gone."""
        numbers = self._manifests()
        return self._read(self._path(f"manifests/{numbers[-1]:09d}")) if numbers else {"live": {}, "taken": []}

    def tidy(self, keep: int = 2) -> int:
        """Puts the live batches and all taken names into a new manifest and deletes their markers, deltas that no live batch
        names, and all but the last ``keep`` manifests; how many markers went. One driver at a time, and none that commits."""
        before, live, found = self._manifest(), self.live(), self.committed()
        numbers = self._manifests()
        number = numbers[-1] + 1 if numbers else 0
        if not self._put(f"manifests/{number:09d}", {"live": {n: {**w, "replaces": []} for n, w in live.items()}, "taken": sorted({*before["taken"], *found})}):
            return 0
        for name in found:
            self._fs.delete(self._path(f"commits/{name}"), False)
        named = {w["data"].split("/")[1] for w in live.values()}
        for status in self._fs.listStatus(self._path("deltas")):
            if status.getPath().getName() not in named:
                self._fs.delete(status.getPath(), True)
        for old in numbers[: max(0, len(numbers) + 1 - keep)]:
            self._fs.delete(self._path(f"manifests/{old:09d}"), False)
        return len(found)

    def _read(self, marker) -> dict | None:
        """What a marker says; None if its writing broke off."""
        stream = self._fs.open(marker)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def committed(self) -> dict[str, dict]:
        """Every batch by name that has been committed since the last manifest, replaced ones too."""
        if not self._fs.exists(self._path("commits")):
            return {}
        files = [status.getPath() for status in self._fs.listStatus(self._path("commits"))]
        found = {f.getName(): self._read(f) for f in files if not f.getName().startswith(".")}
        return {name: what for name, what in sorted(found.items()) if what is not None}

    def live(self) -> dict[str, dict]:
        """The committed batches that count: neither replaced nor a replacement that came second."""
        manifest = self._manifest()
        found = {name: what for name, what in self.committed().items() if name not in manifest["taken"]}
        out = manifest["live"] | {name: what for name, what in found.items() if not what["replaces"]}
        waiting = {name: what for name, what in found.items() if what["replaces"]}
        done = set(out)
        while waiting:
            ready = [n for n, what in waiting.items() if all(x in done or x not in waiting for x in what["replaces"])]
            if not ready:
                break
            name = ready[0]
            what = waiting.pop(name)
            done.add(name)
            if all(x in out for x in what["replaces"]):
                out = {n: w for n, w in out.items() if n not in what["replaces"]} | {name: what}
        return dict(sorted(out.items()))

    def totals(self) -> DataFrame:
        live = self.live().values()
        paths = [f"{self.folder}/{what['data']}" for what in live]
        deltas = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        out = summed(deltas).where("n_docs <> 0 OR n_tokens <> 0")
        known = all("rows" in what for what in live)  # older markers do not say
        return out.coalesce(files_for(sum(what["rows"] for what in live))) if known else out

    def compact(self, name: str) -> bool:
        """Folds every live batch into one called ``name``; the folded names stay taken."""
        live = self.live()
        paths = [f"{self.folder}/{what['data']}" for what in live.values()]
        return bool(live) and self.commit(name, self.spark.read.schema(DELTA).parquet(*paths), list(live))


def revised(docs: DataFrame) -> DataFrame:
    """Documents whose text changes when runs of blanks become one, with the new text."""
    new = F.regexp_replace("text", r" {2,}", " ")
    return docs.where(new != F.col("text")).withColumn("text", new)


def digest(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Totals after a load, the deletion of exact copies (all but the smallest id), a revision, and a delete sent twice."""
    docs = docs.select("doc_id", "source", "lang", "text").withColumn("_sha", F.sha2("text", 256))
    first = packed(counted(docs.withColumn("_loose", F.contains("text", F.lit("  "))), vocabulary), "token-counts")
    roll = Rollup(docs.sparkSession, folder)
    roll.commit("load", signed(first, 1))
    # A row for each text that has copies to delete, and not one for each copy.
    texts = first.where("_sha IS NOT NULL").groupBy(F.col("_sha").alias("_s")).agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most"))
    twice = sized_broadcast(packed(texts.where("_most > _least").drop("_most"), "copied"))
    of_text = F.col("_sha") == F.col("_s")
    copies = first.join(twice, of_text).where("doc_id > _least")
    roll.commit("delete-copies", signed(copies, -1))
    keep = lambda x: x.join(twice, of_text, "left").where("NOT coalesce(doc_id > _least, false)")
    # A revision takes away what the load counted; new texts are counted where they lie, and their counts meet the copies.
    new = counted(revised(docs), vocabulary)
    roll.commit("collapse-blanks", signed(keep(first.where("_loose")), -1).unionByName(signed(keep(new), 1)))
    roll.commit("delete-copies", signed(copies, -1))
    return roll.totals()
