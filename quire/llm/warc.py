"""WARC archives: write with deduplication, index first, then coalesced byte-range reads.

Writing: records with equal payloads of at least ``MIN_DEDUP`` bytes are stored once, by the smallest page id, and the
others become revisit records. Every task writes archives of its own, under names that no other attempt shares, through
a file system that both driver and executors reach; each record is a gzip member of its own, and an archive begins with a
warcinfo record. A record's id comes from its archive and place, so no two are alike, also where page ids repeat or are null;
the page's id, and that of the page a revisit refers to, are fields of their own. What the writing stage
returns is the index: file, offset, length, URL, digest, id. It is stored before anything is read, so an attempt that
was lost leaves at most a file that no index row names.

Reading: the index rows that are wanted are dealt out by file and stretch of file, sorted by offset, and neighbours at
most ``GAP`` bytes apart are fetched by one range read of at most ``MOST`` bytes.

Defined results: null html is an empty payload; null ids sort after all others, and a group of equal payloads that has
no id at all is all response; rows with the smallest id of a group that occurs more than once are all response; null
URLs are written as empty; other columns are not archived.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.storage import BROADCAST_BYTES, fresh_dir, sized_broadcast, stored, text_batches

MIN_DEDUP = 100
GAP = 64 << 10
MOST = 8 << 20
#: Archive bytes a task reads, by the index: their number sets the number of tasks, as the index itself is small.
TASK_BYTES = 128 << 20
#: Payload bytes after which a task starts its next archive.
ARCHIVE_BYTES = 256 << 20
INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def plan(pages: DataFrame, min_dedup: int = MIN_DEDUP) -> DataFrame:
    """page_id, url, payload, digest, payload_bytes, record_type and refers_to of each page."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", payload.alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    keys = pages.select("page_id", payload.alias("payload")).select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    first = keys.where(F.col("payload_bytes") >= min_dedup).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 AND _first IS NOT NULL")
    # Small payloads have no group; their keys differ, so that they don't meet in one task.
    p = p.withColumn("_key", F.when(F.col("payload_bytes") >= min_dedup, F.col("digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit("")))))
    # What is joined to the payloads are the first ids of repeated digests; while they fit, no payload moves.
    first = stored(first.select(F.col("digest").alias("_key"), "_first"), "warc-first")
    p = p.join(sized_broadcast(first, BROADCAST_BYTES), "_key", "left")
    revisit = F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("_first")))
    kind = F.when(revisit, "revisit").otherwise("response")
    return p.select("page_id", "url", F.when(kind == "response", F.col("payload")).alias("payload"), "digest", "payload_bytes", kind.alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def _record_id(name: str, at: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}:{at}').urn}>"


def _info(name: str) -> bytes:
    """The first record of an archive."""
    body = b"software: quire\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id(name, 0)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _record(row: dict, record_id: str) -> bytes:
    page = "" if row["page_id"] is None else str(row["page_id"])
    url = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id}", f"X-Page-ID: {page}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{row['digest']}", f"X-Payload-Length: {row['payload_bytes']}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page: {row['refers_to']}"]
        body = http
    else:
        body = http + (row["payload"] or b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """The fields of RECORD from one gzip member."""
    import hashlib

    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    number = lambda k: int(fields[k]) if fields.get(k) else None
    out = {"page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page")}
    if out["record_type"] == "revisit":
        return out | {"payload": None, "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:")}
    payload = body.partition(b"\r\n\r\n")[2]
    digest = hashlib.sha256(payload).hexdigest()
    if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"page {out['page_id']}: the payload does not have its digest")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}


def write(records: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes ``records`` (as ``plan`` gives them) to archives in ``folder``; returns the stored index."""

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name, names = None, 0, "", ["page_id", "url", "digest", "payload_bytes", "record_type", "refers_to"]
        store, root = _file_system(folder)
        store.create_dir(root, recursive=True)
        squeezed = lambda raw: (z := zlib.compressobj(level, zlib.DEFLATED, 31)).compress(raw) + z.flush()
        try:
            for batch in batches:
                places = []
                for row in batch.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                        at = out.write(squeezed(_info(name)))
                    member = squeezed(_record(row, _record_id(name, at)))
                    out.write(member)
                    places.append((name, at, len(member)))
                    at += len(member)
                files, offsets, lengths = zip(*places) if places else ((), (), ())
                columns = [batch.column(x) for x in names] + [pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return stored(text_batches(records).mapInArrow(archives, INDEX), "warc-index")


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = MOST) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) as reads: file, start, end and the (offset, length) within."""
    held: list[tuple[int, int]] = []
    file, start, end = "", 0, 0
    for f, offset, length in rows:
        if held and (f != file or offset > end + gap or offset + length - start > most):
            yield file, start, end, held
            held = []
        if not held:
            file, start, end = f, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield file, start, end, held


def read(index: DataFrame, folder: str, payloads: bool = True, gap: int = GAP, most: int = MOST) -> DataFrame:
    """The records that ``index`` names, as RECORD; ``payloads=False`` leaves the payload out once its digest is checked."""
    parts = max(int(index.sparkSession.sparkContext.defaultParallelism), -(-(index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    dealt = index.select("file", "offset", "length").repartition(parts, F.col("file"), F.floor(F.col("offset") / most)).sortWithinPartitions("file", "offset")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        opened, name = None, None
        try:
            for batch in batches:
                rows = list(zip(*(batch.column(x).to_pylist() for x in ("file", "offset", "length"))))
                for file, start, end, members in ranges(rows, gap, most):
                    if file != name:
                        if opened is not None:
                            opened.close()
                        opened, name = store.open_input_file(f"{root}/{file}"), file
                    data = opened.read_at(end - start, start)
                    found = [parse(data[o - start : o - start + n]) for o, n in members]
                    yield pa.RecordBatch.from_pylist(found if payloads else [r | {"payload": None} for r in found], schema=schema)
        finally:
            if opened is not None:
                opened.close()

    return dealt.mapInArrow(fetch, RECORD)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    return write(plan(pages), folder)


def digest(pages: DataFrame) -> DataFrame:
    """Archives ``pages`` and returns, from the archives, one row per page."""
    folder = fresh_dir(pages.sparkSession, "warc")
    index = archive(pages, folder)
    return read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
