"""WARC archives: writing with segments and revisits, and reassembly on reading.

An archive holds records one after another, each a gzip member of its own that ends in two line
breaks. A response block is an HTTP response in chunked transfer framing. A block larger than a
segment is spread over a first record and continuation records that name the first as their
origin; reading groups them by origin, orders them by segment number, verifies the total length
and undoes the framing. A revisit refers to the record of the response with the same payload.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import bitmap
from cuelake.llm.workdir import Scratch

VERSION = b"WARC/1.1"
RECORDS = "page_id long, url string, record_type string, record_id string, refers_to string, digest string, segment long, origin string, total long, block binary"
BREAK = b"\r\n"
#: A member's last byte is that of its length, zero below 16 MB; the text writer puts it as the end of the line.
MOST_SEGMENT, LINE_END = 1 << 23, "\u0000"


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; an error if the framing is broken or ends early."""
    out, at = [], 0
    while True:
        end = body.index(BREAK, at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            if body[at:] != BREAK and not body.endswith(BREAK + BREAK):  # trailers may follow
                raise ValueError("the body ends early")
            return b"".join(out)
        if body[at + n : at + n + 2] != BREAK:
            raise ValueError("broken chunk")
        out.append(body[at : at + n])
        at += n + 2


def record(kind: str, identity: str, date: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    """One record with the two line breaks that end it."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{identity}>", f"WARC-Date: {date}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}"]
    return VERSION + BREAK + "\r\n".join(head).encode() + BREAK + BREAK + block + BREAK + BREAK


def member(record: bytes) -> bytes:
    """A gzip member without its last byte, which the writer adds."""
    out = gzip.compress(record, 6, mtime=0)
    if out[-1]:
        raise ValueError("a record is too long for the archive")
    return out[:-1]


def identity(page_id: Column, url: Column, digest: Column, copy: Column) -> Column:
    """A record's name, the same in each run: from the page's id, url and payload, and the number of the copy among equal rows."""
    return F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), F.md5(F.coalesce(url, F.lit(""))), digest, copy.cast("string")))


def _urn(key: str) -> str:
    return uuid.UUID(key).urn


def _one_line(url: str | None) -> str:
    """A url for a header line, with line breaks as escapes."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def records_of(page_id: int | None, key: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of a page: a revisit of the record ``refers_to``, or a response with its continuations."""
    common = [("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")] + ([] if page_id is None else [("X-Page-Id", str(page_id))])
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        yield record("revisit", _urn(key), date, status, [*common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_urn(refers_to)}>")])
        return
    block = status + chunked(payload, chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield record("response", _urn(key), date, block, common)
        return
    yield record("response", _urn(key), date, parts[0], [*common, ("WARC-Segment-Number", "1")])
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        yield record("continuation", uuid.uuid5(uuid.UUID(key), str(n)).urn, date, part, [("WARC-Segment-Origin-ID", f"<{_urn(key)}>"), ("WARC-Segment-Number", str(n)), *last])


def placed(pages: DataFrame, scratch: Scratch, least_bytes: int) -> DataFrame:
    """(page_id, url, payload, digest, key, refers_to): every row with its record's name, and that of the response it revisits.

    Only payloads that occur again are shuffled: rows without a partner, which a bitmap of hashes
    shows, are responses where they are. ``pages`` has page_id, url, payload and digest.
    """
    same = pages.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))).alias("first"), F.count("*").alias("k"))
    same = scratch.save(same.where("k > 1 and first is not null").select(F.xxhash64("digest").alias("h"), F.col("digest").alias("same"), "first"), "same")
    again = scratch.save(pages.groupBy("page_id", "url", "digest").count().where("count > 1").select(F.xxhash64("digest").alias("h")), "again")
    both = same.select("h").unionByName(again)
    rows = bitmap.flagged(pages.withColumn("h", F.xxhash64("digest")), both, F.col("h"), bitmap.buckets_for(both.count()), "met")
    one = F.lit(0)
    alone = rows.where("not met").select("page_id", "url", "payload", "digest", identity(F.col("page_id"), F.col("url"), F.col("digest"), one).alias("key"), F.lit(None).cast("string").alias("refers_to"))
    counted = rows.where("met").groupBy("page_id", "url", "digest").agg(F.first("payload").alias("payload"), F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    origin = identity(F.col("first.page_id"), F.col("first.url"), F.col("digest"), one)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    met = counted.join(same.drop("h"), F.col("digest") == F.col("same"), "left").select("page_id", "url", "payload", "digest", identity(F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy")).alias("key"), F.when(revisit, origin).alias("refers_to"))
    return alone.unionByName(met)


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2000-01-01T00:00:00Z", least_bytes: int = 100, segment_bytes: int = 65_536, chunk_bytes: int = 8_192, records_per_file: int = 4_000) -> None:
    """Write archives of all rows of ``pages`` to the folder ``path``, a gzip member for each record.

    Of rows with equal payloads of at least ``least_bytes`` bytes that with the smallest id is the
    response and those with larger ids revisit it; rows that share the smallest id are responses
    all. Smaller payloads are responses. Null html is an empty payload, null urls are empty. A null
    id is no smallest id: such a row revisits a response that has one, else it is a response. An
    empty table writes no record. Other columns are ignored. ``date`` is that of every record, so
    that reruns write the same; segments have 8 MB at most. Spark's text writer makes the files, so
    their names end in .txt.
    """
    if not 0 < segment_bytes <= MOST_SEGMENT:
        raise ValueError(f"segments have 1 to {MOST_SEGMENT} bytes")
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for r in batch.to_pylist():
                for x in records_of(r["page_id"], r["key"], r["url"], r["payload"], r["digest"], r["refers_to"], date, segment_bytes, chunk_bytes):
                    out.append(member(x))
                    size += len(out[-1])
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    with Scratch(pages.sparkSession, "payloads") as scratch:
        lines = placed(own, scratch, least_bytes).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
        lines.write.option("lineSep", LINE_END).option("maxRecordsPerFile", records_per_file).text(path)


_FIELD = re.compile(rb"([A-Za-z-]+): ?(.*)")


def parse(stream: io.IOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; an error if a record is broken off or not ended by two line breaks."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("not a record")
        fields = {}
        while (line := stream.readline()) != BREAK:
            k, v = _FIELD.match(line.rstrip(BREAK)).groups()
            fields[k.decode().lower()] = v.decode()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is broken off")
        if stream.read(4) != BREAK + BREAK:
            raise ValueError("a record does not end")
        yield fields, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder, as they are written: see RECORDS."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    name, page = f["warc-record-id"].strip("<>"), f.get("x-page-id")
                    rows.append({"page_id": int(page) if page else None, "url": f.get("warc-target-uri"), "record_type": f["warc-type"], "record_id": name, "refers_to": f.get("warc-refers-to", "").strip("<>") or None, "digest": f.get("warc-payload-digest", "").removeprefix("sha256:") or None, "segment": int(f["warc-segment-number"]) if "warc-segment-number" in f else None, "origin": f.get("warc-segment-origin-id", "").strip("<>") or None, "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, "block": block})
                    size += len(block)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("segment", pa.int64()), ("origin", pa.string()), ("total", pa.int64()), ("block", pa.binary())])


def _opened(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(BREAK + BREAK)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def payloads(records: DataFrame) -> DataFrame:
    """(page_id, url, record_type, record_id, refers_to, digest, payload, ok) of responses and revisits.

    Segments are grouped by origin; records in one piece are not shuffled. ok tells whether segment
    numbers run from 1, the total length is that of the parts, the framing is whole and the digest
    is that of the payload; payload is null if not. A revisit has no payload of its own.
    """

    def finish(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                payload = None
                if r["record_type"] != "revisit" and r["whole"]:
                    try:
                        payload = _opened(b"".join(r["parts"]))
                    except ValueError:
                        payload = None
                    if payload is not None and r["digest"] and hashlib.sha256(payload).hexdigest() != r["digest"]:
                        payload = None
                out.append({k: r[k] for k in ("page_id", "url", "record_type", "record_id", "refers_to", "digest")} | {"payload": payload, "ok": payload is not None or r["record_type"] == "revisit"})
            yield pa.RecordBatch.from_pylist(out, pa.schema([SCHEMA.field(n) for n in ("page_id", "url", "record_type", "record_id", "refers_to", "digest")] + [pa.field("payload", pa.binary()), pa.field("ok", pa.bool_())]))

    columns = ["page_id", "url", "record_type", "record_id", "refers_to", "digest", "parts", "whole"]
    single = records.where("segment is null").withColumns({"parts": F.array("block"), "whole": F.lit(True)}).select(*columns)
    pieces = records.where("segment is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    ordered = F.array_sort(F.collect_list(F.struct("segment", "block", "page_id", "url", "digest", "total")))
    grouped = pieces.groupBy("origin").agg(ordered.alias("found"))
    lead, last = F.element_at("found", 1), F.element_at("found", -1)
    numbered = F.transform("found", lambda p: p.segment) == F.sequence(F.lit(1).cast("long"), F.size("found").cast("long"))
    length = F.aggregate("found", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p.block))
    whole = F.coalesce(numbered & (length == last.total), F.lit(False))
    joined = grouped.select(lead.page_id.alias("page_id"), lead.url.alias("url"), F.lit("response").alias("record_type"), F.col("origin").alias("record_id"), F.lit(None).cast("string").alias("refers_to"), lead.digest.alias("digest"), F.transform("found", lambda p: p.block).alias("parts"), whole.alias("whole"))
    return single.unionByName(joined).mapInArrow(finish, "page_id long, url string, record_type string, record_id string, refers_to string, digest string, payload binary, ok boolean")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to) of every page in a folder of archives.

    A revisit has the figures of the response whose record it refers to. Figures are null where a
    payload could not be put together or the record is not there.
    """
    with Scratch(spark, "warc") as scratch:
        found = payloads(read_archives(spark, path)).select("page_id", "record_type", "record_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).alias("payload_digest"))
        found = scratch.save(found, "catalogue")
        responses = found.where("record_type = 'response'")
        target = responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of"), "payload_bytes", "payload_digest")
        revisits = found.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to").join(target, "refers_to", "left")
        out = ["page_id", "record_type", "payload_bytes", "payload_digest"]
        return scratch.keep(responses.select(*out, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits.select(*out, F.col("of").alias("refers_to"))))
