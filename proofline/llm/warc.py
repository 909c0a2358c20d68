"""WARC archives: writing with revisits and segments, reading with reassembly.

Writing: each page is an HTTP response in chunked transfer framing. Of pages
with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the largest
page_id is a response record, the others are revisit records without payload.
Blocks longer than a segment are split: the first segment keeps the record's
type, the rest are continuation records that name their origin. Every record is
a gzip member of its own.

Reading: complete records are decoded where they are read. Segments are grouped
by the origin's identifier, ordered by segment number, held against the total
length that the last one states, and then decoded. A revisit's payload is that
of the record it refers to.

Defined results: null html counts as empty; a null page_id is smaller than any
other, is written without a name and never referred to; rows that repeat the
largest page_id of a payload are a response each, under one identifier; a record
whose segments do not add up, whose block is short, whose chunk framing is broken
or whose payload has another digest than it states is of type ``damaged`` without
payload; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import cut, small_batches
from proofline.llm.files import output_dir, read_file, write_file

LEAST_REVISIT = 1000
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
FILE_BYTES = 16 << 20
WINDOW_BYTES = 16 * 1024
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_CLEAN = re.compile(r"[\x00-\x20\x7f]+")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer framing."""
    parts = []
    for a in range(0, len(payload), size):
        part = payload[a : a + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The payload of a chunked framing; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        part = framed[end + 2 : end + 2 + size]
        if len(part) < size or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(part)
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response; broken framing raises ValueError."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:\s*chunked", head) else body


def checked_payload(block: bytes, size: int, digest: str | None) -> tuple[bytes | None, str | None]:
    """Payload and SHA-1 of a whole record's block; None for a block that is
    shorter than stated, broken framing, or another digest than stated."""
    try:
        payload = payload_of(block) if len(block) == size else None
    except ValueError:
        payload = None
    sha1 = None if payload is None else hashlib.sha1(payload).hexdigest()
    return (None, None) if digest not in (None, sha1) else (payload, sha1)


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def _members(archive: bytes) -> Iterator[bytes]:
    """The contents of each gzip member. Bytes are fed in windows: what a member
    leaves over of its last window is all that is copied."""
    data, at = memoryview(archive), 0
    while at < len(data):
        opened, parts = zlib.decompressobj(31), []
        while not opened.eof and at < len(data):
            window = data[at : at + WINDOW_BYTES]
            parts.append(opened.decompress(window))
            at += len(window) - len(opened.unused_data)
        yield b"".join(parts)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, by lower-case field names.

    What isn't gzip, or no WARC record within it, raises; a block may be shorter
    than its content-length if the archive ends early.
    """
    for raw in _members(archive):
        at = 0
        while at < len(raw):
            end = raw.find(b"\r\n\r\n", at)
            version, *lines = raw[at : end if end >= 0 else len(raw)].decode("utf-8", "replace").split("\r\n")
            if not version.startswith("WARC/") or end < 0:
                raise ValueError("not a WARC record")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            at = end + 4 + int(fields["content-length"])
            yield fields, raw[end + 4 : at]
            at += 4


def page_records(page: object, url: str | None, payload: bytes, sha1: str, origin: object, origin_url: str | None, name: str) -> list[bytes]:
    """The record of a page, or its segments; a revisit if ``origin`` is another page.

    A page that is an origin has the identifier its revisits refer to. ``name``
    is unique among all records and tells segments of different records apart.
    """
    urn = f"<urn:page:{page}:{sha1}>" if origin is not None and page == origin else f"<urn:page:{'' if page is None else page}:{sha1}:{name}>"
    kind = "response" if origin is None or page == origin else "revisit"
    uri = lambda u: _CLEAN.sub("%20", u) if u else None
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", urn), ("WARC-Date", DATE), ("WARC-Target-URI", uri(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("Content-Type", "application/http; msgtype=response"),
    ]
    if kind == "revisit":
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        refers = [("WARC-Refers-To", f"<urn:page:{origin}:{sha1}>"), ("WARC-Refers-To-Target-URI", uri(origin_url)), ("WARC-Refers-To-Date", DATE)]
        return [record([*fields, ("WARC-Profile", profile), *refers], _HTTP)]
    block = _HTTP + chunked(payload)
    if len(block) <= SEGMENT_BYTES:
        return [record(fields, block)]
    out = []
    for k, a in enumerate(range(0, len(block), SEGMENT_BYTES), 1):
        part = block[a : a + SEGMENT_BYTES]
        own = fields if k == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:segment:{k}:{name}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", urn)]
        own = [*own, ("X-Segment-Set", name)]
        total = len(block) if a + SEGMENT_BYTES >= len(block) else None
        out.append(record([*own, ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part))
    return out


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) and returns the archives' paths, a row each."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or output_dir(spark, "warc")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    rows = rows.withColumn("_same", F.when(F.octet_length("payload") >= least, F.col("sha1")))
    origins = rows.filter("_same is not null").groupBy("_same").agg(F.max(F.struct("page_id", "url")).alias("_origin"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    rows = rows.join(origins, "_same", "left")
    revisit = F.col("_origin.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_origin.page_id"))
    rows = rows.select("page_id", "url", "sha1", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), F.col("_origin.page_id").alias("origin"), F.col("_origin.url").alias("origin_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal held, size
            uri = write_file(folder, f"part-{part:06d}.warc.gz", b"".join(held))
            held, size = [], 0
            return pa.RecordBatch.from_pydict({"path": [uri]})

        for batch in batches:
            for row in batch.to_pylist():
                made += 1
                new = page_records(row["page_id"], row["url"], row["payload"], row["sha1"], row["origin"], row["origin_url"], f"{part}-{made}")
                held += new
                size += sum(map(len, new))
                if size >= FILE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return cut(rows.mapInArrow(run, "path string"))


def _page_id(urn: str) -> int | None:
    found = re.match(r"<urn:page:(-?\d+)", urn)
    return int(found[1]) if found else None


_READ = [("origin", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("bytes", pa.int64()), ("block", pa.binary())]


def _digest(field: str | None) -> str | None:
    return base64.b32decode(field.removeprefix("sha1:")).hex() if field else None


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                rows, size = [], 0
                for fields, block in records(read_file(uri)):
                    urn, kind = fields["warc-record-id"], fields["warc-type"]
                    number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                    refers = fields.get("warc-refers-to")
                    origin = f"{fields.get('warc-segment-origin-id', urn)} {fields.get('x-segment-set', '')}"
                    row = [origin, _page_id(urn), fields.get("warc-target-uri"), kind, _page_id(refers) if refers else None]
                    if number is not None:
                        row += [_digest(fields.get("warc-payload-digest")), int(number), int(total) if total else None, None, block]
                    elif kind == "revisit":
                        row += [_digest(fields.get("warc-payload-digest")), None, None, None, None]
                    else:
                        payload, sha1 = checked_payload(block, int(fields["content-length"]), _digest(fields.get("warc-payload-digest")))
                        row[3] = kind if payload is not None else "damaged"
                        row += [sha1, None, None, None if payload is None else len(payload), payload if with_payload else None]
                    rows.append(row)
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _READ, strict=True)], schema=pa.schema(_READ))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _READ, strict=True)], schema=pa.schema(_READ))

    return run


def _reassembled(with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                parts = row["parts"]
                block = b"".join(p["block"] for p in parts)
                good = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block)
                payload, sha1 = checked_payload(block, len(block), parts[0]["digest"]) if good else (None, None)
                kind = parts[0]["kind"] if payload is not None else "damaged"
                rows.append((parts[0]["page_id"], parts[0]["url"], None if payload is None else len(payload), sha1, kind, None, payload if with_payload else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return run


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record."""
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ddl = "origin string, page_id long, url string, kind string, refers_to long, digest string, number int, total long, bytes long, block binary"
    read = cut(archives.select("path").repartition(parts, "path").mapInArrow(_read(with_payload), ddl))
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    whole = read.filter("number is null").select("page_id", "url", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", F.col("block").alias("payload"))
    segments = read.filter("number is not null").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("number", "page_id", "url", "kind", "digest", "total", "block"))).alias("parts"))
    joined = segments.mapInArrow(_reassembled(with_payload), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    found = whole.unionByName(joined)
    plain = found.filter("record_type <> 'revisit'")
    wanted = whole.filter("record_type = 'revisit'").select(F.col("refers_to").alias("_page")).distinct()
    origins = plain.join(wanted, plain["page_id"] == wanted["_page"], "left_semi").groupBy(F.col("page_id").alias("refers_to"))
    picked = [F.min("payload_bytes").alias("_bytes")] + [F.min("payload").alias("_payload")] * with_payload
    revisits = whole.filter("record_type = 'revisit'").join(origins.agg(*picked), "refers_to", "left")
    revisits = revisits.withColumn("payload_bytes", F.col("_bytes")).withColumn("payload", F.col("_payload") if with_payload else F.col("payload"))
    out = plain.select(columns).unionByName(revisits.select(columns))
    return out if with_payload else out.drop("payload")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS origin FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM origin AND origin IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM origin THEN origin END AS refers_to
FROM w
"""
