"""Operator 4: WARC archives, with segmented records put together again.

`write` makes one record per page: a response (an HTTP message with chunked framing), or a revisit that
refers to the response of an equal payload. Blocks of over `segment_bytes` are continued in further
records, which name their origin. `read` parses archives, groups continuations by origin, orders them by
segment number, verifies the total length, and undoes the chunked framing.

Defined results: a null payload is the empty one. Of equal payloads of at least `revisit_from` bytes the
smallest page id is the response; a row that repeats that id is a response too; null ids are revisits if
the payload has an id elsewhere, else responses. Only ids, lengths and digests are grouped; a payload that
very many pages share is one partial minimum per task. A record that is cut short, lacks a segment, has a
malformed length, number or id, or contradicts its digest comes back with `intact` false, and an archive
that is cut short or damaged is read as far as it goes. No pages give no records. Headers hold a million
characters of a URL at most.

Every record is a gzip member of its own. An archive is one row for Spark, 2 GB at most, and is inflated
and parsed step by step; the archives written here hold RECORDS_PER_ARCHIVE records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import ready_python, scratch, text_of

VERSION = b"WARC/1.1"
END = "\r\n\r\n"
SEGMENT_BYTES = 32_768
#: At most so many records in an archive: readers load an archive at once, so it is bounded by segment_bytes times this.
RECORDS_PER_ARCHIVE = 512
CHUNK_BYTES = 8_192
REVISIT_FROM = 100
DATE = "2024-01-01T00:00:00Z"

#: Bytes of an archive that are taken at once (what follows a member in them is copied for each), most bytes inflated at once, and bytes of a header.
SLICE = 1 << 15
STEP = 1 << 20
MOST_HEAD = 1 << 23
NUMBER = re.compile("-?[0-9]{1,18}")

RECORD = "origin string, page_id long, kind string, segment int, total long, refers_to long, declared string, sound boolean, block binary"


def frame(payload: bytes) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i : i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unframe(body: bytes) -> bytes | None:
    """The payload of chunked framing, or None if it is broken. Chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        try:
            size = int(body[at:line].partition(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or line + 2 + size > len(body):
            return None
        if not size:
            return b"".join(parts)
        parts.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size
        if body[at : at + 2] != b"\r\n":
            return None
        at += 2


def payload_of(message: bytes) -> bytes | None:
    """The payload of an HTTP response."""
    head, found, body = message.partition(b"\r\n\r\n")
    if not found:
        return None
    return unframe(body) if b"transfer-encoding: chunked" in head.lower() else body


def records_of(page: int | None, row: int, url: str | None, payload: bytes, digest: str, first: int | None, segment_bytes: int) -> list[bytes]:
    """The record of a page, without the blank lines that end it, and its continuations."""
    name = f"<urn:page:{'' if page is None else page}#{row}>"
    uri = " ".join((url or "")[:1_000_000].split())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = http if first is not None else http + frame(payload)
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = []
    for k, part in enumerate(cuts, 1):
        head = [f"WARC-Type: {'continuation' if k > 1 else 'revisit' if first is not None else 'response'}"]
        head += [f"WARC-Record-ID: {name if k == 1 else name[:-1] + f'/{k}>'}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
        if k == 1:
            head.append(f"WARC-Payload-Digest: sha256:{digest}")
        if first is not None:
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
        if len(cuts) > 1:
            head.append(f"WARC-Segment-Number: {k}")
            head += [f"WARC-Segment-Origin-ID: {name}"] * (k > 1) + [f"WARC-Segment-Total-Length: {len(block)}"] * (k == len(cuts))
        head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(part)}"]
        out.append(b"\r\n".join([VERSION, *(x.encode() for x in head)]) + END.encode() + part)
    return out


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, revisit_from: int = REVISIT_FROM) -> None:
    """Archives of pages (page_id, url, html) under path, on any file system that Spark writes."""
    if segment_bytes > 8 << 20:
        raise ValueError("a segment has 8 MB at most")
    ready_python(pages.sparkSession)

    @F.arrow_udf("array<binary>")
    def made(page: pa.Array, row: pa.Array, url: pa.Array, payload: pa.Array, digest: pa.Array, first: pa.Array) -> pa.Array:
        cols = [c.to_pylist() for c in (page, row, url, payload, digest, first)]
        # the length that ends a member is under 2**24, so its last byte is zero: left out here, it is the separator of the files
        members = [[gzip.compress(r + END.encode(), 6, mtime=0)[:-1] for r in records_of(*x, segment_bytes)] for x in zip(*cols)]
        return pa.array(members, pa.list_(pa.binary()))

    src = pages.select("page_id", "url", text_of("html").cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    equal = (
        src.filter(F.octet_length("payload") >= revisit_from)
        .groupBy("digest")
        .agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
        .filter("n > 1 AND least IS NOT NULL")
        .select("digest", "least")
    )
    # written first, so that its size is known: if it is small, the join need not shuffle the payloads
    equal = scratch(equal, "equal")
    own = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    rows = src.join(equal, "digest", "left").withColumn("first", own).withColumn("row", F.monotonically_increasing_id())
    records = rows.select(F.explode(made("page_id", "row", "url", "payload", "digest", "first")).alias("record"))
    # each member is a "line" of these files; row numbers only tell records of one attempt of a task apart
    out = records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0")
    out.option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path)


def inflated(archive: bytes) -> Iterator[bytes]:
    """The content of an archive, plain or gzip of any number of members, piece by piece, up to where it is damaged."""
    if archive[:2] != b"\x1f\x8b":
        yield archive
        return
    rest, at, member = b"", 0, None
    while True:
        if not rest:
            rest, at = archive[at : at + SLICE], at + SLICE
        if not rest:
            return
        member = member or zlib.decompressobj(31)
        try:
            piece = member.decompress(rest, STEP)
        except zlib.error:
            return
        if piece:
            yield piece
        rest = member.unused_data if member.eof else member.unconsumed_tail
        member = None if member.eof else member


def number(text: str | None, default: int | None = None) -> int | None:
    """A whole number of 18 digits at most; -1 for what is none, the default for no text."""
    if text is None:
        return default
    return int(text) if NUMBER.fullmatch(text) else -1


def page_of(name: str) -> int | None:
    """The page id in the name of a record, or None."""
    found = name.removeprefix("<urn:page:").rstrip(">").partition("#")[0]
    return int(found) if name.startswith("<urn:page:") and NUMBER.fullmatch(found) else None


def _parsed(archive: bytes) -> Iterator[dict]:
    held, source = bytearray(), inflated(archive)

    def more() -> bool:
        piece = next(source, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[:-4]
            if not more():
                return
        del held[:at]
        while (stop := held.find(b"\r\n\r\n")) < 0 and len(held) < MOST_HEAD and more():
            pass
        whole_head, stop = stop >= 0, stop if stop >= 0 else len(held)
        fields = [x.partition(":") for x in held[:stop].decode("utf-8", "replace").split("\r\n")[1:]]
        head = {k.strip().lower(): v.strip() for k, _, v in fields}
        size = number(head.get("content-length"), 0)
        sound = whole_head and size >= 0
        size = max(size, 0)
        while len(held) < stop + 4 + size and more():
            pass
        block = bytes(held[stop + 4 : stop + 4 + size])
        segmented, total = "warc-segment-number" in head, head.get("warc-segment-total-length")
        name = head.get("warc-segment-origin-id") or head.get("warc-record-id") or f"unnamed:{hashlib.sha256(bytes(held[: stop + 4 + size])).hexdigest()}"
        segment = number(head.get("warc-segment-number"), 1)
        yield {
            "origin": name,
            "page_id": page_of(name),
            "kind": head.get("warc-type"),
            "segment": segment if -(2**31) <= segment < 2**31 else -1,
            "total": number(total) if total is not None or segmented else size,
            "refers_to": page_of(head.get("warc-refers-to", "")),
            "declared": head.get("warc-payload-digest", "").removeprefix("sha256:") or None,
            "sound": sound and len(block) == size,
            "block": block,
        }
        del held[: stop + 4 + size if whole_head else 5]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path, plain or gzip, continuations by themselves."""
    ready_python(spark)
    kind = pa.schema([("origin", pa.string()), ("page_id", pa.int64()), ("kind", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("refers_to", pa.int64()), ("declared", pa.string()), ("sound", pa.bool_()), ("block", pa.binary())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                held, size = [], 0
                for record in _parsed(archive.as_py()):
                    held.append(record)
                    size += len(record["block"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=kind)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """(origin, page_id, record_type, refers_to, declared, payload, intact): one row per record that is no continuation.

    payload is null for revisits and for what could not be put together. The segments of one record are
    gathered in one row, as its payload is.
    """
    ready_python(records.sparkSession)

    @F.arrow_udf("binary")
    def decoded(blocks: pa.Array, total: pa.Array) -> pa.Array:
        out = []
        for parts, n in zip(blocks.to_pylist(), total.to_pylist()):
            numbers = [p["segment"] for p in parts]
            whole = b"".join(p["block"] for p in parts)
            good = numbers == list(range(1, len(parts) + 1)) and n == len(whole)
            out.append(payload_of(whole) if good else None)
        return pa.array(out, pa.binary())

    joined = records.groupBy("origin").agg(
        F.max("page_id").alias("page_id"),
        F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("record_type"),
        F.max("refers_to").alias("refers_to"),
        F.max("declared").alias("declared"),
        F.max("total").alias("total"),
        F.min("sound").alias("sound"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("blocks"),
    )
    out = joined.withColumn("payload", F.when(F.col("record_type") == "response", decoded("blocks", "total")))
    intact = F.col("sound") & F.when(F.col("record_type") == "revisit", F.lit(True)).otherwise(
        F.coalesce(F.col("payload").isNotNull() & (F.coalesce("declared", F.sha2("payload", 256)) == F.sha2("payload", 256)), F.lit(False))
    )
    return out.select("origin", "page_id", "record_type", "refers_to", "declared", "payload", intact.alias("intact"))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, intact; a revisit has its response's payload."""
    told = scratch(
        reassemble(read_records(spark, path)).select(
            "page_id", "record_type", "refers_to", "declared", "intact",
            F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        ),
        "records",
    )
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    own, again = told.filter("record_type = 'response'"), told.filter("record_type = 'revisit'")
    shown = own.filter("page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared")).agg(
        F.max("payload_bytes").alias("payload_bytes")
    )
    seen = again.drop("payload_bytes", "payload_digest").join(shown, ["refers_to", "declared"], "left")
    seen = seen.withColumn("payload_digest", F.col("declared")).withColumn("intact", F.col("intact") & F.col("payload_bytes").isNotNull())
    return own.select(*names).unionByName(seen.select(*names))
