"""WARC archives: writing, reading, and reassembly of segmented records.

Writing: one record per page, an HTTP response with a chunked body. Of equal
payloads of at least ``LEAST_REVISIT`` bytes the one with the smallest id is
the response and the others are revisit records that refer to it. A block
above ``segment`` bytes is split: a first record with segment number 1 and
``continuation`` records that name it as their origin, the last with the
total length. Spark's text sink writes the files (a row is a record, the
line separator is the CRLF CRLF that ends a record), gzip for whole files.

Reading: files come through Spark's binary source and are parsed one by one
in the tasks. Segments are grouped by origin, put in order, and their length is
checked; then the chunked framing is undone.

Defined results: a null payload is an empty one; a null URL has no
Target-URI field; a null id has no id field, comes back as null and is the response
of its group only if all ids are null; equal rows are records of their own, of
which one is the response; line breaks in a URL are escaped; other columns
are ignored; an empty table gives an empty archive, which reads as empty. A
record that lacks a segment, or has the wrong total length or broken
chunks, comes back with ``sound`` false and a null payload.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passkit.llm.base import fresh_path, small, stored

SEGMENT = 16 << 10
CHUNK = 4 << 10
LEAST_REVISIT = 100
RECORDS_A_FILE = 8192
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORD = ("record_id string, type string, row_id string, url string, refers_to string, origin string, "
          "segment int, total bigint, block binary")
PAGE = "record_id string, type string, row_id string, url string, refers_to string, payload binary, sound boolean"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[a:a + size]), body[a:a + size]) for a in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes | None:
    """Body without chunked framing (extensions and trailers are skipped); None if it is broken."""
    out, at = [], 0
    while True:
        eol = body.find(CRLF, at)
        try:
            n = int(body[at:eol].split(b";")[0], 16) if eol >= 0 else -1
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        at = eol + 2 + n
        if n < 0 or body[at:at + 2] != CRLF:
            return None
        out.append(body[eol + 2:at])
        at += 2


def payload_of(block: bytes) -> bytes | None:
    """Payload of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    coding = [x.partition(b":")[2] for x in head.split(CRLF)[1:] if x.partition(b":")[0].strip().lower() == b"transfer-encoding"]
    return dechunk(body) if any(b"chunked" in c.lower() for c in coding) else body


def record_id(rid: int, part: int = 1) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{rid}/{part}'.encode()).digest())}>"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + END).encode("utf-8", "surrogatepass") + block


def records_of(rid: int, row_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment: int) -> list[bytes]:
    """The records of one page, without the CRLF CRLF that ends each."""
    if url is not None:
        url = url.replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("X-Row-Id", row_id), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(rid)), *common, ("WARC-Profile", PROFILE),
                        ("WARC-Refers-To", record_id(refers_to)), ("Content-Type", "application/http; msgtype=response")], HTTP_HEAD)]
    block = HTTP_HEAD + chunked(payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(rid)), *common, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment:
        return [record(head, block)]
    parts = [block[a:a + segment] for a in range(0, len(block), segment)]
    out = [record([*head, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(rid, k)), ("WARC-Date", DATE),
                           ("WARC-Segment-Origin-ID", record_id(rid)), ("WARC-Segment-Number", k),
                           ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)], part))
    return out


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", segment: int = SEGMENT) -> None:
    """Write the archive of ``pages`` as gzip WARC files under ``path``."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), body.alias("body"),
                        F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"), F.monotonically_increasing_id().alias("rid"))
    rows = stored(rows, "pages")  # the row numbers must not change between their uses
    first = rows.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("no"), "id", "rid"))["rid"].alias("first"))
    rows = rows.join(small(first.filter("n > 1").select("digest", "first")), "digest", "left")
    rows = rows.select("rid", F.col("id").cast("string").alias("row_id"), "url", "body", "digest",
                       F.when(F.col("first") != F.col("rid"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                cols = [c.to_pylist() for c in b.slice(at, 256).columns]
                yield pa.RecordBatch.from_arrays([pa.array([x for r in zip(*cols) for x in records_of(*r, segment)], pa.binary())], names=["record"])

    (rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path))


def parse(data: bytes) -> Iterator[tuple]:
    """Records of one file, in the columns of ``RECORD``."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        gap = data.index(b"\r\n\r\n", at)
        lines = data[at:gap].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        f = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(f["content-length"])
        block = data[gap + 4:gap + 4 + n]
        if len(block) != n or data[gap + 4 + n:gap + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"broken record at byte {at}")
        at = gap + 8 + n
        number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
        rid, kind = f.get("warc-record-id"), f["warc-type"]
        yield (rid, kind, f.get("x-row-id"), f.get("warc-target-uri"), f.get("warc-refers-to"),
               f.get("warc-segment-origin-id", rid if number else None), int(number) if number else None, int(total) if total else None, block)


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path``, in the columns of ``RECORD``; a segment has its origin's record id in ``origin``."""
    kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RECORD.split(", ")])

        for b in batches:
            for content in b.column(0):
                held, size = [], 0
                for r in parse(content.as_py()):
                    held.append(r)
                    size += len(r[-1])
                    if size >= 4 << 20:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORD)


def reassembled(rows: DataFrame) -> DataFrame:
    """Whole records of segments: blocks joined in order; ``block`` is null if a segment or the total length is wrong."""
    parts = F.array_sort(F.collect_list(F.struct("segment", F.col("block").cast("string").alias("part"), "total", "record_id", "type", "row_id", "url")))
    g = rows.groupBy("origin").agg(parts.alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["part"]), "").cast("binary")
    n = F.size("p")
    sound = F.forall(F.transform("p", lambda x, i: x["segment"] == i + 1), lambda x: x) & (
        F.get("p", n - 1)["total"] == F.octet_length(joined))
    head = F.get("p", F.lit(0))
    return g.select(F.col("origin").alias("record_id"), F.when(head["segment"] == 1, head["type"]).otherwise("continuation").alias("type"),
                    head["row_id"].alias("row_id"), head["url"].alias("url"), F.lit(None).cast("string").alias("refers_to"),
                    F.when(sound, joined).alias("block"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per whole record (columns of ``PAGE``); a revisit has no payload of its own."""
    rows = records(spark, path)
    cols = ["record_id", "type", "row_id", "url", "refers_to", "block"]
    # two passes over the files: whole records need no shuffle, only segments do
    whole = rows.filter("origin is null").select(*cols)
    joined = reassembled(rows.filter("origin is not null")).select(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got, sound = [], []
                for kind, x in zip(part.column(1).to_pylist(), part.column(5).to_pylist()):
                    body = payload_of(x) if x is not None and kind == "response" else None
                    got.append(body)
                    sound.append(body is not None if kind != "revisit" else True)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(got, pa.binary()), pa.array(sound, pa.bool_())],
                                                 names=[x.split()[0] for x in PAGE.split(", ")])

    return whole.union(joined).mapInArrow(run, PAGE)


def pages(rows: DataFrame, fields: dict) -> DataFrame:
    """One row per response or revisit, with ``fields`` (name to expression over ``payload``) of its full payload.

    A revisit takes them from the record it refers to; only the fields are
    joined, so payloads need not move. Columns: record_id, row_id, url,
    type, sound, refers_to_row, and the fields.
    """
    rows = rows.filter("type in ('response', 'revisit')").select(
        "record_id", "type", "row_id", "url", "refers_to", "sound", *[e.alias(k) for k, e in fields.items()])
    rows = stored(rows, "records")
    got = rows.filter("type = 'response'").select(F.col("record_id").alias("_rid"), F.col("row_id").alias("_row"), F.col("sound").alias("_sound"),
                                                  *[F.col(k).alias(f"_f_{k}") for k in fields])
    back = rows.filter("type = 'revisit'").join(got, F.col("refers_to") == F.col("_rid"), "left").select(
        "record_id", "row_id", "url", "type", F.coalesce("_sound", F.lit(False)).alias("sound"), F.col("_row").alias("refers_to_row"),
        *[F.col(f"_f_{k}").alias(k) for k in fields])
    own = rows.filter("type = 'response'").select("record_id", "row_id", "url", "type", "sound", F.lit(None).cast("string").alias("refers_to_row"), *fields)
    return own.union(back)


def round_trip(pages_table: DataFrame, fields: dict, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages_table`` to a fresh archive in the shared folder, read it back, and take ``fields`` of every page."""
    path = fresh_path(pages_table.sparkSession, "warc")
    write(pages_table, path, id_col, url, payload)
    return pages(read(pages_table.sparkSession, path), fields)
