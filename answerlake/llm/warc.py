"""WARC archives: written as segmented records by Spark's text writer, read back as chunk rows.

A record is a row of text and the separator between rows is the empty line that ends a WARC record, so
the files are plain WARC 1.1 in gzip. A payload above `chunk` bytes is written as a response record and
`continuation` records, so neither side has to hold a whole record. The reader yields rows (record,
chunk_no, ...) that carry the running SHA-1 and length of the payload; the last row of a record has the
full ones. Gzip files are not split, so the pieces of a record arrive in order in one task.

Of records with equal payloads of at least `least` bytes, that with the largest page_id is the response
and the others refer to it; rows that repeat this page_id are responses as well. Null payloads are empty,
null urls leave out the target line, null ids are written as such and never refer or are referred to.
An empty table gives an archive without records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.session import scratch

END = "\r\n\r\n"
CHUNK = 1 << 20
#: Bytes of records sent back to Spark at a time.
BATCH = 4 << 20
LEAST = 1000
DATE = "2000-01-01T00:00:00Z"
_ID = "<urn:page:{}>"


def _head(kind: str, length: int, **fields) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {length}"])


def _cuts(payload: bytes, chunk: int) -> Iterator[bytes]:
    """Pieces of at most `chunk` bytes (four at least) that end between characters."""
    at = 0
    while at < len(payload):
        end = min(at + max(4, chunk), len(payload))
        while end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        yield payload[at:end]
        at = end


def records(page_id, url, payload: str, digest: str, original, chunk: int = CHUNK) -> Iterator[str]:
    """The texts of one page's records, without the empty line at the end."""
    data = payload.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}{END}"
    common = {
        "WARC_Record_ID": _ID.format(page_id),
        "WARC_Target_URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC_Payload_Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC_Payload_Length": len(data),
        "Content_Type": "application/http; msgtype=response",
    }
    if original is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head = _head("revisit", len(http), **common, WARC_Refers_To=_ID.format(original), WARC_Profile=profile)
        yield head + END + http
        return
    pieces = list(_cuts(data, chunk)) or [b""]
    more = {"WARC_Segment_Number": 1} if len(pieces) > 1 else {}
    yield _head("response", len(http) + len(pieces[0]), **common, **more) + END + http + pieces[0].decode()
    for number, piece in enumerate(pieces[1:], 2):
        whole = {"WARC_Segment_Total_Length": len(http) + len(data)} if number == len(pieces) else {}
        segment = {
            "WARC_Record_ID": f"<urn:page:{page_id}:{number}>", "WARC_Segment_Origin_ID": _ID.format(page_id),
            "WARC_Segment_Number": number, **whole,
        }
        yield _head("continuation", len(piece), **segment) + END + piece.decode()


def write(pages: DataFrame, path: str, least: int = LEAST, chunk: int = CHUNK) -> None:
    """Archives of pages (page_id, url, html) below `path`, one file per task."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("bytes"),
    )
    copies = (
        rows.where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
        .groupBy("digest", "bytes").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1").drop("n")
    )
    joined = rows.join(copies, ["digest", "bytes"], "left").select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("page_id") != F.col("original"), F.col("original")).alias("original"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = "software: answerlake\r\nformat: WARC File Format 1.1\r\n"
        out, size = [_head("warcinfo", len(info), Content_Type="application/warc-fields") + END + info], 0
        for batch in batches:
            for at in range(batch.num_rows):
                for text in records(*(c[at].as_py() for c in batch.columns), chunk=chunk):
                    out.append(text)
                    size += len(text)
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    joined.mapInArrow(run, "value string").write.option("lineSep", END).option("compression", "gzip").text(path)


class Reader:
    """Takes the pieces of archives between empty lines in turn and yields chunk rows."""

    def __init__(self, chunk: int = CHUNK):
        self.chunk, self.head, self.open = chunk, None, None

    def rows(self, piece: bytes) -> Iterator[tuple]:
        if self.head is None:
            if piece.strip():
                self._start(piece)
            return
        if not self.first:  # an empty line within the block
            piece = b"\r\n\r\n" + piece
        self.first = False
        piece, rest = piece[: self.need - self.got], piece[self.need - self.got :].lstrip(b"\r\n")
        self.got += len(piece)
        yield from self._take(piece, self.got >= self.need)
        if rest:  # a block that ends in a line break shifts the empty line after it
            yield from self.rows(rest)

    def _start(self, piece: bytes) -> None:
        lines = piece.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        self.head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        self.kind, self.need = self.head["warc-type"], int(self.head["content-length"])
        self.got, self.first = 0, True
        self.skip = self.head.get("content-type", "").startswith("application/http")
        self.body = not self.skip
        if self.kind in ("response", "revisit"):
            self.open = {"head": self.head, "kind": self.kind, "sha": hashlib.sha1(), "bytes": 0, "chunk": 0}

    def _take(self, piece: bytes, ended: bool) -> Iterator[tuple]:
        last, record = ended, self.open
        if ended:
            head, self.head = self.head, None
            segmented = "warc-segment-number" in head
            last = not segmented or "warc-segment-total-length" in head
        if self.kind not in ("response", "revisit", "continuation") or record is None:
            return
        if self.skip:  # the HTTP header ends at the first empty line
            self.skip, piece = False, b""
        elif not self.body:
            piece, self.body = piece[4:], True
        for at in range(0, max(1, len(piece)), self.chunk):
            part = piece[at : at + self.chunk]
            final = last and at + self.chunk >= len(piece)
            record["sha"].update(part)
            record["bytes"] += len(part)
            if part or final:
                yield self._row(record, part, final)
                record["chunk"] += 1
        if last:
            self.open = None

    def _row(self, record: dict, part: bytes, final: bool) -> tuple:
        head = record["head"]
        stated = head.get("warc-payload-digest", "sha1:").partition(":")[2]
        return (
            head["warc-record-id"], record["kind"], head.get("warc-target-uri"), head.get("warc-refers-to"),
            base64.b32decode(stated).hex() if stated else None, int(head.get("warc-payload-length", -1)),
            record["chunk"], part, record["bytes"], record["sha"].hexdigest(), final,
        )


CHUNKS = (
    "record_id string, record_type string, url string, refers_to string, stated_digest string, stated_bytes long, "
    "chunk_no int, data binary, bytes_so_far long, sha1_so_far string, last boolean"
)


def read(spark: SparkSession, path: str, payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of gzip archives; without `payload` the data column is null."""
    names = [f.partition(" ")[0] for f in CHUNKS.split(", ")]
    text = spark.read.schema("value string").option("lineSep", END).text(path)
    kinds = [pa.string()] * 5 + [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out, size = Reader(chunk), [], 0

        def batch_of(rows):
            columns = [list(c) for c in zip(*rows)]
            if not payload:
                columns[7] = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for piece in batch.column(0):
                for row in reader.rows(piece.as_py()):
                    out.append(row)
                    size += len(row[7]) + 300
                    if size >= BATCH:
                        yield batch_of(out)
                        out, size = [], 0
        if out:
            yield batch_of(out)

    return text.select(F.col("value").cast("binary")).mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads back one row per record."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    full = F.col("record_type") == "response"
    return read(pages.sparkSession, path, payload=False).where("last").select(
        F.when(page("record_id") != "", page("record_id")).cast("long").alias("page_id"),
        F.when(full, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(full, F.col("sha1_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type", F.when(page("refers_to") != "", page("refers_to")).cast("long").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
c AS (SELECT payload_digest, payload_bytes, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN c USING (payload_digest, payload_bytes)
"""
