"""WARC: legacy archive converter.

Pages are kept as legacy ARC archives, converted record by record to WARC, and
read back. ARC version 1 and 2 header lines are parsed by the version block of
their file, blocks are taken by declared length and carried byte for byte, and
the WARC identifiers, timestamps, types and digests are synthesised. A block that
begins with an HTTP status line becomes a response (or the revisit of one, which
keeps its HTTP head alone), any other a resource; each file begins with a
warcinfo record. A record's identifier comes of its archive's name and its place
there, and a revisit names that of its response, with its URI and date.

Archives are written and read with Spark's own text source (a record ends in a
newline in either format), gzip-compressed so that one task streams one file in
order; a reader holds one record at a time, never a file. Nothing opens a path
outside Spark, so any store that Spark reaches will do.

Defined results: a null html is an empty payload; a null url becomes ``-``;
white space in a url is percent-encoded in the archive. Of the records with
equal payloads those with the largest page_id (a header of the archived block)
are responses (all of them, should that id repeat) and others revisit one of
them; a missing page_id counts as smallest, so archives without any become
responses alone. A payload is what follows the HTTP head as archived. An empty
table gives empty archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import shared_dir, staged

ARC_SCHEMA = "record_id string, page_id long, url string, ip string, stamp string, content_type string, payload_bytes long, payload_digest string, block binary"
WARC_SCHEMA = "record_id string, record_type string, page_id long, url string, date string, refers_to_id string, payload_bytes long, payload_digest string, payload binary"
SOFTWARE = "docloom"
#: The first lines of version blocks, and the field names of each version's header lines.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Of the writer: gzip's level 4 takes about a third of the default's time, for files 4 % larger.
GZIP = {"compression": "gzip", "zlib.compress.level": "FOUR"}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _encoded(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def _http(page_id: int | None, payload: bytes) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def write_arc(pages: DataFrame, path: str, version: int = 2, stamp: str = "20000101000000") -> None:
    """Write (page_id, url, html) as gzip-compressed ARC files of the given version, each with its version block."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = f"{version} 0 docloom\n{ARC_FIELDS[version]}\n".encode()
        opening = f"filedesc://pages.arc 0.0.0.0 {stamp} text/plain " + ("200 - - 0 pages.arc " if version == 2 else "")
        yield pa.record_batch([pa.array([opening.encode() + b"%d\n" % len(about) + about], pa.binary())], ["value"])
        for batch in batches:
            out = []
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block = _http(page_id, html or b"")
                head = f"{_encoded(url)} 0.0.0.0 {stamp} text/html " + ("200 - - 0 pages.arc " if version == 2 else "")
                out.append(head.encode() + b"%d\n" % len(block) + block)
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("binary").alias("html"))
    rows.mapInArrow(lines, "value binary").select(F.col("value").cast("string").alias("value")).write.options(lineSep="\n", **GZIP).text(path)


class _Bytes:
    """Lines of whole archives as a stream: header lines, and blocks of declared length. ``file`` and ``at`` say where the last line began."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        self.rest, self.file, self.read, self.at = b"", 0, 0, 0

    def _next(self) -> bytes | None:
        value, file = next(self.rows, (None, None))
        if file is None:
            return None
        if file != self.file:
            self.file, self.read = file, 0
        line = (value or b"") + b"\n"
        self.read += len(line)
        return line

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the last archive."""
        if not self.rest:
            row = self._next()
            if row is None:
                return None
            self.rest = row
        self.at = self.read - len(self.rest)
        head, end, self.rest = self.rest.partition(b"\n")
        if not end:
            raise ValueError("an archive ends within a record")
        return head

    def block(self, length: int) -> bytes:
        parts, have, own = [self.rest], len(self.rest), self.file
        while have < length:
            row = self._next()
            if row is None or self.file != own:
                raise ValueError("an archive is shorter than a record declares")
            parts.append(row)
            have += len(row)
        data = b"".join(parts)
        self.rest = data[length:]
        return data[:length]


def _archive_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string").option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_name").alias("file"))


def _head_length(block: bytes) -> int:
    """Bytes of an HTTP head with the empty line that ends it; none for what is no HTTP message."""
    if not block.startswith(b"HTTP/"):
        return 0
    ends = [at + len(end) for end in (b"\r\n\r\n", b"\n\n") if (at := block.find(end)) >= 0]
    return min(ends, default=len(block))


def _page_id(head: bytes) -> int | None:
    """The page_id that ``write_arc`` puts in the head."""
    at = head.find(b"\r\nX-Page-Id: ")
    return int(head[at + 13 : head.index(b"\r\n", at + 2)]) if at >= 0 else None


def _batched(records: Iterator[tuple], names: str, size: int = 200, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [pa.field(n, kinds[k]) for n, k in (x.split() for x in names.split(", "))]
    rows, held = [], 0
    for record in records:
        rows.append(record)
        held += len(record[-1] or b"")
        if len(rows) >= size or held >= most:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))
            rows, held = [], 0
    if rows:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))


def parse_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Records of ARC archives; each header line is read as the last version block of its archive says."""
    data, version, file = _Bytes(batches), 1, 0
    while (line := data.line()) is not None:
        if not line.strip():
            continue
        if data.file != file:
            file, version = data.file, 1
        at, about = data.at, line.startswith(b"filedesc:")
        block = data.block(int(line.rsplit(b" ", 1)[-1]))
        if about:
            version = int(block.split(b" ", 1)[0])
            continue
        names = ARC_FIELDS[version].split(" ")
        fields = line.decode(errors="surrogateescape").rsplit(" ", len(names) - 1)  # a url may hold blanks
        if len(fields) != len(names):
            raise ValueError(f"not a header line of ARC version {version}: {line[:200]!r}")
        named = dict(zip(names, fields, strict=True))
        head = _head_length(block)
        url = named["URL"].encode(errors="surrogateescape").decode(errors="replace").replace(" ", "%20")
        body = block[head:]
        yield synthetic_id(file, at), _page_id(block[:head]), url, named["IP-address"], named["Archive-date"], named["Content-type"], len(body), base32_sha1(body), block


def read_arc(spark: SparkSession, path: str, block: bool = True) -> DataFrame:
    """Records of ARC files as rows of ``ARC_SCHEMA``; the block only where it is wanted."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = parse_arc(batches)
        yield from _batched(records if block else ((*r[:8], None) for r in records), ARC_SCHEMA)

    return _archive_lines(spark, path).mapInArrow(parsed, ARC_SCHEMA)


def synthetic_id(*parts: object) -> str:
    """A record identifier that depends on nothing but the parts, so a task that runs again gives the same."""
    return uuid.UUID(bytes=hashlib.sha256("\0".join(map(str, parts)).encode()).digest()[:16], version=4).urn


def warc_date(stamp: str) -> str:
    """An ARC time of up to 14 digits as an ISO date; digits that are missing are the earliest."""
    s = stamp + "00000101000000"[len(stamp) :]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def _written(kept: dict[str, str], block: bytes) -> bytes:
    """One WARC record without its last newline, which the text writer adds."""
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in kept.items()).encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r"


def _warcinfo(record_id: str, stamp: str) -> bytes:
    about = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC\r\n".encode()
    return _written({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{record_id}>", "WARC-Date": warc_date(stamp), "Content-Type": "application/warc-fields"}, about)


def _warc_record(info: str, record_id: str, url: str, ip: str, stamp: str, content_type: str, digest: str, block: bytes, lead: dict | None) -> bytes:
    """A response, resource or (of the response ``lead``) revisit."""
    head = _head_length(block)
    kind = "revisit" if lead else "response" if head else "resource"
    block = block[:head] if lead else block
    kept = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": warc_date(stamp), "WARC-Target-URI": url, "WARC-IP-Address": ip, "WARC-Warcinfo-ID": f"<{info}>"}
    kept |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}"}
    if lead:
        kept |= {"WARC-Refers-To": f"<{lead['record_id']}>", "WARC-Refers-To-Target-URI": lead["url"], "WARC-Refers-To-Date": warc_date(lead["stamp"]), "WARC-Profile": REVISIT_PROFILE}
    kept["Content-Type"] = "application/http; msgtype=response" if head else content_type
    return _written(kept, block)


def convert_arc(spark: SparkSession, arc: str, warc: str) -> None:
    """Convert the ARC files under ``arc`` to gzip-compressed WARC files under ``warc``.

    Who revisits whom is decided on digests alone: the record of the largest
    page_id of each digest is aggregated before anything is shuffled, and records
    meet it by a plain join, whose hot keys adaptive execution splits.
    """
    lead = F.max(F.struct("page_id", "record_id", "url", "stamp")).alias("lead")
    first = read_arc(spark, arc, block=False).where("page_id IS NOT NULL").groupBy("payload_digest").agg(lead)
    revisits = F.col("lead").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("lead.page_id"))
    rows = read_arc(spark, arc).join(first, "payload_digest", "left").select("record_id", "url", "ip", "stamp", "content_type", "payload_digest", "block", F.when(revisits, F.col("lead")).alias("lead"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            out = []
            for row in zip(*columns, strict=True):
                if info is None:
                    info = synthetic_id("warcinfo", row[0])
                    out.append(_warcinfo(info, row[3]))
                out.append(_warc_record(info, *row))
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    rows.mapInArrow(written, "value binary").select(F.col("value").cast("string").alias("value")).write.options(lineSep="\n", **GZIP).text(warc)


def parse_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    data = _Bytes(batches)
    while (line := data.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:200]!r}")
        named = {}
        while (line := data.line()) and (line := line.rstrip(b"\r")):
            k, _, v = line.decode().partition(":")
            named[k.strip().lower()] = v.strip()
        block, kind = data.block(int(named["content-length"])), named["warc-type"]
        if kind == "warcinfo":
            continue
        head = _head_length(block) if kind != "resource" else 0
        body, digest = block[head:], named["warc-payload-digest"].removeprefix("sha1:")
        if kind != "revisit" and base32_sha1(body) != digest:
            raise ValueError(f"the payload of {named['warc-record-id']} has another digest")
        yield named["warc-record-id"], kind, _page_id(block[:head]), named["warc-target-uri"], named["warc-date"], named.get("warc-refers-to"), None if kind == "revisit" else len(body), digest, None if kind == "revisit" else body


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of WARC files, but warcinfo, as rows of ``WARC_SCHEMA``; of revisits, the length is their response's alone. Declared lengths and payload digests are checked."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = parse_warc(batches)
        yield from _batched(records if payload else ((*r[:8], None) for r in records), WARC_SCHEMA)

    return _archive_lines(spark, path).mapInArrow(parsed, WARC_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits name the page of the response that they refer to by its identifier.

    The records, without payloads, are staged first, so archives are read once.
    """
    records = staged(records.select("record_id", "record_type", "page_id", "refers_to_id", "payload_bytes", "payload_digest"), "records")
    led = records.where("record_type <> 'revisit'").select(F.col("record_id").alias("__id"), F.col("page_id").alias("__page"), F.col("payload_bytes").alias("__bytes"))
    met = records.withColumn("__id", F.coalesce("refers_to_id", "record_id")).join(led, "__id", "left")
    return met.select("page_id", F.col("__bytes").alias("payload_bytes"), "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("__page")).alias("refers_to"))


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as ARC, convert the archives to WARC and return the WARC records that are read back."""
    spark = pages.sparkSession
    path = path or shared_dir(spark)
    write_arc(pages, f"{path}/arc")
    convert_arc(spark, f"{path}/arc", f"{path}/warc")
    return read_warc(spark, f"{path}/warc", payload=False)
