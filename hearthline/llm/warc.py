"""WARC archives: writing pages, and a reader that salvages damaged archives.

Writing needs no code outside Spark: a record is a string that ends with two
line ends, so the text writer with that separator makes valid archives, with
the commit protocol of any Spark output.

Reading takes whole archive files (their size is bounded by the writer), walks
from record to record by ``Content-Length`` and checks what it finds. After a
failed check it searches for the next place where a record can begin (a version
line, or the magic number of the next compressed member), goes on from there,
and reports the bytes in between as a quarantined gap. The content of a
compressed member is walked in the same way; of a damaged member, what can be
unpacked before the damage is searched for records that their digest proves.
"""

from __future__ import annotations

import hashlib
import logging
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import batches, prepare, stored
from hearthline.session import working_path

#: Fixed values of the format.
VERSION = b"WARC/1.1"
END = "\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: Payloads from this size on are written once.
REVISIT_FROM = 100
#: An archive file is closed by the record that brings it to this size.
FILE_BYTES = 16 << 20
#: Bytes handed to the decompressor at a time.
CHUNK = 1 << 16

RECORD = (
    "path string, offset long, kind string, record_type string, record_id string, "
    "refers_to string, target_uri string, payload_digest string, payload_bytes long, "
    "payload binary, problem string, gap_bytes long"
)
LOG = logging.getLogger(__name__)

_VERSION_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
_LENGTH = re.compile(rb"[0-9]{1,18}\Z")


def plan_records(pages: DataFrame, smallest: int = REVISIT_FROM) -> DataFrame:
    """Pages with payload size, digest, record type and the page a revisit refers to.

    Equal payloads of at least ``smallest`` bytes are revisits of the page with
    the smallest id among them; rows that share this id are all responses, and
    so are rows without an id. Null html is an empty payload.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    digested = pages.select("page_id", "url", "html").withColumns(
        {"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha2(payload, 256)}
    )
    # Only payloads that occur again are listed. Stored, the list has a known size:
    # Spark then joins it without moving the pages where it is short.
    firsts = stored(
        digested.filter(F.col("payload_bytes") >= smallest)
        .groupBy(F.col("payload_digest").alias("first_digest"))
        .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first_page is not null")
        .select("first_digest", "first_page"),
        "warc-firsts",
    )
    joined = digested.join(firsts, F.col("payload_digest") == F.col("first_digest"), "left")
    again = F.col("first_page").isNotNull() & (F.col("page_id") > F.col("first_page"))
    return joined.select(
        *[digested[c] for c in digested.columns],
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_page")).alias("refers_to"),
    )


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def record_text(planned: DataFrame) -> DataFrame:
    """One archive record per row, without the two line ends that close it."""
    html = F.coalesce(F.col("html"), F.lit(""))
    block = F.when(F.col("record_type") == "response", F.concat(F.lit(HTTP), html)).otherwise(
        F.lit(HTTP)
    )
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("urn:none")), r"[\x00-\x20]", "%20")
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION.decode()),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"))),
        F.lit("WARC-Date: 2025-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "payload_digest"),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return planned.select(F.concat(head, F.lit(END), block).alias("value"))


def shelved(records: DataFrame, file_bytes: int) -> DataFrame:
    """``shelf`` added: the number of the archive, within a task, that a record goes to.

    A shelf is closed by the record that brings it to ``file_bytes``, so that no
    run of large records makes a large archive.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = held = 0
        for part in parts:
            shelves = []
            for size in pc.binary_length(part.column(0)).to_pylist():
                shelves.append(shelf)
                held += size + len(END)
                if held >= file_bytes:
                    shelf, held = shelf + 1, 0
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(shelves, pa.int32())], names=["value", "shelf"]
            )

    return records.mapInArrow(run, "value string, shelf int")


def write(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> str:
    """Write one record per page below ``path``, in files of ``file_bytes`` and one record at most.

    An empty table gives an archive without records.
    """
    prepare(pages.sparkSession)
    records = shelved(record_text(plan_records(pages)), file_bytes)
    records.write.option("lineSep", END).partitionBy("shelf").mode("errorifexists").text(path)
    return path


def _headers(block: bytes) -> dict[bytes, bytes]:
    found: dict[bytes, bytes] = {}
    for line in block.split(b"\n")[1:]:
        name, mark, value = line.partition(b":")
        if mark:
            found[name.strip().lower()] = value.strip()
    return found


def _one(data: bytes, at: int) -> tuple[int, dict[bytes, bytes], bytes] | str:
    """The record that begins at ``at``: (end, headers, payload), or what is wrong with it."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        return "no version line"
    close = re.compile(rb"\r?\n\r?\n").search(data, line.end() - 1)
    if not close:
        return "headers do not end"
    headers = _headers(data[at : close.start()])
    if not _LENGTH.match(headers.get(b"content-length", b"")):
        return "no content length"
    length = int(headers[b"content-length"])
    begin, end = close.end(), close.end() + length
    if end > len(data):
        return "block is cut off"
    tail = re.compile(rb"(?:\r?\n){2}").match(data, end)
    if not tail:
        return "block does not end where its length says"
    block = data[begin:end]
    kind = headers.get(b"content-type", b"")
    payload = block
    if kind.startswith(b"application/http"):
        parts = re.split(rb"\r?\n\r?\n", block, maxsplit=1)
        payload = parts[1] if len(parts) == 2 else b""
    stated = headers.get(b"warc-payload-digest", b"")
    if stated.startswith(b"sha256:") and headers.get(b"warc-type") != b"revisit":
        if hashlib.sha256(payload).hexdigest().encode() != stated[7:]:
            return "payload does not match its digest"
    return tail.end(), headers, payload


def _inflate(data: bytes, at: int) -> tuple[int, bytes, str]:
    """The compressed member at ``at``: its end, its content, and what is wrong with it.

    Of a damaged member the content is what comes out before the damage shows.
    """
    if data[at : at + 3] != MEMBER:
        return at, b"", "no member"
    engine, content, fed = zlib.decompressobj(31), [], at
    while not engine.eof and fed < len(data):
        before = engine.copy()
        try:
            content.append(engine.decompress(data[fed : fed + CHUNK]))
        except zlib.error:
            # The chunk once more, byte by byte, up to the damage.
            try:
                for byte in range(fed, fed + CHUNK):
                    content.append(before.decompress(data[byte : byte + 1]))
            except zlib.error:
                pass
            return at, b"".join(content), "damaged member"
        fed = min(fed + CHUNK, len(data))
    wrong = "" if engine.eof else "member is cut off"
    return fed - len(engine.unused_data), b"".join(content), wrong


def _proven(headers: dict[bytes, bytes]) -> bool:
    """Whether the payload was compared with a digest."""
    stated = headers.get(b"warc-payload-digest", b"")
    return stated.startswith(b"sha256:") and headers.get(b"warc-type") != b"revisit"


def salvage(data: bytes) -> Iterator[tuple]:
    """Records and gaps of one archive.

    Yields ("record", offset, headers, payload) and ("gap", offset, length,
    problem). Offsets are those in the file, where records and gaps of a plain
    archive cover every byte. Records and gaps within a compressed member share
    the member's offset; the length of such a gap is in unpacked bytes, and its
    problem tells the place in the content. A damaged member is a gap of its
    whole length, also if records that it begins with could be kept.
    """
    packed = data[:2] == MEMBER[:2] or (
        not _VERSION_LINE.search(data) and data.find(MEMBER) >= 0
    )
    return _members(data) if packed else _plain(data)


def _plain(data: bytes) -> Iterator[tuple]:
    at, gap, problem = 0, 0, ""
    while at < len(data):
        found = _one(data, at)
        if isinstance(found, str):
            problem = problem or found
            later = _VERSION_LINE.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if gap < at:
            yield "gap", gap, at - gap, problem
        end, headers, payload = found
        yield "record", at, headers, payload
        at, gap, problem = end, end, ""
    if gap < len(data):
        yield "gap", gap, len(data) - gap, problem


def _members(data: bytes) -> Iterator[tuple]:
    at, gap, problem = 0, 0, ""
    while at < len(data):
        end, content, wrong = _inflate(data, at)
        if wrong:
            problem = problem or wrong
            for kind, _, headers, payload in _plain(content):
                if kind == "record" and _proven(headers):
                    yield "record", at, headers, payload
            following = data.find(MEMBER, at + 1)
            at = following if following >= 0 else len(data)
            continue
        if gap < at:
            yield "gap", gap, at - gap, problem
        for kind, inner, a, b in _plain(content):
            yield kind, at, a, f"at {inner} of the member: {b}" if kind == "gap" else b
        at, gap, problem = end, end, ""
    if gap < len(data):
        yield "gap", gap, len(data) - gap, problem


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps of all archives below ``path``.

    One row each (``kind`` "record" or "gap"). A gap has its offset, length and
    the first problem met. Empty files give no rows. An archive is read whole
    by one task, so keep files to some tens of megabytes.
    """
    prepare(spark)
    schema = pa.schema(
        [
            ("path", pa.string()), ("offset", pa.int64()), ("kind", pa.string()),
            ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
            ("target_uri", pa.string()), ("payload_digest", pa.string()),
            ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("problem", pa.string()),
            ("gap_bytes", pa.int64()),
        ]
    )

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        text = lambda h, k: h[k].decode("utf-8", "replace") if k in h else None
        for kind, offset, a, b in salvage(data):
            if kind == "gap":
                yield (path, offset, "gap", *[None] * 7, b, a)
                continue
            digest = text(a, b"warc-payload-digest")
            yield (
                path, offset, "record", text(a, b"warc-type"), text(a, b"warc-record-id"),
                text(a, b"warc-refers-to"), text(a, b"warc-target-uri"),
                digest.rpartition(":")[2].lower() if digest else None, len(b), b, None, None,
            )

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, content in zip(part.column(0), part.column(1), strict=True):
                yield from batches(rows(name.as_py(), content.as_py() or b""), schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(parse, RECORD)


def quarantine(records: DataFrame, path: str) -> int:
    """Append the gaps among ``records`` to the log at ``path``: (path, offset, gap_bytes, problem).

    Returns how many there are; without any nothing is written.
    """
    gaps = records.filter(F.col("kind") == "gap").select("path", "offset", "gap_bytes", "problem")
    count = gaps.count()
    if count:
        gaps.write.mode("append").parquet(path)
        LOG.warning("%d damaged places of archives are listed in %s", count, path)
    return count


def page_digest(records: DataFrame, log: str | None = None) -> DataFrame:
    """What the archives say per page, from the records of :func:`read`.

    Size and digest of a response come from the payload that was read; a
    revisit takes them from the response it refers to, and has no size if that
    was lost. Gaps go to the quarantine log, by default a table in the shared
    folder.
    """
    spark = records.sparkSession
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)
    seen = stored(records.select(
        "path", "offset", "kind", "problem", "gap_bytes",
        F.when(number(F.col("record_id")) != "", number(F.col("record_id")).cast("long")).alias("page_id"),
        "payload_bytes",
        F.sha2("payload", 256).alias("read_digest"),
        "payload_digest",
        "record_type",
        F.when(number(F.col("refers_to")) != "", number(F.col("refers_to")).cast("long")).alias("refers_to"),
    ), "warc-records")
    quarantine(seen, log or working_path(spark, "warc-quarantine"))
    kept = seen.filter(F.col("kind") == "record")
    responses = kept.filter(F.col("record_type") == "response").select(
        "page_id", "payload_bytes", F.col("read_digest").alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    # Rows that share an id and payload are all responses: look each payload up once.
    origin = responses.select(
        F.col("page_id").alias("origin"),
        F.col("payload_digest").alias("origin_digest"),
        F.col("payload_bytes").alias("origin_bytes"),
    ).dropDuplicates(["origin", "origin_digest"])
    revisits = (
        kept.filter(F.col("record_type") == "revisit")
        .join(
            origin,
            (F.col("refers_to") == F.col("origin")) & (F.col("payload_digest") == F.col("origin_digest")),
            "left",
        )
        .select(
            "page_id", F.col("origin_bytes").alias("payload_bytes"), "payload_digest", "record_type",
            "refers_to",
        )
    )
    return responses.unionByName(revisits)


def archived(pages: DataFrame, log: str | None = None) -> DataFrame:
    """Write the pages to the shared folder, read the archives back, one row per page."""
    path = write(pages, working_path(pages.sparkSession, "warc"))
    return page_digest(read(pages.sparkSession, path), log)
