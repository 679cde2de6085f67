"""WARC archives in Zstandard with a dictionary, written and read by Spark.

An archive starts with its dictionary in a skippable frame (magic 0x184D2A5D); each record is a frame of its own with a checksum. Tasks build
archives of about ``ARCHIVE_BYTES`` and hand them to Spark's text writer, one row and so one file each; the separator that it puts behind a row is an
empty skippable frame, which readers pass over. So archives lie wherever Spark can write, and only whole ones of tasks that ended show. The
reader takes archives of others too: compressed dictionaries, none at all, other skippable frames, records of any type.

The reader finds frames by their block headers, so a damaged record costs only itself. It checks the version line, mandatory headers, header syntax,
the length against the block, and digests; what is wrong with a record stands in ``error``, and the other columns hold what could be read.

Pages of equal payloads (by SHA-1 and a second hash) are one response, that of the largest id, and revisits of it without a payload; null ids are
smallest, and rows that share the largest id are responses all. Null and empty payloads are equal to each other. Very long payloads are
an archive of their own. Characters that a header can't hold are percent-encoded; a null URL is ``about:blank``. Other columns are not read.
"""

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, shared_folder, small, table, written

ARCHIVE_BYTES = 32 << 20
#: The dictionary is made from so many pages, picked by hash, of at most so many bytes each.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 64 << 10, 64 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: Responses of repeated payloads, and those that revisits name, are broadcast up to this many (about 100 bytes each).
MAX_BROADCAST = 500_000

# Fixed values of the formats.
DICTIONARY_MAGIC, SKIPPABLE, SKIPPABLE_MASK, FRAME = 0x184D2A5D, 0x184D2A50, 0xFFFFFFF0, 0xFD2FB528
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"

RECORDS = "archive string, offset long, error string, record_type string, record_id string, target_uri string, date string, payload_bytes long, payload_digest string, refers_to string, page_id long"


def digest(data):
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, payload_digest):
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{payload_digest}'.encode()).digest())}>"


def header_value(x):
    """Printable ASCII; other bytes as %XX."""
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % ord(m[0]), (x or "about:blank").encode("utf-8", "replace")).decode()


def record(headers, block):
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    return b"".join(("\r\n".join(lines).encode(), block, b"\r\n\r\n"))


def page_record(page_id, url, payload, payload_digest, revisit, response_id):
    """A page's response, or its revisit of the response of the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = header_value(url)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, payload_digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(response_id, payload_digest) if revisit else None),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Page-ID", page_id),
        ("Content-Type", HTTP),
    ]
    return record(headers, block)


def dictionary_frame(data):
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data if data else b""


def fitted_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of the pages; empty if they are too few. No result depends on it."""
    part = max(1, pages.count() // (2 * SAMPLE_PAGES))
    place = F.xxhash64("page_id", "html")
    fits = pages.filter(F.octet_length("html").between(1, SAMPLE_BYTES) & (F.pmod(place, F.lit(part)) == 0))
    rows = fits.groupBy(place.alias("place")).agg(F.first("html").alias("html")).orderBy("place").limit(SAMPLE_PAGES).collect()  # about twice as many are left
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.html.encode("utf-8", "replace") for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        return b""


def with_responses(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, sha1, revisit, response_id)``; texts don't move unless more than ``MAX_BROADCAST`` payloads are repeated."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("sha1"), F.xxhash64(html).alias("check"))
    groups = rows.groupBy("sha1", "check").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.filter("n > 1").select(F.col("sha1").alias("of"), F.col("check").alias("and"), "response_id", F.lit(True).alias("again")))
    found = rows.join(small(groups, MAX_BROADCAST), (F.col("sha1") == F.col("of")) & (F.col("check") == F.col("and")), "left")
    revisit = F.coalesce("again", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return found.select("page_id", "url", "html", "sha1", revisit.alias("revisit"), "response_id")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record for each row of ``pages(page_id, url, html)`` to archives in ``folder``, a path that Spark can write to."""
    learned = fitted_dictionary(pages)

    def archives(batches):
        how = {"dict_data": zstandard.ZstdCompressionDict(learned)} if learned else {}
        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **how).compress
        info = pack(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", "")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        head = [dictionary_frame(learned), info]
        held, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                page_id, url, html, sha1, revisit, response_id = row
                held.append(pack(page_record(page_id, url, html.encode("utf-8", "replace"), base64.b32encode(sha1).decode(), revisit, response_id)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(head + held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(head + held)], pa.binary())], ["archive"])

    made = with_responses(pages).mapInArrow(archives, "archive binary")
    writer = made.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    writer.option("lineSep", EMPTY_FRAME).option("compression", "none").text(folder)


def frame_end(data, at):
    """Where the frame at ``at`` ends, by its block headers; beyond the data if it is cut off."""
    try:
        about = zstandard.get_frame_parameters(data[at : at + 18])
        at += zstandard.frame_header_size(data[at : at + 18])
    except zstandard.ZstdError:
        return len(data) + 1
    last = False
    while not last:
        if at + 3 > len(data):
            return len(data) + 1
        header = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = header & 1, header >> 1 & 3, header >> 3
        at += 3 + (1 if kind == 1 else size)  # a run of one byte holds that byte
    return at + 4 * about.has_checksum


def frames(data):
    """(offset, decoded frame or None, error or None) of each frame that is not skippable, and of what is no frame."""
    data, at = memoryview(data), 0
    unpack = zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & SKIPPABLE_MASK == SKIPPABLE and at + 8 <= len(data):
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if end > len(data):
                yield at, None, "skippable frame is cut off"
            elif magic == DICTIONARY_MAGIC and at == 0:
                raw = bytes(data[8:end])
                try:
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw) if raw[:4] == struct.pack("<I", FRAME) else raw
                    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                except zstandard.ZstdError as e:
                    yield at, None, f"dictionary: {e}"
            at = end
        elif magic == FRAME:
            end = frame_end(data, at)
            if end > len(data):
                yield at, None, "frame is cut off"
            else:
                try:
                    yield at, unpack.decompressobj().decompress(data[at:end]), None
                except zstandard.ZstdError as e:
                    yield at, None, f"frame: {e}"
            at = end
        else:
            yield at, None, "no frame starts here"
            return


def parsed(data):
    """A record's columns after the offset, in order, and its payload."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    headers, wrong = {}, [] if gap else ["no end of headers"]
    if version not in VERSIONS:
        wrong.append("unknown version")
    for line in re.sub(rb"\r\n[ \t]+", b" ", b"\r\n".join(lines)).split(b"\r\n") if lines else []:
        name, colon, value = line.partition(b":")
        key = name.decode("ascii", "replace").lower()
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            wrong.append("header without a name")
        elif key in headers and key in MANDATORY:
            wrong.append(f"repeated header {key}")
        else:
            headers.setdefault(key, value.strip(b" \t").decode("utf-8", "replace"))
    wrong += [f"no header {k}" for k in MANDATORY if k not in headers]
    kind, length = headers.get("warc-type"), headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        wrong.append("length is no number")
        block = rest[:-4]
    else:
        block = rest[: int(length)]
        if len(rest) != int(length) + 4 or rest[int(length) :] != b"\r\n\r\n":
            wrong.append("length differs from the block")
    if not re.fullmatch(r"<[^<>\s]+>", headers.get("warc-record-id", "<x>")):
        wrong.append("record id is no URI")
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z", headers.get("warc-date", DATE)):
        wrong.append("date is no time stamp")
    if kind in ("response", "revisit", "resource") and "warc-target-uri" not in headers:
        wrong.append("no target")
    if kind == "revisit" and "warc-profile" not in headers:
        wrong.append("revisit without a profile")
    is_http = headers.get("content-type", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if is_http else block
    said, own = headers.get("warc-payload-digest"), None
    if kind == "revisit":
        payload, own = None, said.partition(":")[2] if said else None
    else:
        own = digest(payload)
        if said and said.startswith("sha1:") and said != f"sha1:{own}":
            wrong.append("payload digest differs")
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said != f"sha1:{digest(block)}":
        wrong.append("block digest differs")
    page = headers.get("x-page-id", "")
    page = int(page) if re.fullmatch("-?[0-9]{1,19}", page) and -(1 << 63) <= int(page) < 1 << 63 else None
    size = None if payload is None else len(payload)
    return ["; ".join(wrong) or None, kind, headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-date"), size, own, headers.get("warc-refers-to"), page], payload


def read_archives(spark, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record, in the columns of ``RECORDS`` (and ``payload``, if asked for), of all archives below a path.

    A revisit has its own digest and no payload. Archives are read whole, each in a task."""

    def rows(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                held, size = [], 0
                for at, frame, error in frames(data.as_buffer()):
                    columns, payload = ([error, *[None] * 8], None) if frame is None else parsed(frame)
                    held.append((name, at, *columns, *[payload] * payloads))
                    size += 500 + payloads * len(payload or b"")
                    if size >= 4 << 20:
                        yield arrow(held)
                        held, size = [], 0
                if held:
                    yield arrow(held)

    kind = RECORDS + ", payload binary" * payloads
    names, types = zip(*[x.split() for x in kind.split(", ")])
    arrow = lambda held: pa.RecordBatch.from_arrays([pa.array(x, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for x, t in zip(zip(*held), types)], list(names))
    return session(spark).read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, kind)


def resolved(records: DataFrame) -> DataFrame:
    """Responses and revisits of a written table of records; a revisit takes the size of the payload and the page from the response that it names.

    ``error`` also tells of a revisit whose response is missing or has another digest."""
    wanted = records.filter("refers_to is not null").select(F.col("refers_to").alias("target")).distinct()
    own = records.filter("record_type = 'response'")
    first = own.join(wanted, own.record_id == F.col("target"), "left_semi").groupBy(F.col("record_id").alias("target"))
    targets = written(first.agg(F.min(F.struct("payload_bytes", F.col("payload_digest").alias("digest"), "page_id")).alias("t")))
    found = records.filter("record_type in ('response', 'revisit') or error is not null").join(small(targets, MAX_BROADCAST), F.col("refers_to") == F.col("target"), "left")
    revisit = F.col("record_type") == "revisit"
    lost = F.when(revisit & ~F.col("t.digest").eqNullSafe(F.col("payload_digest")), F.lit("revisit of no such response"))
    size = F.when(revisit, F.col("t.payload_bytes")).otherwise(F.col("payload_bytes"))
    return found.select("archive", "offset", F.coalesce("error", lost).alias("error"), "page_id", size.alias("payload_bytes"), "payload_digest", "record_type", F.when(revisit, F.col("t.page_id")).alias("refers_to"))


def op11_warc_zstandard(spark, sf_dir):
    folder = f"{shared_folder(spark)}/airloom/{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    rows = resolved(written(read_archives(spark, folder)))
    damaged = F.raise_error(F.concat_ws(" ", "archive", F.col("offset").cast("string"), "error")).cast("boolean")
    rows = rows.filter(F.when(F.col("error").isNull(), F.lit(True)).otherwise(damaged))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
