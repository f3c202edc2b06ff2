"""Web archives: one gzip stream for a whole file becomes one gzip member for each record.

`write_archives` writes a WARC record for each page through Spark's text writer, which compresses a file
as one stream: right to read from its beginning, useless to seek in. `normalise` inflates each such file
once, in steps, finds the records by their lengths, and rewrites each as a member of its own, beside a
sidecar index of (offset, length). `read_archives` cuts the members out by that index.

Members and index entries are bytes, and Spark's text writer ends each row with a separator. The last
byte of a member is the top byte of its length modulo 2^32, which is zero below 16 MB; a longer record gets an
empty member behind it, which ends with a zero too. The top byte of an index entry is zero as well. So
the separator is a zero byte that stands for the last byte of each row, and files hold nothing else.
Spark commits them as it does any output: a lost executor leaves no half archive.

Of pages with equal payloads (by SHA-256, of at least `least` bytes) the one with the largest id is a
response, the others are revisits of it and hold no payload.

Edge cases: a null payload is empty; a null or repeated id is written as it is: rows with the largest
id of a payload are all responses, a null id is smaller than any other; a null url has no header line, white
space and control characters in one become %20; a long payload is one record, held whole by one task; other
columns are not read; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import folder, stored

DATE = "2000-01-01T00:00:00Z"
ARCHIVE_BYTES = 64 << 20  # records of one archive before compression, about
STEP = 1 << 20  # compressed bytes that are inflated at once
BATCH_BYTES = 8 << 20
LEVEL = 6
EMPTY_MEMBER = zlib.compressobj(LEVEL, zlib.DEFLATED, 31).flush()
ENTRY = "<QQ"  # offset and length of a member
# Names of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
RECORD_ID = "urn:page:"


class BrokenArchive(ValueError):
    """A file that is no gzip stream, or whose records do not follow their lengths."""


# --- writing ---


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1: each five bytes are eight digits to the base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.translate(F.concat(*parts), *alphabet)


def _pages(df: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(df[payload_col].cast("string"), F.lit(""))
    return df.select(
        df[id_col].cast("long").alias("page_id"),
        df[url_col].cast("string").alias("url"),
        payload.alias("payload"),
        F.unhex(F.sha2(payload.cast("binary"), 256)).alias("same"),
    )


def _record(date: str) -> Column:
    """A record as text, without the line break behind it. A revisit has the HTTP head of its page alone."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    named = lambda number: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit("\r\n\r\n"),
    )
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", named(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload").cast("binary")))),
        F.when(
            revisit,
            F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", named(F.col("refers_to")))),
        ).otherwise(""),
        line("Content-Type", F.lit(HTTP_TYPE)),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n"),
    )


def write_archives(
    df: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = 0,
    date: str = DATE,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write the records of all pages to gzip files at `path`, each file one stream.

    Copies are found on (digest, id) alone; only the digests that more than one page has meet the pages
    again, so no payload is shuffled where these are few enough for Spark to broadcast.
    """
    pages = _pages(df, id_col, url_col, payload_col)
    size = F.octet_length("payload")
    by_payload = pages.groupBy("same").agg(F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("rows"), F.max(size).alias("size"))
    copies = by_payload.where((F.col("rows") > 1) & (F.col("size") >= least))
    copied = stored(copies.select("same", "last_id"), "copied-payloads")  # its size on disk decides how it is joined
    rows, total = pages.agg(F.count(F.lit(1)), F.sum(size)).first()
    each = (total or 0) / max(rows, 1) + 512  # heads are about so long
    joined = pages.join(copied, "same", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("last_id")), F.col("last_id"))
    )
    joined.select(_record(date).alias("value")).write.options(
        compression="gzip", lineSep="\r\n", maxRecordsPerFile=max(1, int(archive_bytes / each))
    ).text(path)


# --- the normaliser ---


def inflated(content, name: str = "", step: int = STEP) -> Iterator[bytes]:
    """The bytes of a gzip file in parts, inflated once. It may have several members and zeros behind them."""
    raw, place, stream = memoryview(content), 0, None
    while place < len(raw) or stream:
        if stream is None:
            if not any(raw[place : place + step]):
                place += step
                continue
            stream = zlib.decompressobj(31)
        part = raw[place : place + step]
        if not part:
            raise BrokenArchive(f"{name} ends inside a gzip stream")
        try:
            yield stream.decompress(part)
        except zlib.error as error:
            raise BrokenArchive(f"{name} is no gzip file: {error}") from error
        place += len(part) - len(stream.unused_data)
        if stream.eof:
            stream = None
            while place < len(raw) and not raw[place]:  # padding between members
                place += 1


def _length(head: bytes, name: str) -> int:
    fields = fields_of(head)
    if not head.startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
        raise BrokenArchive(f"{name} has a record without version or length: {head[:80]!r}")
    return int(fields["content-length"])


def fields_of(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the first line, of another form, is left out."""
    found = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return found


def records_of(parts: Iterable[bytes], name: str = "") -> Iterator[bytes]:
    """Whole records, with the two line breaks that end each, from a stream of bytes."""
    held, wanted, searched = bytearray(), 0, 0
    for part in parts:
        held += part
        while True:
            if not wanted:
                end = held.find(b"\r\n\r\n", searched)
                if end < 0:
                    searched = max(0, len(held) - 3)
                    break
                wanted = end + 4 + _length(bytes(held[:end]), name) + 4
            if len(held) < wanted:
                break
            if held[wanted - 4 : wanted] != b"\r\n\r\n":
                raise BrokenArchive(f"{name} has a record of another length than it says")
            yield bytes(held[:wanted])
            del held[:wanted]
            wanted = searched = 0
    if held:
        raise BrokenArchive(f"{name} ends inside a record")


def member_of(record: bytes, level: int = LEVEL) -> bytes:
    """A record as a gzip member; its last byte is zero."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    member = packer.compress(record) + packer.flush()
    return member if not member[-1] else member + EMPTY_MEMBER


def normalise(spark: SparkSession, source: str, target: str, level: int = LEVEL) -> None:
    """Rewrite every gzip file below `source`: `target`/kind=records/archive=<name> holds its records as
    members, kind=index/archive=<name> 16 bytes for each: offset and length, little-endian.

    A file is inflated by one task, which needs room for it compressed and for its largest record.
    """
    base = F.regexp_extract("path", r"([^/]*?)(?:\.(?:txt|warc))?\.gz$", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(source)
    named = files.select(F.concat_ws("-", base, F.substring(F.md5("path"), 1, 8)).alias("archive"), "content")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held, offset = [], 0, 0
                parts = inflated(content.as_buffer(), archive)
                for place, record in enumerate(records_of(parts, archive)):
                    member = member_of(record, level)
                    rows.append(("records", archive, place, member[:-1]))
                    rows.append(("index", archive, place, struct.pack(ENTRY, offset, len(member))[:-1]))
                    offset += len(member)
                    held += len(member)
                    if held > BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    rows = named.mapInArrow(rewrite, "kind string, archive string, place long, value binary")
    # bytes that are cast to a string stay as they are; the separator is the last byte of each row
    ordered = rows.sortWithinPartitions("kind", "archive", "place")
    ordered.select("kind", "archive", F.col("value").cast("string")).write.partitionBy("kind", "archive").options(
        lineSep="\0", compression="none", maxRecordsPerFile=0
    ).text(target)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.string(), pa.string(), pa.int64(), pa.binary()
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["kind", "archive", "place", "value"])


# --- reading ---

FIELDS = "archive string, place long, offset long, length long, record_type string, record_id string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def parsed(record: bytes, name: str = "") -> tuple:
    """(type, id, url, id it refers to, digest, full size of the payload, payload) of a record.

    The payload is None for a revisit, whose HTTP head still says its size. A response whose payload has
    another digest than the record says is an error.
    """
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = fields_of(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = fields.get("warc-type") == "revisit"
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise BrokenArchive(f"{name}: the payload of {fields.get('warc-record-id')} has another digest")
    size = int(fields_of(http).get("content-length", 0)) if revisit else len(payload)
    bare = lambda key: fields[key].strip("<>") if key in fields else None
    return (
        fields.get("warc-type"),
        bare("warc-record-id"),
        fields.get("warc-target-uri"),
        bare("warc-refers-to"),
        digest,
        size,
        None if revisit else payload,
    )


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _content(spark: SparkSession, path: str, kind: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(f"{path}/kind={kind}")
    return files.select(F.col("archive").cast("string"), F.col("content").alias(kind))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record that the indexes of `normalise` list, cut out of its archive by offset and length.

    Without `payloads` the last column is null: digests are checked in the task, bytes stay there.
    """
    if not _exists(spark, f"{path}/kind=index"):
        return spark.createDataFrame([], FIELDS)
    both = _content(spark, path, "records").join(_content(spark, path, "index"), "archive")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, records, index in zip(*(batch.column(i) for i in range(3)), strict=True):
                name, raw = archive.as_py(), memoryview(records.as_buffer())
                rows, held = [], 0
                for place, (offset, length) in enumerate(struct.iter_unpack(ENTRY, index.as_buffer())):
                    record = b"".join(inflated(raw[offset : offset + length], name))
                    row = parsed(record, name)
                    rows.append((name, place, offset, length, *(row if payloads else (*row[:-1], None))))
                    held += len(record)
                    if held > BATCH_BYTES or len(rows) >= 4096:
                        yield _found(rows)
                        rows, held = [], 0
                if rows:
                    yield _found(rows)

    return both.select("archive", "records", "index").mapInArrow(cut, FIELDS)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 3, *[pa.string()] * 5, pa.int64(), pa.binary()]
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in FIELDS.split(", ")])


def archive_round_trip(df: DataFrame, **settings) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page: written to archives in
    new shared folders, normalised, and read back from what was written."""
    spark = df.sparkSession
    raw, path = folder(spark, "warc-streams"), folder(spark, "warc")
    write_archives(df, raw, **settings)
    normalise(spark, raw, path)
    number = lambda name: F.expr(f"try_cast(replace({name}, '{RECORD_ID}', '') as bigint)")
    return read_archives(spark, path, payloads=False).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )
