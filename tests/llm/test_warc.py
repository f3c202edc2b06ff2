"""Web archives: a plain reader of the format, copies, index entries, broken files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import random
import struct
import zlib
from pathlib import Path

import pytest

from marketspark.llm import warc
from marketspark.llm.common import folder

PAGES = "page_id bigint, url string, html string"


def plain(path: str) -> Path:
    return Path(path.removeprefix("file:"))


def files_of(path: str, kind: str) -> dict[str, bytes]:
    """Content by archive."""
    found = plain(path).glob(f"kind={kind}/archive=*/part-*")
    return {f.parent.name: f.read_bytes() for f in found}


def record(number: int, payload: bytes) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n%s" % (len(payload), payload)
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d"
    return head % (number, digest, len(block)) + b"\r\n\r\n" + block + b"\r\n\r\n"


def slow(pages):
    """The rows of the query, from the definitions."""
    of = {}
    for number, _, html in pages:
        known = of.setdefault(html or "", number)
        if number is not None and (known is None or number > known):
            of[html or ""] = number
    out = []
    for number, _, html in pages:
        raw, last = (html or "").encode(), of[html or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        same = number == last
        out.append((number, len(raw), digest, "response" if same else "revisit", None if same else last))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


CASES = [
    (1, "http://a.example/x y", "<p>same</p>"),
    (2, None, "<p>same</p>"),
    (7, "http://b.example/\r\nWARC-Type: metadata", "<p>same</p>"),
    (7, "http://b.example/", "<p>same</p>"),
    (None, "http://c.example/", "<p>same</p>"),
    (None, "http://c.example/", "only without id"),
    (3, "", None),
    (4, "u", ""),
    (5, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n\r\n\r\n\x00\x1f日本 😀"),
    (6, "u", "long " * 400_000),
    (-8, "u", "negative"),
]


def test_round_trip(spark):
    extra = spark.createDataFrame([(*c, "x", 1, "y") for c in CASES], f"{PAGES}, payload string, archive int, same string")
    got = warc.archive_round_trip(extra.repartition(3)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(slow(CASES), key=key)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_pages(spark, seed):
    dice = random.Random(seed)
    pages = [(i, f"u{i}", dice.choice(["", "a", "b"]) * dice.randint(0, 3)) for i in range(300)]
    frame = spark.createDataFrame(pages, PAGES).repartition(4)
    assert sorted(map(tuple, warc.archive_round_trip(frame).collect()), key=key) == sorted(slow(pages), key=key)


def test_short_payloads_are_written_again(spark):
    frame = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES)
    got = {r["page_id"]: r["refers_to"] for r in warc.archive_round_trip(frame, least=4).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_files(spark):
    """Streams go in, one member for each record comes out; other readers get the same bytes."""
    raw, path = folder(spark, "test-streams"), folder(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(CASES, PAGES).repartition(2), raw, archive_bytes=400_000)
    streams = [f.read_bytes() for f in plain(raw).glob("part-*.gz")]
    assert len(streams) > 2
    for stream in streams:
        one = zlib.decompressobj(31)
        one.decompress(stream)
        assert one.eof and not one.unused_data
    warc.normalise(spark, raw, path)
    records, index = files_of(path, "records"), files_of(path, "index")
    whole = [gzip.decompress(s) for s in streams]
    assert sorted(map(gzip.decompress, records.values())) == sorted(w for w in whole if w)
    assert records.keys() == index.keys()
    for archive, content in records.items():
        end = 0
        for offset, length in struct.iter_unpack("<QQ", index[archive]):
            one = zlib.decompressobj(31)
            text = one.decompress(content[offset : offset + length])
            assert offset == end and one.eof and not one.unused_data
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
            end = offset + length
        assert end == len(content)
    rows = warc.read_archives(spark, path).collect()
    full = {r["record_id"]: bytes(r["payload"]).decode() for r in rows if r["record_type"] == "response"}
    assert full["urn:page:6"] == "long " * 400_000 and full["urn:page:7"] == "<p>same</p>"
    urls = {r["record_id"]: r["url"] for r in rows}
    assert urls["urn:page:1"] == "http://a.example/x%20y" and urls["urn:page:2"] is None


def test_archives_of_others(spark):
    """Several members in a file, padding, a record of more than 16 MB, files of one name in two folders."""
    base = plain(folder(spark, "test-others"))
    huge = os.urandom(1 << 20) * 17
    for place, payloads in {"x": [b"1", b"2" * 5000, huge], "y": [b"", b"3"]}.items():
        (base / place).mkdir(parents=True)
        both = [record(i, p) for i, p in enumerate(payloads)]
        stream = gzip.compress(both[0] + both[1][:50]) + b"\0" * 9 + gzip.compress(both[1][50:] + b"".join(both[2:]))
        (base / place / "crawl.warc.gz").write_bytes(stream + b"\0" * 600)
    path = folder(spark, "test-warc")
    warc.normalise(spark, f"file:{base}", path)
    rows = warc.read_archives(spark, path).orderBy("archive", "place").collect()
    assert sorted((r["place"], r["payload_bytes"]) for r in rows) == [(0, 0), (0, 1), (1, 1), (1, 5000), (2, len(huge))]
    assert bytes(max(rows, key=lambda r: r["payload_bytes"])["payload"]) == huge
    assert len({r["archive"] for r in rows}) == 2 and all(r["archive"].startswith("crawl-") for r in rows)
    for content in files_of(path, "records").values():
        gzip.decompress(content)


def test_broken_files():
    good = gzip.compress(record(1, b"abc"))
    read = lambda raw, step=1 << 20: list(warc.records_of(warc.inflated(raw, "f", step), "f"))
    assert [warc.parsed(r)[-1] for r in read(good)] == [b"abc"]
    assert read(good, 3) == read(good)
    assert read(b"") == []
    longer = gzip.compress(record(1, b"abc").replace(b"3\r\n\r\nabc", b"3\r\n\r\nabcd"))
    for broken in (good[:-9], b"plain text", gzip.compress(record(1, b"abc")[:-5]), gzip.compress(b"WARC/1.1\r\n\r\n"), longer):
        with pytest.raises(warc.BrokenArchive):
            read(broken)
    with pytest.raises(warc.BrokenArchive):
        warc.parsed(record(1, b"abc").replace(b"abc", b"abd"))


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).collect() == []
