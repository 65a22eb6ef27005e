"""ZIP-packaged web archives: directories and ranges against made-up archives, records against their pages."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib

import duckdb
import pytest

from tidemark.llm import warc, zipfiles
from tidemark.llm.queries import WARC_SQL, op11


def reader(data: bytes):
    def read(offset: int, length: int) -> bytes:
        read.asked.append((offset, length))
        return data[offset : offset + length]

    read.asked = []
    return read


def zip64(members: list[tuple[str, bytes]], sentinels: bool = True, comment: bytes = b"", local_extra: bytes = b"") -> bytes:
    """An archive whose sizes, offsets and number of entries stand in ZIP64 fields only."""
    out, entries = b"", b""
    for name, data in members:
        n, crc, at = name.encode(), zlib.crc32(data), len(out)
        out += b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(n), 20 + len(local_extra)) + n
        out += struct.pack("<HHQQ", 1, 16, len(data), len(data)) + local_extra + data
        extra = struct.pack("<HH2s", 0x7875, 2, b"??") + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        entries += b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(extra), 1, 0, 0, 0, 0xFFFFFFFF) + n + extra + b"c"
    begin = len(out)
    end = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(members), len(members), len(entries), begin)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, begin + len(entries), 1)
    few = (0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF) if sentinels else (len(members), len(members), len(entries), begin)
    return out + entries + end + locator + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, *few, len(comment)) + comment


MEMBERS = [("archive/data.warc.gz", b"x" * 1000), ("indexes/é.cdxj", b"line\n"), ("empty", b"")]


@pytest.mark.parametrize("front", [b"", b"#!/bin/sh\n" * 9])
@pytest.mark.parametrize("comment", [b"", b"\n", b"PK\x05\x06 in a comment" + b"z" * 300])
@pytest.mark.parametrize("sentinels", [True, False])
def test_zip64_directories(front, comment, sentinels):
    data = front + zip64(MEMBERS, sentinels, comment, struct.pack("<HH3s", 9, 3, b"abc"))
    read = reader(data)
    found = zipfiles.members(read, len(data))
    assert [(m.name, m.size) for m in found] == [(n, len(d)) for n, d in MEMBERS]
    assert [zipfiles.content(read, m) for m in found] == [d for _, d in MEMBERS]


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_archives_of_another_writer(method):
    out = io.BytesIO()
    out.write(b"before")
    with zipfile.ZipFile(out, "a", method) as z:
        for n, d in MEMBERS:
            z.writestr(n, d)
        with z.open("streamed", "w", force_zip64=True) as f:
            f.write(b"abc" * 50)
        for i in range(70_000 if method == zipfile.ZIP_STORED else 0):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
    data = out.getvalue()
    read = reader(data)
    found = zipfiles.members(read, len(data))
    assert len(found) == (70_004 if method == zipfile.ZIP_STORED else 4)
    assert [zipfiles.content(read, m) for m in found[:4]] == [d for _, d in MEMBERS] + [b"abc" * 50]


def test_broken_archives():
    good = zip64(MEMBERS)
    for bad in (b"", b"PK", good[:-5], good[100:], good.replace(b"PK\x01\x02", b"PK\x01\x03"), b"\0" * 100):
        with pytest.raises(ValueError):
            read = reader(bad)
            [zipfiles.content(read, m) for m in zipfiles.members(read, len(bad))]
    damaged = good.replace(b"x" * 1000, b"x" * 999 + b"y")
    with pytest.raises(ValueError, match="damaged"):
        zipfiles.content(reader(damaged), zipfiles.members(reader(damaged), len(damaged))[0])
    with pytest.raises(ValueError, match="beyond"):
        list(zipfiles.ranges(reader(b"abc"), [(1, 5)]))


def test_ranges_are_read_together():
    read = reader(bytes(range(200)))
    assert list(zipfiles.ranges(read, [(0, 10), (10, 5), (20, 5), (25, 50), (75, 0)], most=40)) == [bytes(range(a, b)) for a, b in ((0, 10), (10, 15), (20, 25), (25, 75), (75, 75))]
    assert read.asked == [(0, 15), (20, 5), (25, 50), (75, 0)]


SCHEMA = "page_id long, url string, html string"
#: Null, empty, repeated and long payloads, ties, urls with line feeds, ids that are null.
PAGES = [
    (5, "https://a.example/x y\r\nWARC-Type: warcinfo", "<p>same</p>"),
    (3, "https://a.example/1", "<p>same</p>"),
    (3, "https://a.example/2", "<p>same</p>"),
    (None, "https://a.example/3", "<p>same</p>"),
    (9, None, None),
    (8, "", ""),
    (None, "u", "only without id"),
    (None, "v", "only without id"),
    (4, "https://é.example/", "é 東京 \U0001f600\r\n\r\n WARC/1.1 \x00"),
    (7, "long", "long " * 400_000),
    (7, "other", "the same id, another payload"),
]


def plain(rows: list[tuple]) -> list[tuple]:
    heads: dict[str, int] = {}
    for i, _, html in rows:
        if i is not None:
            heads[html or ""] = min(heads.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        payload, head = (html or "").encode(), heads.get(html or "")
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((i, len(payload), own, "response" if i == head else "revisit", None if i == head else head))
    return sorted(out, key=repr)


def digest_rows(spark, path, **options):
    read = warc.records(spark, path, **options).where("record_type <> 'warcinfo'")
    read = read.selectExpr(f"{warc.page_id('record_id')} a", "payload_bytes b", "payload_digest c", "record_type d", f"{warc.page_id('refers_to')} e", "payload", "intact")
    return read.collect()


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("archive_bytes", [1, 300, 1 << 24])
def test_odd_pages_come_back(spark, whole, archive_bytes):
    clash = ", ".join(f"7 AS `{n}`" for n in ("id", "digest", "head", "value", "n", "payload"))
    path = warc.write(spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", *clash.split(", ")).repartition(3), archive_bytes=archive_bytes)
    got = digest_rows(spark, path, whole=whole)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain(PAGES)
    bodies = {hashlib.sha1((h or "").encode()).digest() for _, _, h in PAGES}
    kept = [bytes(r.payload) for r in got if r.d == "response"]
    assert {hashlib.sha1(b).digest() for b in kept} == bodies
    assert all(r.intact for r in got if r.d == "response")
    assert warc.records(spark, path, payload=False, whole=whole).where("payload IS NOT NULL").count() == 0


def test_packages_are_plain_zip_files(spark):
    path = warc.write(spark.createDataFrame(PAGES, SCHEMA).coalesce(1))
    files = [r.content for r in spark.read.format("binaryFile").load(path).where("length > 0").collect()]
    with zipfile.ZipFile(io.BytesIO(bytes(files[0]))) as z:
        assert z.namelist() == [warc.DATA, warc.INDEX] and z.testzip() is None
        records = gzip.decompress(z.read(warc.DATA))
        lines = z.read(warc.INDEX).decode().splitlines()
        entry = json.loads(lines[0][lines[0].index("{") :])
        one = gzip.decompress(z.read(warc.DATA)[entry["offset"] : entry["offset"] + entry["length"]])
    assert records.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and one.startswith(b"WARC/1.1\r\nWARC-Type: revisit")
    assert len(lines) == len(PAGES)


def test_one_record_is_read_by_its_range(spark):
    path = warc.write(spark.createDataFrame(PAGES, SCHEMA).coalesce(1))
    located = warc.locate(spark, path)
    assert located.count() == len(PAGES)
    got = warc.fetch(located.where("record_id = '<urn:x-page:4>'")).collect()
    assert [bytes(r.payload).decode() for r in got] == [PAGES[8][2]]


def test_index_must_point_into_stored_members():
    line = json.dumps({"filename": "data.warc.gz", "offset": 990, "length": 11})
    data = zip64([MEMBERS[0], ("indexes/index.cdxj", f"k d {line}\n".encode())])
    with pytest.raises(ValueError, match="beyond"):
        warc._index(reader(data), len(data))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", b"x" * 2000)
        z.writestr("indexes/index.cdx.gz", gzip.compress(f"k d {line}\n".encode()))
    with pytest.raises(ValueError, match="stored"):
        warc._index(reader(out.getvalue()), len(out.getvalue()))


def test_empty_table(spark):
    path = warc.write(spark.createDataFrame([], SCHEMA))
    assert warc.records(spark, path).collect() == []


def test_query_equals_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(WARC_SQL)
    names = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in op11(spark, sf).select(*names).collect()) == sorted(want.fetchall())
