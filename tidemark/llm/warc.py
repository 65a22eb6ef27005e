"""Web archives in ZIP packages: WARC records written by tasks, located by directories and index, read by ranges.

*Writing.* Every record is a gzip member of its own. A task joins them to one or
several packages of about ``ARCHIVE_BYTES``: a ZIP file with the stored members
``archive/data.warc.gz`` and ``indexes/index.cdxj`` (a line per record with its offset and length).
Spark's text writer writes each package as a file of its own, with its commit
protocol, so a lost executor's half-written files never count; the line feed it
appends is the ZIP comment.

*Revisits.* Of equal payloads one is kept: payloads are told apart by SHA-1, the smallest
id of a digest is found by an aggregate, and only the rows that are not it are joined
to their pages, by id and digest, so many copies of a page are many keys.

*Reading.* A package's end, its central directory (ZIP64 too), the 30 bytes before the
members wanted and the index are read; records then are ranges of the stored WARC member.
Nothing is extracted. A store that pyarrow opens is read by ranges from the tasks; for any other,
Spark delivers the package's bytes and the ranges are cut from them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import zipfiles
from tidemark.llm.textbits import binary, map_batches
from tidemark.session import materialize, scratch_path

ARCHIVE_BYTES = 16 << 20
#: Date of all records, as pages carry none.
DATE = "1970-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "archive string, offset long, length long, record_id string, record_type string, refers_to string, url string, "
    "payload_digest string, payload_bytes long, intact boolean, payload binary"
)
LOCATED = "archive string, offset long, length long, record_id string, record_type string, url string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """Response record of a page, or its revisit where ``refers_to`` names the record with the payload."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    headers = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", name_of(page_id)), ("WARC-Date", DATE)]
    headers += [("WARC-Target-URI", uri)] if uri else []
    headers += [("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    headers += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)] if refers_to else []
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record([*headers, ("Content-Type", "application/http; msgtype=response")], http if refers_to else http + payload)


def package(records: list[bytes], lines: list[str]) -> bytes:
    """A ZIP package of WARC records and their index; its comment is a line feed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        archive.writestr(zipfile.ZipInfo(DATA), b"".join(records))
        archive.writestr(zipfile.ZipInfo(INDEX), "".join(lines).encode())
        archive.comment = b"\n"
    return out.getvalue()


def revisits(pages: DataFrame) -> DataFrame:
    """Rows (id, digest, head) of a table (id, html): those whose payload stands under a smaller id.

    The head of a digest that a great part of the rows share meets them in a
    sort-merge join, which Spark cuts where it is skewed; only ids and digests move.
    """
    slim = pages.select("id", F.unhex(F.sha1("html")).alias("digest"))
    heads = slim.groupBy("digest").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1 AND head IS NOT NULL")
    later = slim.join(heads.select("digest", "head"), "digest").where("id IS NULL OR id > head")
    return later.groupBy("id", "digest").agg(F.min("head").alias("head"))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write a WARC record per row of ``pages`` to ZIP packages in the shared folder; returns their folder.

    Of rows with equal payloads those with the smallest id are responses and the
    others revisit them. Rows that repeat the smallest id with the same payload are responses all; a row
    without id is a revisit unless all of its payload have none. Null html
    is an empty payload, a null or empty url is left out, blanks and control characters in
    urls are percent-encoded. Payloads of any length are whole. An empty table gives no package.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"))
    fates = materialize(revisits(base.select("id", "html")), "revisits")
    rows = base.withColumn("digest", F.unhex(F.sha1("html"))).alias("x").join(
        fates.alias("y"), F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.digest") == F.col("y.digest")), "left"
    )
    rows = rows.select("x.id", "x.url", "x.html", F.col("y.head").cast("string").alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = record(
            [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x-info:0>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")],
            b"software: tidemark\r\nformat: WARC File Format 1.1\r\n",
        )
        parts, lines, size = [info], [], len(info)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([package(parts, lines)[:-1]], pa.large_binary()).cast(pa.binary())], ["value"])

        for batch in batches:
            ids, urls, heads = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for i, url, html, head in zip(ids, urls, binary(batch.column(2)), heads):
                refers = None if head is None else name_of(head)
                made = page_record(i, url, html, refers)
                about = {"url": url, "id": name_of(i), "type": "revisit" if refers else "response", "filename": "data.warc.gz", "offset": size, "length": len(made)}
                lines.append(f"{'' if i is None else i} {DATE} {json.dumps(about)}\n")
                parts.append(made)
                size += len(made)
                if size >= archive_bytes:
                    yield done()
                    parts, lines, size = [info], [], len(info)
        if lines:
            yield done()

    path = scratch_path(spark, "archives")
    packed = map_batches(rows, run, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, given as a gzip member or plainly."""
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record where the index says")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return headers, rest[: int(headers.get("content-length", 0))]


def _row(archive: str, offset: int, length: int, raw: bytes, payload: bool) -> tuple:
    headers, block = _parsed(raw)
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    body, size = block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        http, _, body = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?mi)^content-length:\s*(\d+)", http)
        size = int(told[1]) if told else len(body)
    if headers.get("warc-type") == "revisit":
        own, found, intact, body = stated, size, None, b""
    else:
        own, found = digest(body), len(body)
        intact = size == found and stated in (None, own)
    id_, kind, refers, uri = (headers.get(k) for k in ("warc-record-id", "warc-type", "warc-refers-to", "warc-target-uri"))
    return archive, offset, length, id_, kind, refers, uri, own, found, intact, body if payload else None


def _index(read: zipfiles.Read, size: int) -> list[tuple[int, int, dict]]:
    """(offset in the package, length, index entry) of all records that the package's indexes list, by offset."""
    found = zipfiles.members(read, size)
    data = {m.name.rsplit("/", 1)[-1]: m for m in found if m.name.startswith("archive/")}
    begin = {name: zipfiles.data_offset(read, m) for name, m in data.items()}
    out = []
    for m in found:
        if not m.name.startswith("indexes/"):
            continue
        raw = zipfiles.content(read, m)
        raw = gzip.decompress(raw) if m.name.endswith(".gz") else raw
        for line in raw.decode().splitlines():
            if "{" not in line or line.startswith("!"):
                continue
            entry = json.loads(line[line.index("{") :])
            inside = data.get(entry["filename"].rsplit("/", 1)[-1])
            if inside is None or inside.method != zipfiles.STORED:
                raise ValueError(f"{entry['filename']} is not a stored member")
            offset, length = int(entry["offset"]), int(entry["length"])
            if offset + length > inside.size:
                raise ValueError(f"index points beyond {inside.name}")
            out.append((begin[entry["filename"].rsplit("/", 1)[-1]] + offset, length, entry))
    return sorted(out, key=lambda x: x[:2])


def _ranged(path: str) -> bool:
    """Whether tasks can read ranges of the store themselves."""
    try:
        fs.FileSystem.from_uri(_uri(path))
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False
    return True


def _uri(path: str) -> str:
    return re.sub(r"^(?:file:)?/+", "file:///", path)


def _opened(path: str, data: bytes | None) -> zipfiles.Read:
    if data is not None:
        return lambda offset, length: data[offset : offset + length]
    store, name = fs.FileSystem.from_uri(_uri(path))
    file = store.open_input_file(name)
    return lambda offset, length: file.read_at(length, offset)


def _packages(spark: SparkSession, path: str, whole: bool | None) -> tuple[DataFrame, bool]:
    """Rows (path, length), with content where tasks can't read ranges."""
    whole = not _ranged(path) if whole is None else whole
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.select("path", "length", *["content"] * whole), whole


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``most`` bytes; a payload, if there is one, comes last."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


_RECORD_KINDS = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.bool_(), pa.binary()]
_LOCATED_KINDS = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3]


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _per_package(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, zipfiles.Read]]:
    for batch in batches:
        data = batch.column(2) if batch.num_columns > 2 else None
        for i, (path, length) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            yield path, length, _opened(path, None if data is None else data[i].as_py())


def locate(spark: SparkSession, path: str, whole: bool | None = None) -> DataFrame:
    """Rows (archive, offset, length, record_id, record_type, url) of every record that the packages in ``path`` index.

    ``offset`` is the record's place in its package. ``whole`` forces Spark to deliver whole packages or not.
    """
    files, _ = _packages(spark, path, whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, o, n, e.get("id"), e.get("type"), e.get("url")) for p, size, read in _per_package(batches) for o, n, e in _index(read, size))
        yield from _batched(rows, _names(LOCATED), _LOCATED_KINDS)

    return map_batches(files, run, LOCATED)


def fetch(located: DataFrame, payload: bool = True) -> DataFrame:
    """The records (``RECORD``) of the rows (archive, offset, length) of ``located``, each read as a range of its package.

    The store must be one that pyarrow opens. Rows of a package that follow each
    other are read with one open file, neighbouring ranges in one read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            path, read = None, None
            for batch in batches:
                archive, offset, length = (batch.column(i).to_pylist() for i in range(3))
                i = 0
                while i < len(archive):
                    j = i
                    while j < len(archive) and archive[j] == archive[i]:
                        j += 1
                    if archive[i] != path:
                        path, read = archive[i], _opened(archive[i], None)
                    for o, n, raw in zip(offset[i:j], length[i:j], zipfiles.ranges(read, list(zip(offset[i:j], length[i:j])))):
                        yield _row(path, o, n, raw, payload)
                    i = j

        yield from _batched(rows(), _names(RECORD), _RECORD_KINDS)

    return map_batches(located.select("archive", "offset", "length"), run, RECORD)


def records(spark: SparkSession, path: str, payload: bool = True, whole: bool | None = None) -> DataFrame:
    """All indexed records of the packages in ``path``: located by directories and index, read by ranges.

    ``payload_digest`` and ``payload_bytes`` of a revisit are those that it states, of other
    records those of the bytes read; ``intact`` says whether a record's bytes are what it states.
    """
    files, whole = _packages(spark, path, whole)
    if not whole:
        return fetch(locate(spark, path, whole), payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for path, size, read in _per_package(batches):
                found = _index(read, size)
                for (o, n, _), raw in zip(found, zipfiles.ranges(read, [x[:2] for x in found])):
                    yield _row(path, o, n, raw, payload)

        yield from _batched(rows(), _names(RECORD), _RECORD_KINDS)

    return map_batches(files, run, RECORD)


def page_id(name: str) -> str:
    """SQL for the page id in a record id."""
    return f"CAST(nullif(regexp_extract({name}, '^<urn:x-page:(.*)>$', 1), '') AS BIGINT)"
