"""WARC records in ZIP packages: a writer, and a reader that parses the central directory (ZIP64 too), locates stored
members and their index, and range-reads single records without extracting anything.

A package holds two stored members: ``archive/data.warc.gz``, one gzip member for each record, behind one that tells what wrote it,
and ``indexes/index.cdxj``, a line for each record, sorted by search key: key, time, and offset and length among others as JSON. Records are
those of WARC/1.1: a response has an HTTP message with the payload as its body; a revisit has the profile of equal payloads, no block, and the
identifier of the record that it refers to. What only this library needs stands in headers that begin with X-. Packages are written by tasks into the folder that all executors
share, under names no two attempts have in common; the table of packages lists those of the attempts that counted.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes, the one with the largest page_id holds the payload and the
others are revisits that refer to it.

Defined cases: a null html is an empty payload; payloads below the limit are always responses; rows repeated with one page_id
are all responses if it is the largest; a null page_id or url comes back null; an address that is no
absolute URI is written as one of an own scheme and comes back as it was; rows of a null
page_id are never referred to and are responses if no other row has their payload; rows of one page_id and payload share a record
identifier; a payload of any length is one record; columns
other than page_id, url and html are ignored; an empty table makes no packages.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, key_bitmap, maybe_among, release, shared_path, slices, stage

LEAST_REVISIT = 1000
#: Payload bytes after which a package is closed and the next one begun.
PACKAGE_BYTES = 16 << 20
#: Packages that one task reads, of many.
READ_TOGETHER = 8
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Signatures and sizes of the ZIP format
_END, _END64_AT, _END64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


class RangeFile:
    """Byte ranges of a file in any store that pyarrow reads."""

    def __init__(self, path: str) -> None:
        system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self._file = system.open_input_file(place)
        self.size = self._file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self._file.read_at(length, offset)

    def close(self) -> None:
        self._file.close()


class ZipDirectory:
    """The stored members of a ZIP file by name: (offset of the data, length)."""

    def __init__(self, file: RangeFile) -> None:
        self.file = file
        entries, size, at = self._end()
        self.members: dict[str, tuple[int, int, int, int]] = {}
        data, i = file.read(at, size), 0
        for _ in range(entries):
            if data[i : i + 4] != _ENTRY:
                raise ValueError("damaged central directory")
            (method,) = struct.unpack_from("<H", data, i + 10)
            (crc, packed, length) = struct.unpack_from("<III", data, i + 16)
            n, extra, note = struct.unpack_from("<HHH", data, i + 28)
            (local,) = struct.unpack_from("<I", data, i + 42)
            name = data[i + 46 : i + 46 + n].decode("utf-8")
            packed, length, local = self._wide(data[i + 46 + n : i + 46 + n + extra], packed, length, local)
            self.members[name] = (method, packed, local, crc)
            i += 46 + n + extra + note

    def _end(self) -> tuple[int, int, int]:
        """Entries, bytes and offset of the central directory."""
        tail_at = max(0, self.file.size - 22 - _FULL16)
        tail = self.file.read(tail_at, self.file.size - tail_at)
        at = tail.rfind(_END)
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(_END, 0, at)
        if at < 0:
            raise ValueError("not a ZIP file")
        entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
        where = tail_at + at - 20
        if where >= 0 and (locator := self.file.read(where, 20))[:4] == _END64_AT:
            (place,) = struct.unpack_from("<Q", locator, 8)
            wide = self.file.read(place, 56)
            if wide[:4] != _END64:
                raise ValueError("damaged ZIP64 directory")
            entries, size, offset = struct.unpack_from("<QQQ", wide, 32)
        return entries, size, offset

    @staticmethod
    def _wide(extra: bytes, packed: int, length: int, local: int) -> tuple[int, int, int]:
        """The ZIP64 field has, in this order, those values that are full in the entry."""
        i = 0
        while i + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, i)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, i + 4))
                length = next(values) if length == _FULL32 else length
                packed = next(values) if packed == _FULL32 else packed
                local = next(values) if local == _FULL32 else local
            i += 4 + n
        return packed, length, local

    def stored(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        method, packed, local, _ = self.members[name]
        if method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is not stored")
        head = self.file.read(local, 30)
        if head[:4] != _LOCAL:
            raise ValueError("damaged local header")
        n, extra = struct.unpack_from("<HH", head, 26)
        return local + 30 + n + extra, packed

    def records(self, member: str = MEMBER, index: str = INDEX) -> Iterator[bytes]:
        """The uncompressed bytes of every record that the index lists, each by a range read."""
        offset, length = self.stored(member)
        at, n = self.stored(index)
        for line in self.file.read(at, n).splitlines():
            where = json.loads(line.split(b" ", 2)[2])
            begin, size = int(where["offset"]), int(where["length"])
            if begin + size > length:
                raise ValueError("the index points outside its member")
            yield zlib.decompress(self.file.read(offset + begin, size), 31)


#: Fixed values of the formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:[^\s]")
_RESERVED = "!#$%&'()*+,/:;=?@[]~"


def record_id(page_id: int | None, digest: str) -> str:
    """The identifier of a page's record; of one without page_id one that nothing refers to."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, str((page_id, digest)))}>"


def target_uri(url: str | None) -> str:
    """An absolute URI for any address, in ASCII without blanks."""
    quoted = quote(url or "", safe=_RESERVED)
    return quoted if url and _ABSOLUTE.match(url) else f"x-address:{quoted or 'none'}"


def search_key(uri: str) -> str:
    """The key by which an index is sorted: the host's parts in reverse, then the path; other URIs as they are."""
    try:
        parts = urlsplit(uri)
        host, port = parts.hostname, parts.port
    except ValueError:
        return uri
    if parts.scheme not in ("http", "https") or not host:
        return uri
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){rest}".lower()


def labelled(digest: str) -> str:
    """A hexadecimal SHA-1 as archives write it."""
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """The record of a page: a response with its payload, or a revisit of the page ``refers_to``, without."""
    headers = [("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", target_uri(url)), ("WARC-Payload-Digest", labelled(digest)), ("X-Payload-Length", str(length))]
    headers += [("X-Page-ID", str(page_id))] * (page_id is not None)
    headers += [("X-Address", json.dumps(url))] * (url is not None and url != target_uri(url))
    headers += [("X-No-Address", "true")] * (url is None)
    if refers_to is None:
        return warc_record("response", [*headers, ("Content-Type", "application/http; msgtype=response")], _HTTP.format(len(payload)).encode() + payload)
    return warc_record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))], b"")


def page_of(record: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes | None]:
    """page_id, url, payload's length and digest, type, page referred to and payload (None: a revisit) of a page's record."""
    kind, headers, block = parse_warc(record)
    digest, length = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), int(headers["X-Payload-Length"])
    url = None if "X-No-Address" in headers else json.loads(headers["X-Address"]) if "X-Address" in headers else headers["WARC-Target-URI"]
    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("damaged record")
    return int(page) if page else None, url, length, digest, kind, int(refers) if refers else None, payload


def parse_warc(record: bytes) -> tuple[str, dict[str, str], bytes]:
    """Type, headers and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    length = int(headers["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return headers.pop("WARC-Type"), headers, rest[:length]


class Package:
    """One ZIP package under construction; ``date`` is that of its records."""

    def __init__(self, force_zip64: bool = False, date: str = "1970-01-01T00:00:00Z") -> None:
        self.data, self.index, self.taken, self.force, self.date = io.BytesIO(), [], 0, force_zip64, date
        headers = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
        self._member(warc_record("warcinfo", headers, b"software: sparkloom\r\nformat: WARC File Format 1.1\r\n"))

    def _member(self, record: bytes) -> tuple[int, int]:
        at, packed = self.data.tell(), gzip.compress(record, 4, mtime=0)
        self.data.write(packed)
        return at, len(packed)

    def add(self, page_id: int | None, url: str | None, record: bytes, payload_bytes: int, **told: str) -> None:
        """Adds a page's record; ``told`` is said of it in the index."""
        offset, length = self._member(record)
        uri = target_uri(url)
        line = json.dumps({"url": uri, **told, "length": str(length), "offset": str(offset), "filename": MEMBER.rsplit("/", 1)[1]})
        self.index.append((search_key(uri), re.sub(r"\D", "", self.date)[:14], offset, line))
        self.taken += payload_bytes

    def lines(self) -> str:
        return "".join(f"{key} {time} {line}\n" for key, time, _, line in sorted(self.index))

    def bytes(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for name, data in ((MEMBER, self.data.getvalue()), (INDEX, self.lines().encode())):
                with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=self.force) as f:
                    f.write(data)
        return out.getvalue()


def _put(path: str, data: bytes) -> None:
    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as f:
        f.write(data)


def _digests(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, n of each row of ``pages``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("n"),
    )


def _records(rows: DataFrame, root: str, package_bytes: int, date: str, among=None) -> DataFrame:
    """path, records of packages with a record for each of the rows (page_id, url, payload, digest, n, refers_to, key): a
    revisit has no payload. With ``among``, only for those whose key is surely not in that bitmap."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, attempt = Package(date=date), uuid.uuid4().hex

        def close() -> pa.RecordBatch:
            path = f"{root}/{attempt}-{uuid.uuid4().hex}.wacz"
            _put(path, package.bytes())
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(package.index)], pa.int64())], names=["path", "records"])

        for batch in slices(batches, "payload"):
            if among is not None:
                batch = batch.filter(pa.array(~maybe_among(among.value, batch.column("key").to_numpy())))
            for row in batch.to_pylist():
                payload = (row["payload"] or "").encode()
                record = page_record(row["page_id"], row["url"], payload, row["n"], row["digest"], row["refers_to"], date)
                told = {"mime": "text/html", "status": "200"} if row["refers_to"] is None else {"mime": "warc/revisit"}
                package.add(row["page_id"], row["url"], record, len(record), digest=labelled(row["digest"]), **told)
                if package.taken >= package_bytes:
                    yield close()
                    package = Package(date=date)
        if package.index:
            yield close()

    return rows.select("page_id", "url", "payload", "digest", "n", "refers_to", "key").mapInArrow(write, "path string, records long")


def write_packages(pages: DataFrame, least: int = LEAST_REVISIT, package_bytes: int = PACKAGE_BYTES, date: str | None = None) -> DataFrame:
    """path, records of the packages that hold a record for each row of ``pages`` (page_id, url, html), dated ``date`` (now).

    Digests decide, without payloads, which rows are revisits, and those are written without. Payloads whose digest is surely not
    a copied one are written where they are read; only the others are shuffled, by digest and page_id, so that the
    copies of one page do not meet in one task."""
    bounded_batches(pages.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = _digests(pages).withColumn("key", F.xxhash64("digest"))
    held: list[str] = []
    narrow = stage(rows.drop("payload"), "digests", held)
    copied = narrow.filter(F.col("n") >= least).groupBy("digest").agg(F.count("*").alias("copies"), F.max("page_id").alias("held"))
    copied = stage(copied.filter("copies > 1 AND held IS NOT NULL").select("digest", "held"), "copied", held)
    told = narrow.join(copied, "digest", "left").withColumn("refers_to", F.expr("CASE WHEN page_id IS NULL OR page_id <> held THEN held END"))
    revisits = told.filter("refers_to IS NOT NULL").withColumn("payload", F.lit(None).cast("string"))
    answers = told.filter("refers_to IS NULL").select(F.col("digest").alias("d"), F.col("page_id").alias("p")).distinct()
    bits = key_bitmap(copied.select(F.xxhash64("digest").alias("key")), "key")

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe_among(bits.value, batch.column("key").to_numpy())))

    maybe = rows.mapInArrow(copies, rows.schema)
    maybe = maybe.join(answers, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left_semi")
    none, root = F.lit(None).cast("long"), shared_path(pages.sparkSession, "packages")
    written = _records(rows.withColumn("refers_to", none), root, package_bytes, date, bits)
    for some in (maybe.withColumn("refers_to", none), revisits):
        written = written.unionByName(_records(some, root, package_bytes, date))
    packages = stage(written, "package-list")
    release(held)
    return packages


def read_packages(packages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of every record."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                file, rows, held = RangeFile(path), [], 0
                for record in ZipDirectory(file).records():
                    try:
                        *told, payload = page_of(record)
                    except ValueError as e:
                        raise ValueError(f"{e} in {path}") from e
                    rows.append((*told, None if payload is None else payload.decode()))
                    held += len(payload or b"")
                    if held >= 4 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)
                file.close()

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
    count, slots = packages.count(), packages.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(count, slots), -(-count // READ_TOGETHER))
    return packages.select("path").repartition(tasks).mapInArrow(read, schema)


def archived(pages: DataFrame) -> DataFrame:
    """The digest columns of every page's record, read back from freshly written packages."""
    return read_packages(write_packages(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM p),
r AS (SELECT *, CASE WHEN n >= {LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY s) ELSE page_id END AS held FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
       CASE WHEN page_id = held THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> held THEN held END AS refers_to FROM r
"""
