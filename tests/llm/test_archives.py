import base64
import hashlib
import json
import re
import zipfile
import zlib

import pytest

from sparkloom.llm import archives as a

SCHEMA = "page_id long, url string, html string, payload string"


def test_pages_come_back(spark):
    big, small = "<p>" + "x" * 2000, "<p>y</p>"
    rows = [(1, "http://a/1", big, "c"), (5, "http://a/5", big, "c"), (3, None, big, "c"), (2, "u", small, "c"), (4, "u", small, "c"), (6, "ü\r\nx", None, "c"), (7, "u", "é" * 600, "c"), (None, "n", big, "c"), (5, "http://a/5", big, "c")]
    packages = a.write_packages(spark.createDataFrame(rows, SCHEMA), package_bytes=3000)
    assert packages.count() > 1
    got = sorted((tuple(r) for r in a.read_packages(packages).collect()), key=str)
    want = []
    for page, url, html, _ in rows:
        data = (html or "").encode()
        held = 5 if html == big and page != 5 else None
        want.append((page, url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if held else "response", held, None if held else data.decode()))
    assert got == sorted(want, key=str)
    for path in [r.path.removeprefix("file://").removeprefix("file:") for r in packages.collect()]:
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    assert a.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_copies_and_a_long_page(spark):
    rows = [(i, "u", "<p>" + "z" * 1500, "c") for i in range(300)] + [(1000, "v", "é" * 3_000_000, "c"), (1001, "v", "w" * 2000, "c"), (1002, "v", "w" * 2000, "c")]
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in a.archived(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.pop(299) == ("response", None, 1503) and got.pop(1000) == ("response", None, 6_000_000)
    assert got.pop(1002) == ("response", None, 2000) and got.pop(1001) == ("revisit", 1002, 2000)
    assert set(got.values()) == {("revisit", 299, 1503)} and len(got) == 299


@pytest.mark.parametrize("wide", [False, True])
def test_directories(tmp_path, wide, monkeypatch):
    package = a.Package(force_zip64=wide)
    for i in range(30):
        package.add(i, "u", a.warc_record("response", [("Page-ID", str(i))], b"body %d" % i), 10)
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "p.wacz"
    path.write_bytes(package.bytes())
    assert (b"PK\x06\x06" in path.read_bytes()) == wide
    records = [a.parse_warc(r) for r in a.ZipDirectory(a.RangeFile(str(path))).records()]
    assert [(k, h["Page-ID"], b) for k, h, b in records] == [("response", str(i), b"body %d" % i) for i in range(30)]


def test_damage_is_noticed(tmp_path):
    path = tmp_path / "p"
    path.write_bytes(b"not a zip file at all")
    with pytest.raises(ValueError):
        a.ZipDirectory(a.RangeFile(str(path)))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(a.MEMBER, "x" * 100)
    with pytest.raises(ValueError):
        a.ZipDirectory(a.RangeFile(str(path))).stored(a.MEMBER)


def test_records_are_valid(spark):
    """Every record and index line by the rules of the formats, read without this library's reader."""
    rows = [(1, "http://www.Example.org:8080/a b?q=ü", "<p>" + "x" * 2000, "c"), (2, "https://b.example/", "<p>" + "x" * 2000, "c"), (3, None, "", "c"), (4, "no address", "é", "c"), (None, "ftp://x/y", "z", "c"), (5, "http://[broken/", "w", "c")]
    packages = a.write_packages(spark.createDataFrame(rows, SCHEMA), package_bytes=2500).collect()
    ids, referred, targets = set(), set(), set()
    for path in [r.path.removeprefix("file://").removeprefix("file:") for r in packages]:
        with zipfile.ZipFile(path) as z:
            data, lines = z.read(a.MEMBER), z.read(a.INDEX).decode().splitlines()
        assert lines == sorted(lines)
        told = {}
        for line in lines:
            key, time, about = line.split(" ", 2)
            assert re.fullmatch(r"\d{14}", time) and key.isascii()
            told[int(json.loads(about)["offset"])] = json.loads(about)
        at, first = 0, True
        while at < len(data):
            member = zlib.decompressobj(31)
            record = member.decompress(data[at:])
            end = len(data) - len(member.unused_data)
            head, _, block = record.partition(b"\r\n\r\n")
            version, *fields = head.decode("ascii").split("\r\n")
            headers = dict(f.split(": ", 1) for f in fields)
            assert version == "WARC/1.1" and len(headers) == len(fields) and block[int(headers["Content-Length"]) :] == b"\r\n\r\n"
            assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", headers["WARC-Record-ID"]) and headers["WARC-Record-ID"] not in ids
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", headers["WARC-Date"])
            ids.add(headers["WARC-Record-ID"])
            kind, block = headers["WARC-Type"], block[:-4]
            assert kind == ("warcinfo" if first else kind) and (at in told) == (not first)
            if not first:
                assert re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*:[!-~]+", headers["WARC-Target-URI"]) and int(told[at]["length"]) == end - at
                assert told[at]["url"] == headers["WARC-Target-URI"] and told[at]["digest"] == headers["WARC-Payload-Digest"]
                targets.add((headers["WARC-Target-URI"], headers["WARC-Type"]))
            if kind == "response":
                http, _, payload = block.partition(b"\r\n\r\n")
                assert headers["Content-Type"] == "application/http; msgtype=response" and http.startswith(b"HTTP/1.1 200 OK\r\n")
                assert headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            elif kind == "revisit":
                assert headers["WARC-Profile"] == "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" and not block
                referred.add(headers["WARC-Refers-To"])
            at, first = end, False
    assert len(referred) == 1 and referred <= ids
    assert targets == {
        ("http://www.Example.org:8080/a%20b?q=%C3%BC", "revisit"), ("https://b.example/", "response"), ("x-address:none", "response"), ("x-address:no%20address", "response"),
        ("ftp://x/y", "response"), ("http://[broken/", "response"),
    }
    assert a.search_key("http://www.Example.org:8080/a%20b?q=1") == "org,example,www:8080)/a%20b?q=1" and a.search_key("https://b.example") == "example,b)/"


def test_a_damaged_payload_is_noticed():
    good = a.page_record(1, "http://x/", b"body", 4, hashlib.sha1(b"body").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert a.page_of(good)[-1] == b"body"
    with pytest.raises(ValueError, match="damaged"):
        a.page_of(good.replace(b"body", b"bodx"))
