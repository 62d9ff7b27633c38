"""Archives by the rules of their format, and reading in proportion to bytes."""

from __future__ import annotations

import gzip
import hashlib
import re
from base64 import b32encode
from datetime import UTC, datetime
from pathlib import Path

from tradewind.llm import warc

FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+): ([^\x00-\x08\x0a-\x1f]*)\Z")
NEEDED = {"WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length"}


def records(folder):
    """All records under ``folder``, read strictly: ``(fields, block)``."""
    for file in sorted(Path(folder.removeprefix("file:")).glob("*.warc.gz")):
        data = file.read_bytes()
        plain = gzip.decompress(data)
        assert data.count(b"\x1f\x8b\x08") >= plain.count(b"WARC/1.1\r\n")  # a member a record
        at = 0
        while at < len(plain):
            head, _, _ = plain[at:].partition(b"\r\n\r\n")
            version, *lines = head.split(b"\r\n")
            assert version == b"WARC/1.1"
            matched = [FIELD.match(line) for line in lines]
            assert all(matched), lines
            fields = {m[1].decode(): m[2].decode() for m in matched}
            assert len(fields) == len(lines) and fields.keys() >= NEEDED
            begin = at + len(head) + 4
            end = begin + int(fields["Content-Length"])
            assert plain[end : end + 4] == b"\r\n\r\n"
            yield fields, plain[begin:end]
            at = end + 4


def test_archives_keep_to_the_format(spark, tmp_path):
    big = "<p>é" + "x" * 1500
    rows = [
        (1, "http://a.example/é x?q=1#f", big), (2, 'http://b.example/"quoted"', big), (3, None, "small"),
        (4, "", ""), (5, "http://c.example/\r\nWARC-Type: response", None), (None, "http://d.example/%20", big + "z"),
        (6, "http://e.example/", "a\r\n\r\nb"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    when = datetime(2024, 2, 29, 12, 30, 1, tzinfo=UTC)
    warc.write_archives(pages, folder, captured=when).count()
    found = list(records(folder))
    assert len(found) == len(rows)
    assert len({f["WARC-Record-ID"] for f, _ in found}) == len(rows)
    html = {p: (h or "").encode() for p, _, h in rows}
    for fields, block in found:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"])
        assert fields["WARC-Date"] == "2024-02-29T12:30:01Z"
        assert fields["Content-Type"] == "application/http; msgtype=response"
        uri = fields.get("WARC-Target-URI")
        assert uri is None or re.fullmatch(r"[A-Za-z0-9%/:?#\[\]@!$&'()*+,;=._~-]+", uri)
        head, _, payload = block.partition(b"\r\n\r\n")
        status, *headers = head.split(b"\r\n")
        assert status == b"HTTP/1.1 200 OK" and all(FIELD.match(h) for h in headers)
        page = int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None
        assert fields["WARC-Payload-Digest"] == "sha1:" + b32encode(hashlib.sha1(html[page]).digest()).decode()
        if fields["WARC-Type"] == "revisit":
            assert page == 1 and payload == b"" and "revisit/identical-payload-digest" in fields["WARC-Profile"]
            assert fields["WARC-Refers-To-Target-URI"] == "http://b.example/%22quoted%22"
            assert fields["WARC-Refers-To-Date"] == fields["WARC-Date"]
        else:
            assert fields["WARC-Type"] == "response" and payload == html[page]
    uris = {f.get("X-Page-ID"): f.get("WARC-Target-URI") for f, _ in found}
    assert uris["1"] == "http://a.example/%C3%A9%20x?q=1#f" and uris["3"] is None and uris["4"] is None


def test_a_very_long_page_comes_back(spark):
    html = "".join(f"<p>{i} é</p>" for i in range(600_000))
    pages = spark.createDataFrame([(1, "http://a.example/", html), (2, "http://a.example/2", html)], "page_id long, url string, html string")
    found = {r.page_id: r for r in warc.read_pages(warc.archive(spark, pages), pages).collect()}
    assert found[2].payload == html and found[1].refers_to == 2
    assert found[1].payload_bytes == len(html.encode()) and found[1].payload_digest == found[2].payload_digest


def test_reading_takes_tasks_in_proportion_to_bytes(spark, monkeypatch):
    digest = hashlib.sha512
    rows = [(i, f"http://h{i % 7}.example/{i}", digest(str(i).encode()).hexdigest() * 20) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc.archive(spark, pages)
    size = made.captures.agg({"length": "sum"}).first()[0]
    monkeypatch.setattr(warc, "PART_BYTES", size // 12)
    monkeypatch.setattr(warc, "PART_KEYS", 50)
    found = warc.read_pages(made, pages)
    assert found.rdd.getNumPartitions() in (12, 13)
    assert {r.page_id for r in found.collect()} == set(range(600))
