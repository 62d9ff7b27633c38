"""WARC archives with a two-level capture index.

Archives hold one gzip member a record. The index sorts captures by a key that begins with the
reversed host, packs them into compressed blocks, and lists only the blocks' first keys.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.scratch import scratch_dir, written

#: Captures per block of the index.
BLOCK_CAPTURES = 1000
#: Bytes of block directory that go to a task at a time; a larger one is searched in parts.
DIRECTORY_BYTES = 32 << 20
#: A payload below so many bytes is always stored.
LEAST_REVISIT = 1000
#: Bytes read at a time from an archive.
READ_BYTES = 4 << 20
#: Compressed bytes of records that one task reads, about.
PART_BYTES = 16 << 20
#: Keys that one task looks up, about.
PART_KEYS = 50_000

_CAPTURES = (
    "page_id long, url string, key string, file string, offset long, length long"
)


def capture_key(url: str | None, page_id: int | None) -> str:
    """The sort key of a capture: reversed host, path and query, then the page's number.

    ``http://www.b.example:80/x?y`` begins ``example,b,www)/x?y``; scheme, port, user and fragment
    don't count, hosts count in lower case. A null URL has an empty host.
    """
    try:
        parts = urlsplit(re.sub(r"[\x00-\x20]", "", url or ""))
        host = parts.hostname or ""
        rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        host, rest = "", re.sub(r"[\x00-\x20]", "", url or "")
    number = "-" if page_id is None else f"{page_id + (1 << 63):020d}"
    return f"{','.join(reversed(host.split('.')))}){rest} {number}"


def target_uri(url: str | None) -> str | None:
    """``url`` as a header field can hold it: all but URI characters percent-encoded."""
    return quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url else None


def _record(row: dict, captured: str) -> bytes:
    """A page's record: an HTTP response with the payload, or for a revisit its head alone."""
    revisit = row["refers"] is not None
    payload = b"" if revisit else row["html"].encode()
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = f"{http}Content-Length: {row['size']}\r\n\r\n".encode() + payload
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", captured),
        ("WARC-Target-URI", target_uri(row["url"])),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
        ("X-Payload-Length", row["size"]),
        ("X-Page-ID", row["page_id"]),
        ("X-Page-URL", json.dumps(row["url"])),  # as it was given
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To-Target-URI", target_uri(row["refers_url"])),
            ("WARC-Refers-To-Date", captured),
            ("X-Refers-To-Page", row["refers"]),
        ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    response = fields["WARC-Type"] == "response"
    if response and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload of another digest than its record says")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    return {
        "page_id": int(page) if page else None,
        "url": json.loads(fields["X-Page-URL"]),
        "record_type": fields["WARC-Type"],
        "payload_digest": digest,
        "payload_bytes": int(fields["X-Payload-Length"]),
        "refers_to": int(refers) if refers else None,
        "payload": payload.decode() if response else None,
    }


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder (``file``, ``hdfs``, ``s3``, ``gs``), and its path there."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


@dataclass(frozen=True)
class Archive:
    """Where archives, index blocks and the block directory are."""

    folder: str
    captures: DataFrame
    directory: DataFrame


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, html, size, digest, refers, refers_url``: a page that repeats a payload of
    ``least`` bytes refers to the largest ``page_id`` that has it, and to a URL of that page.

    Of equal rows with that ``page_id`` all stay responses. Sizes and digests are grouped without
    the pages; only repeated ones are joined back.
    """
    sized = pages.select(
        F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumns(
        {"size": F.octet_length("html").cast("long"), "digest": F.sha1(F.encode("html", "UTF-8"))}
    )
    repeated = (
        sized.where(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"), F.max_by("url", "page_id").alias("first_url"))
        .where("n > 1")
        .drop("n")
    )
    repeats = ~F.col("page_id").eqNullSafe(F.col("first"))
    return (
        sized.join(repeated, ["digest", "size"], "left")
        .withColumn("refers", F.when(repeats, F.col("first")))
        .withColumn("refers_url", F.when(repeats, F.col("first_url")))
        .drop("first", "first_url")
    )


def write_archives(
    pages: DataFrame, folder: str, least: int = LEAST_REVISIT, captured: datetime | None = None
) -> DataFrame:
    """Writes a record per page into archives under ``folder``; the captures, as a written table.

    ``captured`` is the date of all records, by default now.

    A task writes its archive under a name of its own, so a task that runs again leaves no
    mixed file; only archives that the captures name count.
    """

    date = (captured or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        name, out, offset = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows: list[dict] = []
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                member = gzip.compress(_record(row, date), 6, mtime=0)
                out.write(member)
                rows.append(
                    {
                        "page_id": row["page_id"],
                        "url": row["url"],
                        "key": capture_key(row["url"], row["page_id"]),
                        "file": name,
                        "offset": offset,
                        "length": len(member),
                    }
                )
                offset += len(member)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _CAPTURE_SCHEMA)
        if out:
            out.close()

    return written(with_revisits(pages, least).mapInArrow(run, _CAPTURES))


_CAPTURE_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("key", pa.string()),
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
    ]
)


def write_index(captures: DataFrame, folder: str, block: int = BLOCK_CAPTURES) -> DataFrame:
    """Writes the index blocks; the sparse directory ``first, last, file, offset, length`` (of keys
    and places), a row a block, as a written table.

    Captures are dealt by range of key and sorted, so blocks of neighbouring keys lie in one file.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        name, out, offset, held = f"{uuid.uuid4().hex}.cdx.gz", None, 0, []

        def flush(rows: list[dict]) -> dict:
            nonlocal out, offset
            out = out or store.open_output_stream(f"{path}/{name}", compression=None)
            lines = [
                f"{r['key']} {json.dumps([r['file'], r['offset'], r['length']])}\n" for r in rows
            ]
            member = gzip.compress("".join(lines).encode(), 6, mtime=0)
            out.write(member)
            entry = (rows[0]["key"], rows[-1]["key"], name, offset, len(member))
            offset += len(member)
            return dict(zip(_DIRECTORY_SCHEMA.names, entry, strict=True))

        for batch in batches:
            held += batch.to_pylist()
            entries = []
            while len(held) > block:
                entries.append(flush(held[:block]))
                held = held[block:]
            if entries:
                yield pa.RecordBatch.from_pylist(entries, _DIRECTORY_SCHEMA)
        if held:
            yield pa.RecordBatch.from_pylist([flush(held)], _DIRECTORY_SCHEMA)
        if out:
            out.close()

    kinds = "first string, last string, file string, offset long, length long"
    keyed = captures.select("key", "file", "offset", "length")
    ordered = keyed.repartitionByRange("key").sortWithinPartitions("key", "file", "offset")
    return written(ordered.mapInArrow(run, kinds))


_DIRECTORY_SCHEMA = pa.schema(
    [
        ("first", pa.string()),
        ("last", pa.string()),
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
    ]
)


def lookup(directory: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """``file, offset, length`` of every capture whose key is in ``keys`` (column ``key``).

    The directory's bytes are measured; a part of at most ``DIRECTORY_BYTES`` goes to every task at
    a time. A task finds the blocks of its keys by binary search in that, and reads and searches
    each block once.
    """
    spark = keys.sparkSession
    size = directory.agg(F.sum(F.length("first") + F.length("last") + 64)).first()[0] or 0
    parts = int(size // DIRECTORY_BYTES) + 1
    tasks = 1 + keys.count() // PART_KEYS
    wanted = keys.select("key").distinct().repartitionByRange(tasks, "key").sortWithinPartitions("key")
    found = None
    for part in range(parts):
        own = directory.where(F.pmod(F.xxhash64("file"), F.lit(parts)) == part).orderBy("first", "last")
        entries = spark.sparkContext.broadcast([tuple(r) for r in own.toLocalIterator()])

        def run(batches: Iterable[pa.RecordBatch], entries=entries) -> Iterator[pa.RecordBatch]:
            firsts = [e[0] for e in entries.value]
            store, path = _open(folder)
            block, at, places = [], -1, []
            for batch in batches:
                rows = []
                for key in batch.column(0).to_pylist():
                    # Equal keys may fill several blocks: from the last that begins before the
                    # key to the last that begins with it.
                    low = max(0, bisect_left(firsts, key) - 1)
                    for k in range(low, bisect_right(firsts, key)):
                        if entries.value[k][1] < key:
                            continue
                        if k != at:
                            _, _, file, offset, length = entries.value[k]
                            with store.open_input_file(f"{path}/{file}") as source:
                                data = source.read_at(length, offset)
                            lines = gzip.decompress(data).decode().split("\n")[:-1]
                            split = [line.split(" ", 2) for line in lines]
                            block = [f"{a} {b}" for a, b, _ in split]
                            places, at = [c for _, _, c in split], k
                        a, b = bisect_left(block, key), bisect_right(block, key)
                        rows += [json.loads(p) for p in places[a:b]]
                columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], []]
                kinds = (pa.string(), pa.int64(), pa.int64())
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["file", "offset", "length"])

        some = wanted.mapInArrow(run, "file string, offset long, length long")
        found = some if found is None else found.unionByName(some)
    return found


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """The records at these places, read by range. Payloads are checked against their digests.

    Places are written first: their lengths tell how many tasks the reading takes. They are dealt
    by range of file and offset, so that a task reads stretches of few archives.
    """
    kinds = (
        "page_id long, url string, record_type string, payload_digest string, "
        "payload_bytes long, refers_to long, payload string"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        name, source, data, begin = None, None, b"", 0
        for batch in batches:
            rows, size = [], 0
            places = zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True)
            for file, offset, length in places:
                if file != name:
                    name, data, begin = file, b"", 0
                    source = store.open_input_file(f"{path}/{file}")
                if not begin <= offset <= offset + length <= begin + len(data):
                    data, begin = source.read_at(max(length, READ_BYTES), offset), offset
                member = data[offset - begin : offset - begin + length]
                rows.append(_parse(zlib.decompress(member, wbits=31)))
                size += len(rows[-1]["payload"] or "")
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD_SCHEMA)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _RECORD_SCHEMA)

    places = written(places)
    tasks = 1 + (places.agg(F.sum("length")).first()[0] or 0) // PART_BYTES
    dealt = places.repartitionByRange(tasks, "file", "offset")
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(run, kinds)


_RECORD_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("refers_to", pa.int64()),
        ("payload", pa.string()),
    ]
)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> Archive:
    """Writes ``pages`` (``page_id``, ``url``, ``html``) as archives and indexes them.

    ``folder`` is on storage that all machines share; by default a new one in the session's scratch
    folder. A null ``html`` is an empty payload, a null URL or ``page_id`` is kept as such. Rows
    that repeat a page are records of their own. Without pages there are no archives. Other
    columns are not read.
    """
    folder = folder or scratch_dir(spark)
    captures = write_archives(pages, folder)
    return Archive(folder, captures, write_index(captures, folder))


def read_pages(archive: Archive, urls: DataFrame) -> DataFrame:
    """The records of the captures in ``urls`` (``url``, ``page_id``), found through the index."""

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            keys = pa.array([capture_key(u, p) for u, p in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([keys], names=["key"])

    asked = urls.select("url", F.col("page_id").cast("long")).mapInArrow(keyed, "key string")
    return read_records(lookup(archive.directory, archive.folder, asked), archive.folder)
