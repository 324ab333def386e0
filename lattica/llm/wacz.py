"""WARC in ZIP packages (the WACZ layout): stored members, a record index, and range reads without extraction.

A package holds `archive/data.warc.gz`, whose records are gzip members of their own, `indexes/index.cdxj`, one JSON line
per record with its offset and length, and `datapackage.json`; all are stored, not deflated. The reader finds the end of
the central directory from the tail of the file, follows the ZIP64 records where the 32-bit fields are full, and turns
each index entry into one range read. Files are reached by `pyarrow.fs`, so local, HDFS and object stores work alike.

Nulls, ties and odd rows: a null html is an empty payload; of equal payloads, the one with the smallest page_id is the
response, rows without page_id come after all others; rows that repeat a page_id are records of their own, of
which one, in the order of the input, is the response; empty tables write nothing and give no rows; other columns of pages are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

#: A package is closed when its records have so many bytes.
PACKAGE_BYTES = 32 << 20
CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit carries the digest and length of the payload, not the payload."""
    body = b"" if revisit else payload
    own = digest(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{own}|{revisit}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}",
        f"WARC-Payload-Digest: sha1:{own}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"X-Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return CRLF.join(x.encode() for x in head) + CRLF + CRLF + body + CRLF + CRLF


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(CRLF + CRLF)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class PackageWriter:
    """Streams records into the first member; sizes and checksums follow it in a data descriptor (so all members say 64-bit sizes)."""

    def __init__(self, out, zip64: bool = False) -> None:
        self.out, self.zip64, self.at, self.index, self.members = out, zip64, 0, [], []
        self.open_member("archive/data.warc.gz")

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def open_member(self, name: str) -> None:
        self.name, self.begin, self.crc, self.size = name, self.at, 0, 0
        raw = name.encode()
        self.write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x808, 0, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def put(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self.write(data)

    def close_member(self) -> None:
        self.write(struct.pack("<4sIQQ", b"PK\7\x08", self.crc, self.size, self.size))
        self.members.append((self.name, self.begin, self.crc, self.size))

    def add(self, page_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> None:
        data = gzip.compress(record(page_id, url, payload, refers_to, revisit), 1, mtime=0)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.size, "length": len(data), "filename": "data.warc.gz"}))
        self.put(data)

    def close(self) -> None:
        self.close_member()
        for name, data in (("indexes/index.cdxj", "\n".join(self.index).encode()), ("datapackage.json", json.dumps({"profile": "data-package", "records": len(self.index)}).encode())):
            self.open_member(name)
            self.put(data)
            self.close_member()
        begin = self.at
        for name, at, crc, size in self.members:
            raw, full = name.encode(), self.zip64 or max(at, size) >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if full else b""
            sizes = (0xFFFFFFFF,) * 2 if full else (size, size)
            self.write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x808, 0, 0, 33, crc, *sizes, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if full else at) + raw + extra)
        end, n = self.at, len(self.members)
        full = self.zip64 or end >= 0xFFFFFFFF
        if full:
            self.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, end - begin, begin))
            self.write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, *((0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF) if full else (n, n, end - begin, begin)), 0))


def members(file) -> dict[str, tuple[int, int]]:
    """Name to (offset, size) of the stored members of a seekable ZIP file, from its directories alone."""
    total = file.size()
    tail = min(total, 65_557 + 20)
    file.seek(total - tail)
    data = file.read(tail)
    at = data.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    n, size, begin = struct.unpack("<HII", data[at + 10 : at + 20])
    if (n == 0xFFFF or size == 0xFFFFFFFF or begin == 0xFFFFFFFF) and data[at - 20 : at - 16] == b"PK\6\7":
        (where,) = struct.unpack("<Q", data[at - 12 : at - 4])
        file.seek(where)
        far = file.read(56)
        if far[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory where its locator points")
        n, _, size, begin = struct.unpack("<QQQQ", far[24:56])
    file.seek(begin)
    data, at, out = file.read(size), 0, {}
    for _ in range(n):
        if data[at : at + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        method, packed, plain, name_n, extra_n, comment_n, offset = struct.unpack("<10xH8xIIHHH8xI", data[at : at + 46])
        name = data[at + 46 : at + 46 + name_n].decode()
        extra, at = data[at + 46 + name_n : at + 46 + name_n + extra_n], at + 46 + name_n + extra_n + comment_n
        while len(extra) >= 4:
            kind, length = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + length :]
        if method == 0:
            file.seek(offset)
            local = file.read(30)
            if local[:4] != b"PK\3\4":
                raise ValueError(f"no local header of {name}")
            out[name] = offset + 30 + sum(struct.unpack("<HH", local[26:30])), packed
    return out


def records(file):
    """(index entry, header fields, payload) of every record, by range reads."""
    found = members(file)
    for name, (at, size) in found.items():
        if not (name.startswith("indexes/") and name.endswith(".cdxj")):
            continue
        file.seek(at)
        for line in file.read(size).decode().splitlines():
            entry = json.loads(line)
            begin, length = found[f"archive/{entry['filename']}"]
            if entry["offset"] + entry["length"] > length:
                raise ValueError("index entry beyond its archive")
            file.seek(begin + entry["offset"])
            yield entry, *parsed(gzip.decompress(file.read(entry["length"])))


def filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder[5:] if folder.startswith("file:") else f"file://{folder}")


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html, refers_to, revisit) as packages in folder; (path, records) of each.

    A package counts only if the row with its path was kept: what a lost task wrote stays unread.
    """

    def write(batches):
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        writer, out, done, name = None, None, [], None

        def close():
            writer.close()
            out.close()
            done.append((name, len(writer.index)))

        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    name = f"{root}/{uuid.uuid4().hex}.wacz"
                    out = files.open_output_stream(name)
                    writer = PackageWriter(out)
                writer.add(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, revisit)
                if writer.at >= package_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        path, n = zip(*done) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(n, pa.int64())], ["path", "records"])

    return common.stored(pages.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(write, "path string, records long"), "packages")


def read_packages(packages: DataFrame, folder: str, page_id: str = "bigint", per_task: int = 4) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits) of all records.

    The payloads of responses are checked against their digests.
    """

    def read(batches):
        files, _ = filesystem(folder)
        kind = pa.int64() if page_id in ("bigint", "int") else pa.string()
        of = (lambda x: None if x is None else int(x)) if kind == pa.int64() else (lambda x: x)

        def batch_of(rows):
            kinds = (kind, pa.string(), pa.int64(), pa.string(), pa.string(), kind, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_file(path) as file:
                    for _, fields, payload in records(file):
                        kind_, own = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind_ == "response" and digest(payload) != own:
                            raise ValueError(f"{path}: a payload doesn't have its digest")
                        url = json.loads(f'"{fields["WARC-Target-URI"]}"')
                        rows.append((of(fields.get("X-Page-Id")), url, int(fields["X-Payload-Length"]), own, kind_, of(fields.get("X-Refers-To-Page-Id")), payload if kind_ == "response" else None))
                        if (held := held + len(payload)) > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    n = max(1, -(-packages.count() // per_task))
    kind = "string" if page_id not in ("bigint", "int") else "bigint"
    return packages.select("path").repartition(n).mapInArrow(read, f"page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary")


def deduplicated(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to, revisit: every payload but the first of its digest, by page_id, revisits it.

    Digests are aggregated and joined without the pages; only rows that repeat a payload are joined back to them.
    """
    numbered = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha"), F.monotonically_increasing_id().alias("row"))
    own = numbered.select("page_id", "sha", "row")
    several = own.groupBy("sha").agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first")).where("n > 1 and first is not null")
    repeats = common.join_counted(own, several, ["sha"]).where("page_id is null or page_id <> first.page_id or row <> first.row").select("row", "sha", F.col("first.page_id").alias("refers_to"))
    joined = numbered.join(repeats, ["row", "sha"], "left")
    return joined.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages as packages into the shared folder and reads their records back."""
    folder = f"{common.shared_dir(pages.sparkSession)}/lattica-wacz-{uuid.uuid4().hex}"
    return read_packages(write_packages(deduplicated(pages), folder), folder, pages.schema["page_id"].dataType.simpleString())


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), 'string_agg', '') AS payload_digest FROM p),
f AS (SELECT *, row_number() OVER w = 1 AS response, first_value(page_id) OVER w AS first FROM d WINDOW w AS (PARTITION BY payload_digest, payload_bytes ORDER BY page_id))
SELECT page_id, payload_bytes::bigint AS payload_bytes, payload_digest, CASE WHEN response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN response THEN NULL ELSE first END AS refers_to FROM f
"""
