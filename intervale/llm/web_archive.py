"""WARC records in ZIP packages: written with an index, read by ranges without extraction.

A package holds stored (uncompressed) members `archive/data.warc.gz`, a gzip member for each record, and
`indexes/index.cdxj`, a line for each record with its offset and length in the archive member. The reader
parses the end-of-directory records (ZIP64 ones where present), the central directory with its ZIP64 extra
fields, and a member's local header, then reads byte ranges of stored members from the file itself.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.memory import trimmed
from intervale.llm.scratch import Scratch, filesystem

#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 100
#: Records of a package end when the archive member has this many bytes.
PACKAGE_BYTES = 64 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_WHEN = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")  # pages have no date
_ALL32, _ALL16 = 0xFFFFFFFF, 0xFFFF


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC record with its HTTP header; a revisit's block ends with the header, whose Content-Length is the full payload's."""
    kind = "response" if refers_to is None else "revisit"
    name = lambda i: f"<urn:uuid:{uuid5(NAMESPACE_URL, f'page:{i}')}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    uri = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:none")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {_WHEN}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    head += [f"X-Page-ID: {page_id}"] * (page_id is not None)
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


class PackageWriter:
    """A ZIP of stored members, each streamed; sizes follow in ZIP64 data fields of the central directory."""

    def __init__(self, out, zip64_from: int = _ALL32):
        self.out, self.at, self.entries, self.limit = out, 0, [], zip64_from

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """Start a member; its size and checksum come in a descriptor after it (flag bit 3)."""
        raw = name.encode()
        self.entries.append({"name": raw, "at": self.at, "size": 0, "crc": 0})
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, _ALL32, _ALL32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> int:
        """Append to the member; returns where in it the data starts."""
        e = self.entries[-1]
        start, e["size"], e["crc"] = e["size"], e["size"] + len(data), zlib.crc32(data, e["crc"])
        self._put(data)
        return start

    def end(self) -> None:
        e = self.entries[-1]
        self._put(struct.pack("<IIQQ", 0x08074B50, e["crc"], e["size"], e["size"]))

    def close(self) -> None:
        start = self.at
        for e in self.entries:
            big, far = e["size"] >= self.limit, e["at"] >= self.limit
            body = (struct.pack("<QQ", e["size"], e["size"]) if big else b"") + (struct.pack("<Q", e["at"]) if far else b"")
            extra = struct.pack("<HH", 1, len(body)) + body if body else b""
            size = _ALL32 if big else e["size"]
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, e["crc"], size, size, len(e["name"]), len(extra), 0, 0, 0, 0, _ALL32 if far else e["at"]) + e["name"] + extra)
        length, n = self.at - start, len(self.entries)
        if max(length, start) >= self.limit or n >= _ALL16:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, length, start))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, end64, 1))
            n, length, start = _ALL16, _ALL32, _ALL32
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, length, start, 0))


class Package:
    """Members of a ZIP by name; `source` has seek and read."""

    def __init__(self, source, size: int):
        self.source = source
        tail_at = max(0, size - 22 - _ALL16)
        tail = self._read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
        if _ALL16 == n or _ALL32 in (length, start):
            locator = self._read(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
            if locator[:4] == b"PK\x06\x07":
                record64 = self._read(int.from_bytes(locator[8:16], "little"), 56)
                if record64[:4] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end of central directory")
                n, length, start = struct.unpack("<QQQ", record64[32:56])
        self.members: dict[str, dict] = {}
        directory, at = self._read(start, length), 0
        for _ in range(n):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack("<HH", directory[at + 8 : at + 12])
            packed, full, names, extras, comment = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
            offset = int.from_bytes(directory[at + 42 : at + 46], "little")
            name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = directory[at + 46 + names : at + 46 + names + extras], 0
            while k + 4 <= len(extra):
                tag, long = struct.unpack("<HH", extra[k : k + 4])
                if tag == 1:  # only the fields that did not fit, in this order
                    values = [int.from_bytes(extra[j : j + 8], "little") for j in range(k + 4, k + 4 + long - 7, 8)]
                    full = values.pop(0) if full == _ALL32 else full
                    packed = values.pop(0) if packed == _ALL32 else packed
                    offset = values.pop(0) if offset == _ALL32 else offset
                k += 4 + long
            self.members[name] = {"method": method, "size": packed, "full": full, "at": offset, "data": None}
            at += 46 + names + extras + comment

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def read(self, name: str, at: int = 0, size: int | None = None) -> bytes:
        """A range of a stored member, read from the package file."""
        m = self.members[name]
        if m["method"]:
            raise ValueError(f"{name} is compressed; ranges need stored members")
        if m["data"] is None:
            head = self._read(m["at"], 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header of {name}")
            m["data"] = m["at"] + 30 + sum(struct.unpack("<HH", head[26:30]))
        at = min(at, m["size"])
        return self._read(m["data"] + at, m["size"] - at if size is None else min(size, m["size"] - at))

    def records(self, index: str = INDEX, archive: str = ARCHIVE) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers, block) of each record that the index names, each by a range read."""
        for line in self.read(index).decode().splitlines():
            entry = json.loads(line.split(" ", 2)[2])
            raw = zlib.decompress(self.read(archive, int(entry["offset"]), int(entry["length"])), 31)
            head, _, rest = raw.partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write rows (page_id, url, html, size, digest, refers_to) as packages; returns path and records of each finished one."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        package = out = None
        index: list[str] = []
        count = seq = 0

        def finish() -> pa.RecordBatch:
            nonlocal package, index, count, seq
            package.end()
            package.begin(INDEX)
            package.write("".join(index).encode())
            package.end()
            package.close()
            out.close()
            row = pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})
            package, index, count, seq = None, [], 0, seq + 1
            return row

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for page_id, url, html, size, digest, refers_to in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    if package is None:
                        path = f"{base}/part-{context.partitionId():06d}-{seq:04d}-{context.taskAttemptId()}.wacz"
                        out = fs.open_output_stream(path)
                        package = PackageWriter(out)
                        package.begin(ARCHIVE)
                    press = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = press.compress(record(page_id, url, (html or "").encode(), size, digest, refers_to)) + press.flush()
                    at = package.write(data)
                    index.append(f"{page_id} {_WHEN} " + json.dumps({"digest": f"sha256:{digest}", "filename": ARCHIVE, "offset": at, "length": len(data)}) + "\n")
                    count += 1
                    if at + len(data) >= package_bytes:
                        yield finish()
        if package is not None:
            yield finish()

    return pages.select("page_id", "url", "html", "size", "digest", "refers_to").mapInArrow(trimmed(write), "path string, records long")


def read_packages(files: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; responses' digests are checked."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    rows = []
                    for h, block in Package(f, f.size()).records():
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in head.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"payload of {h['WARC-Record-ID']} in {path} does not fit its header")
                        page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                        rows.append({"page_id": page and int(page), "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": refers and int(refers)})
                yield from pa.Table.from_pylist(rows, schema).to_batches()

    return files.select("path").repartition(n, "path").mapInArrow(trimmed(read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write `pages` as packages in the shared folder and read them back.

    Of equal payloads of `least_bytes` or more, rows with the least page_id are responses (all of them, if that id is
    repeated), other rows revisits of it; where all ids are null every row is a response. Null html is empty, a null page_id stays
    null; an empty table gives no rows; other columns are left aside.
    """
    scratch = Scratch(pages.sparkSession, "archive")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha2(html.cast("binary"), 256).alias("digest"))
    # partial minima first: a digest that a third of the pages share comes to the join as one row
    first = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    marked = rows.join(first, F.col("digest") == F.col("d"), "left").withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")))
    # a revisit's payload need not travel
    slim = marked.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    folder = f"{scratch.path}/packages"
    return read_packages(scratch.table(write_packages(slim, folder), "manifest"), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: `pages` archived and read back."""
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
