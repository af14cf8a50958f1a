"""WARC records in ZIP packages: write, find and range-read them without extraction.

A package is a ZIP archive of stored members: archive/data.warc.gz, WARC records compressed one by one, and
indexes/index.cdx, a line per record (offset, length, record id). Reading a package takes its tail for the end record
(and the ZIP64 one if the fields say so), the central directory, each member's local header for where its bytes start,
the index member, and then one range per record or run of neighbouring records.

Packages lie in the cluster's shared folder, under names that no other task attempt uses; only those of attempts that
were committed are listed in the written table of packages, so a lost executor leaves at worst unlisted files.

Of records with equal payloads of at least LEAST bytes the one with the smallest id is the response and the others are
revisits that refer to it; smaller payloads are always responses. A null payload is empty. Rows that repeat an id with
the same payload are responses alike; a null id is never the smallest, and refers like any other. Payloads are written
whole, however long. An empty table gives no packages and no records. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorweft.llm.common import emit, fresh_path, materialise, maybe_broadcast, quoted, ship, slices, values

#: Payloads smaller than this are never revisits.
LEAST = 100
#: A package is closed when its records reach this.
PACKAGE_BYTES = 64 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Neighbouring records are read together up to this.
RANGE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- the ZIP side


class BadPackage(ValueError):
    pass


class Ranges:
    """Byte ranges of a file in any store that pyarrow opens (file, hdfs, s3, gs, ...)."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(inner)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or length < 0 or start + length > self.size:
            raise BadPackage(f"range {start}+{length} outside of {self.size} bytes")
        return self.file.read_at(length, start)

    def close(self) -> None:
        self.file.close()


class Bytes(Ranges):
    """The same over bytes in memory."""

    def __init__(self, data: bytes):
        self.file, self.size = pa.BufferReader(data), len(data)


def central_directory(source: Ranges) -> tuple[int, int, int]:
    """(entries, size, offset) of the central directory, by the ZIP64 end record where the plain one is full."""
    tail_at = max(0, source.size - 22 - 0xFFFF)
    tail = source.read(tail_at, source.size - tail_at)
    at = len(tail)
    while True:
        at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise BadPackage("no end of central directory")
        if at + 22 <= len(tail):
            entries, size, offset, comment = struct.unpack("<HIIH", tail[at + 10 : at + 22])
            if at + 22 + comment == len(tail):
                break
    if entries == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        place = source.read(tail_at + at - 20, 20)
        if place[:4] != b"PK\x06\x07":
            raise BadPackage("no ZIP64 locator")
        record = source.read(struct.unpack("<Q", place[8:16])[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise BadPackage("no ZIP64 end of central directory")
        entries, size, offset = struct.unpack("<QQQ", record[32:56])
    return entries, size, offset


def members(source: Ranges) -> dict[str, tuple[int, int]]:
    """Name to (start, length) of the stored members' bytes."""
    entries, size, offset = central_directory(source)
    directory, at, found = source.read(offset, size), 0, {}
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise BadPackage("broken central directory")
        flags, method = struct.unpack("<HH", directory[at + 8 : at + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        header = struct.unpack("<I", directory[at + 42 : at + 46])[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: those of plain size, packed size and offset that are full, in this order
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        if flags & 1:
            raise BadPackage(f"{name} is encrypted")
        if method == 0:
            local = source.read(header, 30)
            if local[:4] != b"PK\x03\x04":
                raise BadPackage(f"no local header of {name}")
            a, b = struct.unpack("<HH", local[26:30])
            found[name] = (header + 30 + a + b, packed)
        at += 46 + n_name + n_extra + n_comment
    return found


# --------------------------------------------------------------- the WARC side


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    text = urn.strip("<>").rpartition(":")[2]
    return int(text) if text else None


def warc_record(page_id, url: str, payload: bytes, digest: str, revisit: bool, refers) -> bytes:
    """One record: a response with its payload, or a revisit with the head of the response alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    url = "".join(c for c in url if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:])}


def parse_record(data: bytes) -> dict:
    """What a record says; a response's payload is held against its digest."""
    top, _, rest = data.partition(b"\r\n\r\n")
    if not top.startswith(b"WARC/"):
        raise BadPackage("not a WARC record")
    warc = parse_headers(top)
    block = rest[: int(warc["content-length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = warc["warc-payload-digest"].partition(":")[2]
    kind = warc["warc-type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise BadPackage(f"payload of {warc['warc-record-id']} doesn't have its digest")
    return {
        "page_id": page_of(warc["warc-record-id"]),
        "url": warc.get("warc-target-uri", ""),
        "payload_bytes": int(parse_headers(head)["content-length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page_of(warc["warc-refers-to"]) if "warc-refers-to" in warc else None,
        "payload": payload if kind == "response" else None,
    }


class PackageWriter:
    """Writes one package as a stream: no seeks, so any store will do. The index stays in memory until the end."""

    def __init__(self, sink):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index, self.size = io.StringIO(), 0

    def add(self, page_id, record: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = packer.compress(record) + packer.flush()
        self.member.write(data)
        self.index.write(f"{self.size} {len(data)} {record_id(page_id)}\n")
        self.size += len(data)

    def close(self) -> None:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write(self.index.getvalue().encode())
        self.zip.close()


# --------------------------------------------------------------- the Spark side


def with_references(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, html, digest, refers_to); refers_to is null for responses."""
    payload = F.coalesce(quoted(html), F.lit(""))
    p = pages.select(quoted(page_id).cast("long").alias("page_id"), F.coalesce(quoted(url), F.lit("")).alias("url"), payload.alias("html"))
    p = p.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("size", F.octet_length("html"))
    # Equal payloads meet as partial smallest ids; only those that two pages have go on to the join, which AQE may split.
    firsts = p.filter(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("key"), "least")
    key = F.when(F.col("size") >= LEAST, F.col("digest")).otherwise(F.concat(F.lit("small "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), "digest"))
    # smaller payloads are all responses; where the digests of repeated ones fit a broadcast, no html is shuffled
    both = p.withColumn("key", key).join(maybe_broadcast(materialise(firsts, "firsts")), "key", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    return both.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write records (as of with_references) to packages in folder; the table (path, n_records, size) of those that hold."""

    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder)
        store.create_dir(inner, recursive=True)
        done, now, name, sink, n = [], None, "", None, 0

        def close():
            now.close()
            sink.close()
            done.append((f"{folder}/{name}", n, now.size))

        for batch in batches:
            for part in slices(batch, ["html"]):
                for page, url, html, digest, refers in zip(*(values(part.column(i)) for i in range(5)), strict=True):
                    if now is None:
                        name, n = f"{uuid.uuid4().hex}.wacz", 0
                        sink = store.open_output_stream(f"{inner}/{name}")
                        now = PackageWriter(sink)
                    revisit = refers is not None
                    now.add(page, warc_record(page, url.decode("utf-8", "replace"), html, digest.decode(), revisit, refers))
                    n += 1
                    if now.size >= package_bytes:
                        close()
                        now = None
        if now is not None:
            close()
        yield pa.RecordBatch.from_pylist([{"path": p, "n_records": k, "size": s} for p, k, s in done], schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("size", pa.int64())]))

    return materialise(records.mapInArrow(run, "path string, n_records long, size long"), "packages")


def locate(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, length, sizes): runs of neighbouring records, by directory and index of each package."""

    def run(paths):
        out = ([], [], [], [])
        for path in paths:
            source = Ranges(path.decode())
            found = members(source)
            start, _ = found[DATA]
            index = source.read(*found[INDEX]).decode()
            source.close()
            first, held, sizes = 0, 0, []

            def close(path=path, start=start):
                for x, y in zip(out, (path.decode(), start + first, held, sizes)):
                    x.append(y)

            for line in index.splitlines():
                at, n = map(int, line.split(" ", 2)[:2])
                if sizes and held + n > range_bytes:
                    close()
                    held, sizes = 0, []
                first = first if sizes else at
                sizes.append(n)
                held += n
            if sizes:
                close()
        return out

    return emit(packages, ["path"], run, "path string, start long, length long, sizes array<long>")


def read_records(located: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]
    kinds = dict(page_id="long", url="string", payload_bytes="long", payload_digest="string", record_type="string", refers_to="long", payload="binary")
    types = dict(page_id=pa.int64(), url=pa.string(), payload_bytes=pa.int64(), payload_digest=pa.string(), record_type=pa.string(), refers_to=pa.int64(), payload=pa.binary())
    schema = pa.schema([(n, types[n]) for n in names])
    ship(located.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, Ranges] | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if opened is None or opened[0] != row["path"]:
                    if opened:
                        opened[1].close()
                    opened = (row["path"], Ranges(row["path"]))
                data, at, out = opened[1].read(row["start"], row["length"]), 0, []
                for n in row["sizes"]:
                    found = parse_record(gzip.decompress(data[at : at + n]))
                    out.append({k: found[k] for k in names})
                    at += n
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if opened:
            opened[1].close()

    return located.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def archive(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Write a record per row of pages to packages in the shared folder; the table of the packages."""
    return write_packages(with_references(pages, page_id, html, url), uri(pages.sparkSession, fresh_path(pages.sparkSession, "archives")))


def uri(spark: SparkSession, path: str) -> str:
    """A path as the cluster's default file system takes it, with its scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole
