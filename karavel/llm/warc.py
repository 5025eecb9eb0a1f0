"""WARC archives: written as one gzip member per record, read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from karavel.llm.common import sized, stage
from karavel.session import shared_folder

SPLIT_BYTES = 8 << 20  # of an archive that one task scans
READ_BYTES = 1 << 18
MAGIC = b"\x1f\x8b\x08"  # fixed value: gzip, deflate
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the WARC standard
SCHEMA = "record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, digest_ok boolean, payload binary, path string, offset long"


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI that all executors share."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header of its page but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "urn:none")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("X-Page-Id", "" if page_id is None else page_id),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", refers_to)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def assign_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: of pages with equal payloads of ``least_bytes`` or more the largest page_id is the response.

    Null html is an empty payload. A page_id that occurs twice with the same payload gives two responses.
    Pages without a page_id never are the one referred to, unless all of their group lack it; then all are responses.
    Only digests that occur twice are joined, and only they are shuffled.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first_page"))
    groups = sized(stage(groups.where("n > 1 and first_page is not null").select("digest", "first_page"), "warc_groups"), 20_000)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_page")), F.col("first_page"))
    return rows.join(groups, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write page_id, url, payload, refers_to as archives below ``folder``: one file per task, (path, n_bytes, n_records).

    A file appears under its final name when it is complete. A task that runs again writes a file of
    another name, so only the files listed in the staged result count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}.warc.gz"
        size = count = 0
        with fs.open_output_stream(name + ".part") as out:
            while batch is not None:
                for page, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                    data = record_bytes(page.as_py(), url.as_py(), payload.as_py(), refers.as_py())
                    out.write(data)
                    size, count = size + len(data), count + 1
                batch = next(batches, None)
        fs.move(name + ".part", name)
        yield pa.RecordBatch.from_pydict({"path": [name.rpartition("/")[2]], "n_bytes": [size], "n_records": [count]})

    done = rows.mapInArrow(write, "path string, n_bytes long, n_records long")
    return stage(done.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "path")), "warc_files")


def parse_record(data: bytes) -> tuple[dict, bytes] | None:
    """Header fields and block of an unpacked member; None if it is no WARC record."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        return None
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    block = data[end + 4 :]
    if not length.isdigit() or len(block) < int(length):
        return None
    return fields, block[: int(length)]


class _Window:
    """Bytes of a file from a moving position on, read as needed."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.data = file, at, size, b""

    def fill(self, least: int) -> bytes:
        while len(self.data) < least and self.at + len(self.data) < self.size:
            self.file.seek(self.at + len(self.data))
            self.data += self.file.read(max(READ_BYTES, least - len(self.data)))
        return self.data

    def skip(self, n: int) -> None:
        self.fill(n)
        self.data, self.at = self.data[n:], self.at + n


def _unpack(window: _Window) -> tuple[bytes, int] | None:
    """The member that begins at the window, and its packed length; None if no whole member of a record does."""
    d, out, used = zlib.decompressobj(31), io.BytesIO(), 0
    try:
        while not d.eof:
            data = window.fill(used + READ_BYTES)[used : used + READ_BYTES]
            if not data:
                return None
            used += len(data)
            out.write(d.decompress(data))
            if out.tell() >= 5 and not out.getbuffer()[:5].tobytes() == b"WARC/":
                return None
    except zlib.error:
        return None
    return out.getvalue(), used - len(d.unused_data)


def scan_range(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict, bytes]]:
    """Records that begin in [start, end): look for the gzip mark, and take it for one if a whole record unpacks there."""
    window = _Window(file, start, size)
    while window.at < min(end, size):
        data = window.fill(READ_BYTES)
        if not data.startswith(MAGIC):
            found = data.find(MAGIC, 1)
            if found < 0 and window.at + len(data) >= size:
                return
            window.skip(found if found >= 0 else max(1, len(data) - len(MAGIC) + 1))
            continue
        member = _unpack(window)
        record = parse_record(member[0]) if member else None
        if record:
            yield window.at, *record
        window.skip(member[1] if record else 1)


def read_archives(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives listed in ``files`` (path, n_bytes), one row each (columns: SCHEMA).

    A task gets a byte range and owns the records that begin in it. Bytes that are no record are passed
    over. An empty list gives no rows. digest_ok compares the payload of a response with its stated digest.
    """
    parts = files.where("n_bytes > 0").select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    count = parts.count()
    parts = parts.repartition(max(1, min(count, 100_000)), F.xxhash64("path", "start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])
        number = lambda x: int(x) if x else None
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, name = open_store(path)
                rows, held = [], 0
                with fs.open_input_file(name) as file:
                    for at, fields, block in scan_range(file, size, start, start + split_bytes):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields.get("warc-payload-digest", "").rpartition(":")[2]
                        kind, ok = fields.get("warc-type"), None
                        length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                        if kind == "response":
                            real = sha1_base32(payload)
                            ok, digest, length = real == digest, real, len(payload)
                        rows.append((fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), number(fields.get("x-page-id")), number(fields.get("x-refers-to-page-id")), digest, length, ok, payload if kind == "response" else None, path, at))
                        held += len(block)
                        if held > READ_BYTES * 16:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return parts.mapInArrow(read, SCHEMA)


def all_read(records: DataFrame, files: DataFrame) -> DataFrame:
    """The records, if as many were read from each file as were written to it; otherwise an error."""
    found = records.groupBy("path").agg(F.count("*").alias("n"))
    lost = files.join(found, "path", "left").where(F.coalesce("n", F.lit(0)) != F.col("n_records")).select("path", "n_records", "n").head(1)
    if lost:
        raise ValueError(f"{lost[0].path}: {lost[0].n_records} records written, {lost[0].n or 0} read")
    return records


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of all pages, written to the shared folder and read again; see ``read_archives`` for the columns."""
    spark = pages.sparkSession
    files = write_archives(assign_revisits(pages), shared_folder(spark, "warc"))
    return all_read(stage(read_archives(spark, files), "warc_records"), files)
