"""Web archives: a writer for legacy ARC files, a converter from ARC to WARC, a WARC reader.

The converter reads ARC version blocks, splits header lines by the field list of the
file's version, takes each record's bytes by the declared length and synthesises the
WARC record: identifier, ISO timestamp, record type and SHA-256 digests.  Equal payloads
become revisits of the record with the smallest key.

Only narrow rows (file, offset, key, digest) are grouped and shuffled.  A payload is read
from its ARC file by the task that writes it to a WARC file.  Files are named per attempt
and become visible through the manifest rows of successful tasks, so lost executors leave
unreferenced files at worst.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellshift.llm.common import bounded_batches
from cellshift.session import scratch_path, written

# The header fields of the two ARC versions, in order.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
KEY_HEADER = "X-Record-Key"
ARCHIVE_BYTES = 32 * 1024 * 1024
LEAST_REVISIT_BYTES = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 4


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Archive:
    """A folder of gzip members, one per record, rolled over at a size."""

    def __init__(self, folder: str, suffix: str, preface) -> None:
        self.folder, self.suffix, self.preface = folder, suffix, preface
        self.out, self.size, self.files = None, 0, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            name = f"{self.folder}/{uuid.uuid4().hex}{self.suffix}"
            system, path = _system(name)
            system.create_dir(os.path.dirname(path), recursive=True)
            self.out, self.size = system.open_output_stream(path, compression=None), 0
            self.files.append([name, 0])
            self.out.write(gzip.compress(self.preface(os.path.basename(name)), LEVEL, mtime=0))
        self.out.write(gzip.compress(record, LEVEL, mtime=0))
        self.files[-1][1] += 1
        self.size += len(record)
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _bytes(value) -> bytes:
    if value is None or (not isinstance(value, (str, bytes, bytearray)) and pd.isna(value)):
        return b""
    return value.encode() if isinstance(value, str) else bytes(value)


def _field(value: bytes) -> bytes:
    """A header-line field: blanks and control characters percent-encoded, never empty."""
    return b"".join(b"%%%02X" % b if b <= 0x20 or b == 0x7F else bytes([b]) for b in value) or b"unknown:"


def _version_block(version: int, date: str):
    def block(name: str) -> bytes:
        body = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
        values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Archive-length": str(len(body))}
        line = " ".join(values.get(field, "-") for field in ARC_FIELDS[version])
        return line.encode() + b"\n" + body

    return block


def _arc_writer(folder: str, date: str):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        archive = _Archive(folder, ".arc.gz", _version_block(version, date))
        for frame in frames:
            for key, url, payload in zip(frame["key"], frame["url"], frame["payload"], strict=True):
                body = _bytes(payload)
                head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]
                if not pd.isna(key):
                    head.append(f"{KEY_HEADER}: {int(key)}".encode())
                block = b"\r\n".join(head) + b"\r\n\r\n" + body
                target = _field(_bytes(url))
                if version == 1:
                    line = b" ".join([target, b"0.0.0.0", date.encode(), b"text/html", b"%d" % len(block)])
                else:
                    line = b" ".join([target, b"0.0.0.0", date.encode(), b"text/html", b"200", b"-", b"-", b"%d" % archive.size, b"-", b"%d" % len(block)])
                archive.add(line + b"\n" + block + b"\n")
        archive.close()
        yield pd.DataFrame(archive.files, columns=["path", "records"])

    return write


def _one_file_per_task(manifest: DataFrame) -> DataFrame:
    """The stored manifest, one file per task; it has one row per archive file."""
    rows = [tuple(row) for row in manifest.select("path", "records").collect()]
    spark = manifest.sparkSession
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), "path string, records bigint")


def write_arc(pages: DataFrame, folder: str, date: str = "20000101000000") -> DataFrame:
    """Write (key, url, payload) rows as ARC files; returns the stored manifest (path, records).

    Odd and even partitions write version 1 and 2.  Null payloads are empty, null urls
    become ``unknown:``, null keys leave out the key header.
    """
    bounded_batches(pages.sparkSession)
    return written(pages.select("key", "url", "payload").mapInPandas(_arc_writer(folder, date), "path string, records bigint"), "arc-manifest")


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError(f"Record ends after {len(data)} of {n} declared bytes")
    return data


def arc_records(stream) -> Iterator[dict]:
    """Records of an opened ARC file: header fields by name, offset and block.

    The version block, which is the first record, names the version; header lines are split
    from the right, as only the URL may hold blanks in files of careless writers.
    """
    fields, at, first = ARC_FIELDS[1], 0, True
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            at += len(line)
            continue
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        length = int(text.rsplit(" ", 1)[1])
        block = _exactly(stream, length)
        naming, first = first and text.startswith("filedesc:"), False
        if naming:
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"Unknown ARC version {version}")
            fields = ARC_FIELDS[version]
        parts = text.rsplit(" ", len(fields) - 1)
        if len(parts) != len(fields):
            raise ValueError(f"ARC header has {len(parts)} of {len(fields)} fields")
        yield dict(zip(fields, parts, strict=True)) | {"offset": at, "block": block, "version_block": naming}
        at += len(line) + length


def _opened(path: str):
    system, name = _system(path)
    return io.BufferedReader(gzip.GzipFile(fileobj=system.open_input_stream(name, compression=None)))


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (blank line included) and entity; a block without a head is all entity."""
    if block.startswith(b"HTTP/"):
        end = block.find(b"\r\n\r\n")
        if end >= 0:
            return block[: end + 4], block[end + 4 :]
    return b"", block


def header_value(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n"):
        label, colon, value = line.partition(b":")
        if colon and label.strip().lower() == name.lower().encode():
            return value.strip().decode()
    return None


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path in frame["path"]:
            rows = []
            with _opened(path) as stream:
                for record in arc_records(stream):
                    if record["version_block"]:
                        continue
                    head, payload = split_http(record["block"])
                    key = header_value(head, KEY_HEADER)
                    rows.append((path, record["offset"], None if key is None else int(key), len(payload), hashlib.sha256(payload).hexdigest()))
                    if len(rows) == 5000:
                        yield _indexed(rows)
                        rows = []
            yield _indexed(rows)


def _indexed(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["path", "offset", "key", "size", "digest"])
    return frame.assign(key=frame["key"].astype("Int64"))


def iso_date(digits: str) -> str:
    """14-digit ARC date as a WARC timestamp; missing trailing digits are the earliest."""
    full = digits + "00000101000000"[len(digits) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(*parts: object) -> str:
    """Identifier made from what names a record, so a repeated conversion makes it again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{name}: {value}" for name, value in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    body = b"software: archive converter\r\nformat: WARC File Format 1.1\r\n"
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", name)), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return warc_record(headers, body)


def as_warc(path: str, record: dict, refers: tuple[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record; ``refers`` is the identifier and digest a revisit points to."""
    head, payload = split_http(record["block"])
    kind = "revisit" if refers else "response" if head else "resource"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(os.path.basename(path), record["offset"])),
        ("WARC-Date", iso_date(record["Archive-date"])),
        ("WARC-Target-URI", record["URL"]),
        ("WARC-IP-Address", record["IP-address"]),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
        ("Content-Type", "application/http; msgtype=response" if head else record["Content-type"]),
    ]
    block = head if refers else record["block"]
    headers.append(("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()))
    if refers:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers[0])]
    return warc_record(headers, block)


def _converter(folder: str):
    def convert(unit: pd.DataFrame) -> pd.DataFrame:
        path = unit["path"].iloc[0]
        decided = {int(row.offset): (row.to_path, row.to_offset) for row in unit.itertuples() if isinstance(row.to_path, str)}
        archive = _Archive(folder, ".warc.gz", _info)
        with _opened(path) as stream:
            for record in arc_records(stream):
                if record["version_block"]:
                    continue
                to = decided.get(record["offset"])
                archive.add(as_warc(path, record, (record_id(os.path.basename(to[0]), int(to[1])), "") if to else None))
        archive.close()
        return pd.DataFrame(archive.files, columns=["path", "records"])

    return convert


def convert(arc: DataFrame, folder: str, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Convert the ARC files of a manifest (path, records); returns the stored WARC manifest.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest
    key stays a response, the others refer to it.  Records without a key refer to a keyed
    equal and are responses if there is none; records that share the smallest key stay responses.
    """
    spark = arc.sparkSession
    index = written(_one_file_per_task(arc).mapInPandas(_index, "path string, offset bigint, key bigint, size bigint, digest string"), "arc-index")
    firsts = (
        index.filter((F.col("size") >= least) & F.col("key").isNotNull())
        .groupBy("digest")
        .agg(F.min(F.struct("key", "path", "offset")).alias("first"))
    )
    known = index.join(firsts, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("size") >= least) & ~F.col("key").eqNullSafe(F.col("first.key"))
    decided = known.select("path", "offset", F.when(again, F.col("first.path")).alias("to_path"), F.when(again, F.col("first.offset")).alias("to_offset"))
    # The decisions are few bytes for many of archive to rewrite, so their size must not set the number of tasks.
    dealt = decided.repartition(max(spark.sparkContext.defaultParallelism, 4 * arc.count()), "path")
    return written(dealt.groupBy("path").applyInPandas(_converter(folder), "path string, records bigint"), "warc-manifest")


def warc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of an opened WARC file."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"Not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        yield headers, _exactly(stream, int(headers["content-length"]))


def _warc_reader(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["record_id", "record_type", "target_uri", "date", "key", "payload", "payload_bytes", "payload_digest", "refers_to_id"]
    for frame in frames:
        for path in frame["path"]:
            rows, held = [], 0
            with _opened(path) as stream:
                for headers, block in warc_records(stream):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    if headers["warc-type"] == "revisit":
                        size, payload = int(header_value(head, "Content-Length") or 0), None
                    else:
                        size = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"Payload digest of {headers['warc-record-id']} does not match")
                    key = header_value(head, KEY_HEADER)
                    rows.append((headers["warc-record-id"], headers["warc-type"], headers.get("warc-target-uri"), headers["warc-date"], None if key is None else int(key), payload, size, digest, headers.get("warc-refers-to")))
                    held += len(payload or b"")
                    if held > 4_000_000 or len(rows) == 2000:
                        yield _keyed(rows, columns)
                        rows, held = [], 0
            yield _keyed(rows, columns)


def _keyed(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    return frame.assign(key=frame["key"].astype("Int64"))


def read_warc(manifest: DataFrame) -> DataFrame:
    """Records of the WARC files of a manifest; payload digests are verified.

    ``refers_to`` is the key of the record that a revisit refers to.
    """
    schema = "record_id string, record_type string, target_uri string, date string, key bigint, payload binary, payload_bytes bigint, payload_digest string, refers_to_id string"
    return _one_file_per_task(manifest).mapInPandas(_warc_reader, schema)


def with_referred_keys(records: DataFrame) -> DataFrame:
    """Append ``refers_to``: the key of the record that a revisit's identifier names."""
    first = F.col("refers_to_id").isNull()
    named = records.filter(first).select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"))
    # Responses refer to nothing; in the join they would all meet under one null key.
    responses = records.filter(first).withColumn("refers_to", F.lit(None).cast("bigint"))
    return responses.unionByName(records.filter(~first).join(named, "refers_to_id", "left"))


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """ARC files from (key, url, payload), converted to WARC and read back, without payloads."""
    folder = scratch_path(spark, "archives")
    warc = convert(write_arc(pages, f"{folder}/arc"), f"{folder}/warc")
    records = written(read_warc(warc).drop("payload"), "warc-records")
    return with_referred_keys(records)
