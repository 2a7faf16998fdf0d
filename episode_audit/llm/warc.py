"""WARC archives compressed with Zstandard: writing, and reading record by record.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
compression dictionary; then every record is a frame of its own, so a record can
be decoded knowing only the dictionary. The dictionary is trained on a bounded
sample of the pages (`SAMPLE` pages, those with the lowest hash of their id); a
sample too small to train on gives a dictionary of the fixed header lines.

Writing. Of records with equal payloads of at least `smallest` bytes the one
with the smallest page id is a response, the others are revisits that name it
and hold its HTTP header only. A task writes its archives part by part (a new one
from `ARCHIVE_BYTES` on) under a name of its own and renames each when it is
whole, so a task that is tried again replaces what it wrote. The target is a
folder that all executors share, by any address pyarrow's file systems know.

Reading. The files are spread by Spark's binary reader. Version line, mandatory
fields, record length, the two closing line breaks, the HTTP length and the
payload's digest are checked; the first fault of a record is named in `problem`
(null: sound). A file that cannot be split into frames gives one row with the
fault.

A null page counts as empty; a null id is written as such and never refers to
anything (it is the response where no row of its group has an id). Rows that
repeat an id and a payload are all responses. A null URL leaves its field out;
control characters in URLs are percent-encoded. An empty table gives no archive
and no rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import quoted

# Fixed values of the formats.
DICTIONARY_MAGIC, SKIPPABLE = 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PAGE_URN = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"
SAMPLE, LONGEST, DICTIONARY_BYTES = 200, 60_000, 32_768
ARCHIVE_BYTES, CHUNK, LEVEL = 8 << 20, 1 << 14, 3
BROADCAST_ROWS = 500_000  # digests of repeated payloads sent to every task at most; beyond it a shuffled join


def b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit where refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{PAGE_URN}{'null' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + b32(hashlib.sha1(payload).digest())),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{PAGE_URN}{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """Trained on records; the fixed lines alone where there are too few."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return record(0, "http://www.example.com/", b"", None) + record(0, "https://www.example.com/", b"<!DOCTYPE html><html><head>", None)


def folder_of(address: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    if address.startswith("file:"):
        address = address.removeprefix("file:").lstrip("/")
        return fs.LocalFileSystem(), f"/{address}"
    return fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)


def revisits(pages: DataFrame, id_col: str, html_col: str, smallest: int) -> DataFrame:
    """digest, first: the smallest page id of every payload that several rows have."""
    body = F.coalesce(quoted(html_col), F.lit(""))
    rows = pages.where(F.octet_length(body) >= smallest).select(F.unhex(F.sha1(body)).alias("digest"), quoted(id_col).alias("id"))
    groups = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut_lineage(groups.select("digest", "first"))


def write_archives(
    pages: DataFrame, address: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smallest: int = 0
) -> int:
    """Write a record for every row below `address`; returns the number of records."""
    body = F.coalesce(quoted(html_col).cast("string"), F.lit(""))
    order = F.xxhash64(quoted(id_col).cast("string"))
    sample = pages.where(F.char_length(body) <= LONGEST).orderBy(order, body).limit(SAMPLE).select(quoted(id_col).alias("i"), quoted(url_col).alias("u"), body.alias("b"))
    words = dictionary([record(r.i, r.u, r.b.encode(), None) for r in sample.collect()])

    repeated = revisits(pages, id_col, html_col, smallest)
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    rows = pages.select(quoted(id_col).cast("long").alias("id"), quoted(url_col).cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html"))).join(repeated, "digest", "left")
    long_enough = F.octet_length("html") >= smallest
    rows = rows.select("id", "url", "html", F.when(long_enough & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, base = folder_of(address)
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words))
        task, written, part, out, name = TaskContext.get().partitionId(), 0, 0, None, ""

        def finish() -> None:
            nonlocal out, part
            out.close()
            files.move(name, f"{base}/part-{task:06d}-{part:04d}.warc.zst")
            out, part = None, part + 1

        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    files.create_dir(base, recursive=True)
                    name, size = f"{base}/.{uuid.uuid4().hex}", 0
                    out = files.open_output_stream(name)
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words)
                frame = coder.compress(record(row["id"], row["url"], row["html"].encode(), row["refers_to"]))
                out.write(frame)
                size, written = size + len(frame), written + 1
                if size >= ARCHIVE_BYTES:
                    finish()
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["records"])

    return rows.mapInArrow(run, "records long").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]


def frames(data: bytes) -> Iterator[bytes | Exception]:
    """Every record of an archive, decoded with the dictionary of the leading frame; a fault in place of a broken one."""
    import zstandard

    at, words = 0, None
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic in SKIPPABLE:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut off")
            if magic == DICTIONARY_MAGIC and at == 0:
                words = data[8 : 8 + size]
                if words[:4] == FRAME_MAGIC:
                    words = zstandard.ZstdDecompressor().decompress(words, max_output_size=1 << 27)
            at += 8 + size
            continue
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
        break
    while at < len(data):
        if int.from_bytes(data[at : at + 4], "little") in SKIPPABLE:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        frame, out, start = decoder.decompressobj(), [], at
        try:
            while not frame.eof:
                piece = data[at : at + CHUNK]
                if not piece:
                    raise ValueError("the last frame is cut off")
                out.append(frame.decompress(piece))
                at += len(piece)
            at -= len(frame.unused_data)
        except (ValueError, zstandard.ZstdError) as fault:
            # a broken frame is one broken record: go on where the next frame begins
            yield fault
            after = data.find(FRAME_MAGIC, start + 4)
            at = after if after >= 0 else len(data)
            continue
        yield b"".join(out)


def number_of(digits: str | bytes) -> int | None:
    """A number of ASCII digits that fits 63 bits, else None."""
    if not digits.isascii() or not digits.isdigit() or len(digits.lstrip("0" if isinstance(digits, str) else b"0")) > 19:
        return None
    number = int(digits[-20:])
    return number if number < 1 << 63 else None


def page_of(field: str | None) -> int | None:
    found = (field or "").strip("<>").removeprefix(PAGE_URN)
    number = number_of(found.removeprefix("-"))
    return None if number is None else -number if found.startswith("-") else number


def parse(raw: bytes) -> dict:
    """The fields of a record and its first fault."""
    out = dict.fromkeys(("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "problem"))
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            return out | {"problem": "a header line has no colon"}
        fields[key.strip().lower()] = value.strip()
    if not gap or lines[0] != VERSION:
        return out | {"problem": "no version line"}
    missing = [m for m in MANDATORY if m.lower() not in fields]
    if missing:
        return out | {"problem": f"no {missing[0]}"}
    out |= {"page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"]}
    out |= {"payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": page_of(fields.get("warc-refers-to"))}
    length = number_of(fields["content-length"])
    if length is None or len(rest) != length + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"problem": "the record's length is not what it says"}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    stated = [v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"]
    if not gap or len(stated) != 1 or number_of(stated[0]) is None:
        return out | {"problem": "no HTTP length"}
    out["payload_bytes"] = number_of(stated[0])
    if out["record_type"] == "response":
        out["payload"] = payload
        if len(payload) != out["payload_bytes"]:
            return out | {"problem": "the payload's length is not what it says"}
        if b32(hashlib.sha1(payload).digest()) != out["payload_digest"]:
            return out | {"problem": "the payload's digest is not what it says"}
    elif out["record_type"] == "revisit":
        if payload or out["refers_to"] is None or fields.get("warc-profile") != REVISIT_PROFILE:
            return out | {"problem": "a revisit without profile or target, or with a payload"}
    return out


def read_archives(spark: SparkSession, address: str, payloads: bool = True) -> DataFrame:
    """A row per record of all archives below `address`."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())]
    kinds = [k for k in kinds if payloads or k[0] != "payload"]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                try:
                    for raw in frames(data.as_py()):
                        if isinstance(raw, Exception):
                            rows.append({"problem": f"{path}: {raw}"})
                            continue
                        found = parse(raw)
                        rows.append({k: found[k] for k, _ in kinds})
                        size += len(raw)
                        if size >= ARCHIVE_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                except Exception as fault:  # noqa: BLE001 - a broken file is reported as a row
                    rows.append({"problem": f"{path}: {fault}"})
                yield pa.RecordBatch.from_pylist(rows, schema)

    columns = ", ".join(f"{k} {'binary' if k == 'payload' else 'long' if k in ('page_id', 'payload_bytes', 'refers_to') else 'string'}" for k, _ in kinds)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(address)
    return files.select("path", "content").mapInArrow(run, columns)
