"""WARC archives as a PySpark data source.

Files are `.warc.gz`: each record is a gzip member of its own, whose extra field `sl` holds the member's length. A reader
inflates a record's head, tests the pushed filters on it, and passes over the rest of an unwanted record, or of any record
when payloads aren't asked for, without inflating it. Members without that field, and files without compression, are read
too. Files are planned into partitions by size; each is read as a stream, a record at a time.

Writing is in two steps: tasks write files under names that readers ignore, and only the files of successful tasks get their
names when the job commits.

Null URLs are left out of the record, null payloads are empty, line breaks in a header value become spaces. Empty input
makes no file; a folder without archives reads as no rows. Folders are read with all below them; a path can be one file too. Payloads of any length are held one at a time.
A record whose head breaks off or doesn't tell a length is passed over, with what follows up to the next record; digests that aren't Base32 or hex stay as
they are. Rows that share an id have records of different names, unless URL and payload are the same too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from textloom.llm.shared import checkpoint_folder, file_system

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: What each column of the schema is called in a record's head.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 4 << 20
CHUNK = 1 << 16
#: Digests (with a name some 150 bytes) that are broadcast.
MOST_DIGESTS = 300_000
#: Bytes of a head; what is longer isn't one.
LONGEST_HEAD = 1 << 20
SUFFIX = (".warc.gz", ".warc")


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member that tells its own length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HccHI", 8, b"s", b"l", 4, 20 + len(body) + 8)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """A response with its payload, or a revisit without; both with the HTTP head that tells the payload's length."""
    payload, kind = row["payload"] or b"", row["record_type"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    lines = [("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", f"sha1:{digest}")]
    lines += [("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", REVISIT)] if kind == "revisit" else []
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {re.sub('[\r\n]+', ' ', v)}\r\n" for k, v in lines if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def whole_number(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdigit() else None


def parsed_head(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


class Archive:
    """The records of a file in order: `head`, and `body(n)` for the next n bytes of the record's block, if called."""

    def __init__(self, source, packed: bool):
        self.source, self.packed = source, packed
        self.at = 0
        self.waiting = b""

    def _more(self) -> bytes:
        self.source.seek(self.at)
        data = self.source.read(CHUNK)
        self.at += len(data)
        return data

    def records(self) -> Iterator[dict[str, str]]:
        while True:
            start = self.at
            first = self._more()
            if not first:
                return
            if self.packed:
                length = self._told_length(first)
                self.inflate, self.rest, self.out = zlib.decompressobj(31), first, b""
            else:
                self.rest, self.out, length = b"", first.lstrip(b"\r\n"), None
                if not self.out:
                    continue
            text = self._until(b"\r\n\r\n")
            head = parsed_head(text or b"")
            told = whole_number(head.get("content-length"))
            self.left = told or 0
            if told is not None:
                yield head
            if length is not None:
                self.at = start + length
            elif self.packed:
                while not self.inflate.eof and self._pull():
                    self.out = b""
                self.at -= len(self.inflate.unused_data)
            elif told is not None:
                self.at += self.left - len(self.out) + 4
            else:
                self._to_next(start + 1)

    def _to_next(self, at: int) -> None:
        """Go on at the next line that begins like a record."""
        self.at, tail = at, b""
        while data := self._more():
            found = (tail + data).find(b"\nWARC/1.")
            if found >= 0:
                self.at += found + 1 - len(tail) - len(data)
                return
            tail = (tail + data)[-7:]

    @staticmethod
    def _told_length(first: bytes) -> int | None:
        if len(first) >= 20 and first[3] & 4:
            size = struct.unpack_from("<H", first, 10)[0]
            at = 12
            while at + 4 <= 12 + size:
                name, n = first[at : at + 2], struct.unpack_from("<H", first, at + 2)[0]
                if name == b"sl" and n == 4:
                    return struct.unpack_from("<I", first, at + 4)[0]
                at += 4 + n
        return None

    def _pull(self) -> bool:
        """Get more of the record; False at its end."""
        if not self.packed:
            data = self._more()
            self.out += data
            return bool(data)
        if self.inflate.eof:
            return False
        if not self.rest:
            self.rest = self._more()
            if not self.rest:
                return False
        self.out += self.inflate.decompress(self.rest, CHUNK)
        self.rest = self.inflate.unconsumed_tail
        return True

    def _until(self, mark: bytes) -> bytes | None:
        """What comes before the mark; None if the record ends before it, or its head is longer than any is."""
        while mark not in self.out:
            if len(self.out) > LONGEST_HEAD or not self._pull():
                return None
        head, _, self.out = self.out.partition(mark)
        return head

    def body(self) -> bytes:
        """The whole block."""
        parts, size = [self.out], len(self.out)
        self.out = b""
        while size < self.left and self._pull():
            parts.append(self.out)
            size += len(self.out)
            self.out = b""
        block = b"".join(parts)
        self.out, self.left = block[self.left :], 0
        return block[: size - len(self.out)]

    def http_head(self) -> dict[str, str]:
        """The HTTP head that begins the block; what it takes is no longer part of body()."""
        while b"\r\n\r\n" not in self.out and len(self.out) < self.left and self._pull():
            pass
        head, mark, rest = self.out.partition(b"\r\n\r\n")
        if not mark or len(head) + 4 > self.left:
            return {}
        self.out = rest
        self.left -= len(head) + 4
        return parsed_head(head)


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int]] = field(default_factory=list)


class WarcReader(DataSourceReader):
    """Options: path; payload (true: read payloads; verify: also hold them against their digest; false: leave them null)."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower()
        self.size = int(options.get("partition_bytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith | StringContains):
                self.tests.append((name, type(f).__name__, f.value))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, "IsNotNull", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        fs, top = file_system(self.path)
        one = fs.get_file_info(top)
        listed = [one] if one.is_file else fs.get_file_info(pafs.FileSelector(top, allow_not_found=True, recursive=True))
        found = sorted((i for i in listed if i.is_file and i.base_name.endswith(SUFFIX) and not i.base_name.startswith((".", "_"))), key=lambda i: -i.size)
        out: list[Files] = []
        used = self.size
        for i in found:
            if used + i.size > self.size or not out:
                out.append(Files([]))
                used = 0
            out[-1].names.append((i.path, i.size))
            used += i.size
        return out or [Files([])]

    def wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            own = row[name]
            if own is None:
                return False
            if kind == "EqualTo" and own != value or kind == "In" and own not in value:
                return False
            if kind == "StringStartsWith" and not own.startswith(value) or kind == "StringEndsWith" and not own.endswith(value) or kind == "StringContains" and value not in own:
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        rows, size = [], 0
        for path, _ in partition.names:
            with fs.open_input_file(path) as source:
                archive = Archive(source, path.endswith(".gz"))
                for head in archive.records():
                    row = {c: head.get(h) for c, h in HEADERS.items()}
                    row["payload_digest"] = plain_digest(row["payload_digest"])
                    if not self.wanted(row):
                        continue
                    row["payload"] = row["payload_bytes"] = None
                    if row["record_type"] in ("response", "revisit"):
                        told = whole_number(archive.http_head().get("content-length"))
                        row["payload_bytes"] = archive.left if told is None else told
                        if self.payload != "false" and row["record_type"] == "response":
                            row["payload"] = archive.body()
                            if self.payload == "verify":
                                if hashlib.sha1(row["payload"]).hexdigest() != row["payload_digest"] or len(row["payload"]) != row["payload_bytes"]:
                                    raise ValueError(f"{row['record_id']} in {path} isn't what its head tells")
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)


def plain_digest(value: str | None) -> str | None:
    """Lower-case hex of `sha1:` and Base32 or hex; other algorithms stay as they are."""
    if value and value.lower().startswith("sha1:"):
        own = value[5:]
        if re.fullmatch("[0-9A-Fa-f]{40}", own):
            return own.lower()
        try:
            return base64.b32decode(own.upper()).hex()
        except ValueError:
            return value
    return value


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.record_batch([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in NAMES], NAMES)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Options: path; file_bytes, at which a task begins another file."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("file_bytes", 256 << 20))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, top = file_system(self.path)
        names, sink, size = [], None, 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if sink is None:
                    fs.create_dir(top, recursive=True)
                    names.append(f"{top}/_{uuid.uuid4().hex}.warc.gz")
                    sink, size = fs.open_output_stream(names[-1], compression=None), 0
                data = member(record(row))
                sink.write(data)
                size += len(data)
                if size >= self.most:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = file_system(self.path)
        for name in (n for m in messages if m for n in m.files):
            folder, _, base = name.rpartition("/_")
            fs.move(name, f"{folder}/{base}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = file_system(self.path)
        for name in (n for m in messages if m for n in m.files):
            fs.delete_file(name)


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(folder), df.write.format("warc").mode("append").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are appended to, never overwritten")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records_of(pages: DataFrame, id_column: str = "page_id", least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record for each page. Of equal payloads of at least `least` bytes the one with the largest id is the response.

    The digests of equal payloads and their largest ids are counted: few go to where the pages are, so that no payload moves. Beyond
    MOST_DIGESTS they are joined. Equal payloads may be a third of all: the maximum is combined before the shuffle, and a checkpoint
    too, for Spark splits a join where a digest has too many rows only if both its sides are plain shuffles. Payloads of revisits are dropped there.
    """
    checkpoint_folder(pages.sparkSession)
    own = pages.select(F.col(id_column).cast("long").alias("id"), F.col("url").cast("string").alias("target_uri"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    own = own.select("*", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    own = own.select("*", F.concat(F.coalesce(F.col("id").cast("string"), F.uuid()), F.lit(":"), F.hex(F.xxhash64("target_uri", "payload_digest"))).alias("name"))
    key = F.when(F.col("payload_bytes") >= least, F.col("payload_digest")).otherwise(F.concat(F.lit("small "), "name")).alias("key")
    first = own.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("key")).agg(F.max(F.struct("id", "name")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first.id IS NOT NULL").drop("n").checkpoint()
    joined = own.select("*", key).join(F.broadcast(first) if first.count() <= MOST_DIGESTS else first, "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    urn = lambda name: F.concat(F.lit("<urn:textloom:page:"), name, F.lit(">"))
    return joined.select(
        urn(F.col("name")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        "payload_digest",
        "payload_bytes",
        F.when(revisit, urn(F.col("first.name"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_of(name: str):
    """The id in a record's name, null if it has none."""
    return F.expr(f"try_cast(regexp_extract({name}, 'page:(-?[0-9]+):[0-9A-F]+>$', 1) AS bigint)")
