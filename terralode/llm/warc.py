"""WARC archives compressed record by record with a Zstandard dictionary that each file carries in a leading frame."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.llm._shared import binary, release, small_batches, stash

#: Magic number of the skippable frame that holds the dictionary, and of Zstandard's own frames (fixed by the formats).
DICTIONARY_MAGIC = 0x184D2A5D.to_bytes(4, "little")
#: A dictionary is built from at most so many bytes of a file's first records.
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
#: A file is closed once it has so many compressed bytes, and read in pieces of so many.
FILE_BYTES, READ_BYTES = 16 << 20, 16 << 10
_DATE = "2000-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'urn:page:{page_id}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}", f"Page-Id: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(sample: list[bytes]) -> bytes:
    """A dictionary of a file's first records; plain content of them where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICTIONARY_BYTES:]


class _Writer:
    """One archive at a time, in memory; a full one is written under a name that no other try of the task uses. Only
    those names count that the task returns, which Spark takes from one try of each task."""

    def __init__(self, folder: str, part: int) -> None:
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.root, recursive=True)
        self.prefix, self.names, self.records = f"part-{part:06d}-{uuid.uuid4().hex}", [], []
        self.chunks, self.size, self.count, self.waiting, self.held, self.packer = [], 0, 0, [], 0, None

    def add(self, record: bytes) -> None:
        if self.packer:
            self.put(record)
            return
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= SAMPLE_BYTES:
            self.begin()

    def begin(self) -> None:
        words = _dictionary(self.waiting)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True, write_content_size=True)
        packed = zstandard.ZstdCompressor(level=9).compress(words)
        self.chunks = [DICTIONARY_MAGIC + len(packed).to_bytes(4, "little") + packed]
        self.size = len(self.chunks[0])
        waiting, self.waiting, self.held = self.waiting, [], 0
        for record in waiting:
            self.add(record)  # which waits anew if the file is full by then

    def put(self, record: bytes) -> None:
        self.chunks.append(self.packer.compress(record))
        self.size += len(self.chunks[-1])
        self.count += 1
        if self.size >= FILE_BYTES:
            self.flush()

    def close(self) -> None:
        if self.waiting:
            self.begin()
        self.flush()

    def flush(self) -> None:
        if self.packer:
            name = f"{self.prefix}-{len(self.names):04d}.warc.zst"
            with self.files.open_output_stream(f"{self.root}/{name}", compression=None) as out:
                for chunk in self.chunks:
                    out.write(chunk)
            self.names.append(name)
            self.records.append(self.count)
        self.chunks, self.size, self.count, self.packer = [], 0, 0, None


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for part, page_id, url, payload, digest, kind, refers in zip(*batch.columns, strict=True):
                writer = writer or _Writer(folder, part.as_py())
                writer.add(_record(page_id.as_py(), url.as_py(), payload.as_py() or b"", base64.b32encode(bytes.fromhex(digest.as_py())).decode(), kind.as_py(), refers.as_py()))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array(writer.names, pa.string()), pa.array(writer.records, pa.int64())], names=["file", "records"])

    return run


def records_of(archive: BinaryIO) -> Iterator[bytes]:
    """The records of an archive in turn, each decompressed by itself with the archive's own dictionary; only the record
    at hand is in memory."""
    unpack, rest = zstandard.ZstdDecompressor(), archive.read(8)
    if rest[:4] == DICTIONARY_MAGIC:
        words = zstandard.ZstdDecompressor().decompress(archive.read(int.from_bytes(rest[4:8], "little")))
        unpack, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)), b""
    while rest := rest or archive.read(READ_BYTES):
        one, parts = unpack.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                break
            if not (rest := archive.read(READ_BYTES)):
                raise ValueError("an archive ends within a record")
        yield b"".join(parts)
        rest = one.unused_data


def parse_record(record: bytes) -> dict:
    """The fields of a record that this module writes, with its payload; raises ValueError if a digest doesn't hold."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if fields["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}" or (kind == "response" and (payload_digest(payload) != digest or len(payload) != size)):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't hold its digest")
    number = lambda key: int(x) if (x := fields.get(key)) else None
    return {
        "page_id": number("Page-Id"), "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": number("Refers-To-Page-Id"),
    }


_MANIFEST = "file string, records long"
_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_TYPES = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())


def _parsed(folder: str, payloads: bool):
    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(rows[0], _TYPES, strict=True)], names=list(rows[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0):
                rows, size = [], 0
                with files.open_input_stream(f"{root}/{name.as_py()}", compression=None) as archive:
                    for record in records_of(archive):
                        rows.append(parse_record(record) | ({} if payloads else {"payload": None}))
                        size += len(record) if payloads else 200
                        if size >= 1 << 20:
                            yield table(rows)
                            rows, size = [], 0
                if rows:
                    yield table(rows)

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes a record for each page into .warc.zst files in folder, an URI that all executors share, at once, and returns
    their manifest (file, records), which is kept in the folder as a table.

    Of records with equal payloads of at least `least` bytes, that with the largest id is the response and the others
    revisit it; smaller ones are all responses. Payloads are equal if their lengths, SHA-1 and SHA-256 are; they are
    counted before the shuffle. Every file starts with a skippable frame that holds its dictionary, trained on its own first
    records (SAMPLE_BYTES), and each record is a frame of its own. A task holds one file of FILE_BYTES in memory. What a
    failed or doubled try of a task wrote stays in the folder, and isn't in the manifest, which alone is read.

    Nulls: a null html is an empty payload; a null url gets a URN of the page; a page with a null id is a response to
    which nothing refers. Rows that share the largest id of a payload are all responses. Other columns are ignored and
    may have any names. An empty table writes nothing and has an empty manifest.
    """
    payload, equal = F.coalesce(binary(html_col), F.lit(b"")), ["digest", "strong", "size"]
    base = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    base = base.withColumns({"digest": F.sha1("payload"), "strong": F.sha2("payload", 256), "size": F.length("payload")})
    firsts = base.where(F.col("size") >= least).groupBy(*equal).agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    firsts = stash(firsts.where("n > 1").select(*equal, "first"), "payloads")
    known = base.join(firsts, equal, "left")
    again = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first"))
    rows = known.select(
        F.spark_partition_id().cast("long").alias("part"), "page_id", "url", "payload", "digest",
        F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"),
    )
    manifest = f"{folder.rstrip('/')}/manifest"
    rows.mapInArrow(_written(folder), _MANIFEST).write.parquet(manifest)
    release(firsts)
    return pages.sparkSession.read.schema(_MANIFEST).parquet(manifest)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives in folder's manifest: (page_id, url, payload, payload_bytes, payload_digest,
    record_type, refers_to); digests are checked. payload is empty for a revisit, and null if payloads are not asked
    for. A task reads some files, a record at a time."""
    files = spark.read.schema(_MANIFEST).parquet(f"{folder.rstrip('/')}/manifest").select("file")
    return files.repartition("file").mapInArrow(_parsed(folder, payloads), _READ)
