"""Raw payloads in web archive files: written by tasks, read back by byte ranges."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.frames import local_path, staged

MIN_REVISIT_BYTES = 100
ROLL_BYTES = 1 << 27
SPLIT_BYTES = 1 << 23
HEAD_STEP = 1 << 16
# Tasks of one read; a task takes several ranges beyond it.
MAX_TASKS = 50_000

# The archive format's words.
VERSION = b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
_BREAK = b"\r\n"

_FILES = "path string, n_bytes bigint, n_records bigint"
_RECORDS = ("raw_payload_id string, original_basename string, record_type string, "
            "refers_to string, byte_length bigint, content_sha256 string, content binary")


def with_record_types(raw_payloads: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """Payloads with digest, length, and the response that a copy refers to.

    Of equal payloads the smallest raw_payload_id is the response. Only digests that occur more
    than once enter the join, one row each.
    """
    content = F.coalesce(F.col("content"), F.lit(b""))
    facts = raw_payloads.select("raw_payload_id", "original_basename", content.alias("content")
                                ).withColumns({
        "content_sha256": F.sha2(F.col("content"), 256),
        "byte_length": F.length("content").cast("bigint"),
    })
    first = (
        facts.filter(F.col("byte_length") >= min_revisit_bytes)
        .groupBy("content_sha256")
        .agg(F.min("raw_payload_id").alias("response_id"), F.count("*").alias("_n"))
        .filter("_n > 1").drop("_n")
    )
    # Staged, so that the join's two sides are plain exchanges and a hot digest's side can be split.
    joined = facts.join(staged(first, "first-payloads"), "content_sha256", "left")
    own = F.col("raw_payload_id")
    return joined.withColumns({
        "refers_to": F.when(~own.eqNullSafe(F.col("response_id")), F.col("response_id").cast("string")),
        "raw_payload_id": own.cast("string"),
    }).drop("response_id")


def record_bytes(payload_id, basename, content: bytes, digest: str, refers_to) -> bytes:
    """One record: headers, and for a response the whole payload behind an HTTP head."""
    head = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        "WARC-Date: 1970-01-01T00:00:00Z",
    ]
    if payload_id is not None:
        head.append(f"WARC-Record-ID: <urn:raw-payload:{quote(payload_id, safe='')}>")
    if basename is not None:
        head.append(f"WARC-Target-URI: {quote(basename, safe=':/?#[]@!$&()*+,;=%~')}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(content)}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block += content
    else:
        head += [f"WARC-Refers-To: <urn:raw-payload:{quote(refers_to, safe='')}>",
                 f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + 2 * _BREAK + block + 2 * _BREAK


def _write(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        system, root = local_path(folder)
        stream, path, size, records, number = None, "", 0, 0, 0

        def done():
            stream.close()
            return pd.DataFrame([(path, size, records)], columns=["path", "n_bytes", "n_records"])

        for rows in batches:
            for r in rows.itertuples(index=False):
                if stream is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:05d}.warc.gz"
                    if number == 0:
                        system.create_dir(root, recursive=True)
                    path, size, records, number = f"{root}/{name}", 0, 0, number + 1
                    stream = system.open_output_stream(path, compression=None)
                refers = None if pd.isna(r.refers_to) else r.refers_to
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = squeeze.compress(record_bytes(
                    r.raw_payload_id, r.original_basename, bytes(r.content), r.content_sha256, refers))
                member += squeeze.flush()
                stream.write(member)
                size += len(member)
                records += 1
                if size >= ROLL_BYTES:
                    yield done()
                    stream = None
        if stream is not None:
            yield done()
    return run


def write_payload_archive(raw_payloads: DataFrame, folder: str,
                          min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record for every payload; returns the written files (path, n_bytes, n_records).

    ``raw_payloads`` has raw_payload_id (of any ordered type; text in the archive),
    original_basename and content (bytes). Of payloads with
    equal bytes, at least ``min_revisit_bytes`` of them, that with the smallest raw_payload_id is
    stored whole, the others as revisits that refer to it; smaller payloads are all stored.
    Every record is a gzip member of its own. A task names its files by its attempt, and only the
    files of attempts that succeeded are in the result, so lost executors leave no half file in it.

    Null content is stored as empty; a null id or basename leaves out its header; rows that repeat an
    id are written each, and equal copies of the response are responses too. An empty table writes no file.
    """
    typed = with_record_types(raw_payloads, min_revisit_bytes)
    columns = ["raw_payload_id", "original_basename", "content", "content_sha256", "refers_to"]
    return staged(typed.select(*columns).mapInPandas(_write(folder), _FILES), "archive-files")


class _Window:
    """A file read forward in pieces, with bytes addressed by their place in the file."""

    def __init__(self, handle, size: int, step: int = 1 << 20):
        self.handle, self.size, self.step = handle, size, step
        self.at, self.data = 0, b""

    def bytes_at(self, place: int, count: int) -> bytes:
        count = max(0, min(count, self.size - place))
        if not (self.at <= place and place + count <= self.at + len(self.data)):
            self.at = place
            self.data = self.handle.read_at(min(max(count, self.step), self.size - place), place)
        return self.data[place - self.at:place - self.at + count]


def _headers(block: bytes) -> dict[str, str] | None:
    """Named fields of a record's head; None if it is no such head."""
    head, mark, _ = block.partition(2 * _BREAK)
    if not mark or not head.startswith(VERSION):
        return None
    fields = {}
    for line in head.split(_BREAK)[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def _starts_record(window: _Window, place: int) -> bool:
    """Whether a member here decodes to a record's head, read on to the blank line that ends it."""
    if window.bytes_at(place, 3) != MAGIC:
        return False
    inflate, head, at = zlib.decompressobj(31), bytearray(), place
    while not inflate.eof:
        data = inflate.unconsumed_tail
        if not data:
            data = window.bytes_at(at, HEAD_STEP)
            at += len(data)
        try:
            part = inflate.decompress(data, HEAD_STEP)
        except zlib.error:
            return False
        if not data and not part:
            return False
        seen = max(0, len(head) - len(2 * _BREAK))
        head += part
        if not head.startswith(VERSION[:len(head)]):
            return False
        if head.find(2 * _BREAK, seen) >= 0:
            return _headers(bytes(head)) is not None
    return False


def _member(window: _Window, place: int) -> tuple[bytes, int] | None:
    """(decoded bytes, where the next member starts), or None if it doesn't decode to its end."""
    inflate, parts, at = zlib.decompressobj(31), [], place
    while not inflate.eof:
        block = window.bytes_at(at, window.step)
        if not block:
            return None
        try:
            parts.append(inflate.decompress(block))
        except zlib.error:
            return None
        at += len(block)
    return b"".join(parts), at - len(inflate.unused_data)


def owned_records(handle, size: int, start: int, end: int) -> Iterator[bytes]:
    """Decoded records that start in [start, end) of a file.

    The range is scanned for gzip magic, and a candidate counts only if its head decodes to record
    headers and its member to the end, checksum included. From there on, each member's end is the
    next one's start. A break in that chain starts the scan again behind it.
    """
    window, place = _Window(handle, size), start
    end = min(end, size)
    while place < end:
        if not _starts_record(window, place):
            block = window.bytes_at(place + 1, min(window.step, end + len(MAGIC) - place))
            found = block.find(MAGIC)
            if found >= 0:
                place += 1 + found
            else:
                place += max(1, len(block) - len(MAGIC) + 1)
            continue
        member = _member(window, place)
        if member is None:
            place += 1
            continue
        yield member[0]
        place = member[1]


def parse_record(record: bytes) -> tuple:
    fields = _headers(record)
    body = record.index(2 * _BREAK) + 4
    block = record[body:body + int(fields["content-length"])]

    def name(field: str) -> str | None:
        value = fields.get(field)
        return None if value is None else unquote(value.strip("<>").rpartition(":")[2])

    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    uri = fields.get("warc-target-uri")
    content = None
    length = int(fields.get("warc-payload-length", 0))
    if fields["warc-type"] == "response":
        content = block.partition(2 * _BREAK)[2]
        length = len(content)
        if hashlib.sha256(content).hexdigest() != digest:
            raise ValueError(f"payload digest of record {name('warc-record-id')} does not hold")
    return (name("warc-record-id"), None if uri is None else unquote(uri), fields["warc-type"],
            name("warc-refers-to"), length, digest, content)


def _read(with_content: bool):
    names = [c.split()[0] for c in _RECORDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ranges in batches:
            for r in ranges.itertuples(index=False):
                system, path = local_path(r.path)
                rows, held = [], 0
                with system.open_input_file(path) as handle:
                    for record in owned_records(handle, int(r.n_bytes), r.range_start, r.range_end):
                        row = parse_record(record)
                        rows.append(row if with_content else (*row[:-1], None))
                        held += len(record) if with_content else 200
                        if held >= 1 << 24:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)
    return run


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every archive file under a folder (path, n_bytes), content unread."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz")
        .option("recursiveFileLookup", "true").load(folder)
        .select("path", F.col("length").alias("n_bytes"))
    )


def read_payload_archive(files: DataFrame, split_bytes: int = SPLIT_BYTES,
                         with_content: bool = True) -> DataFrame:
    """Records of archive files (path, n_bytes), each file read by many tasks.

    Every ``split_bytes`` of a file are a range of their own. A task owns the records that start
    inside its range and reads past its end to finish the last. Returns raw_payload_id,
    original_basename, record_type, refers_to, byte_length and content_sha256 of the full payload,
    and content (null for a revisit, or without ``with_content``). A response whose bytes do not
    have the digest in its header fails the job. Files without records give no row.
    """
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bytes") - 1,
                                 F.lit(split_bytes).cast("bigint")))
    some = files.filter("n_bytes > 0")
    n_ranges = some.agg(F.sum(F.ceil(F.col("n_bytes") / split_bytes))).first()[0] or 1
    ranges = some.select("path", "n_bytes", start.alias("range_start"))
    ranges = ranges.withColumn("range_end", F.col("range_start") + split_bytes)
    # With a number of its own, as the few bytes of these rows would be merged into one task.
    dealt = ranges.repartition(min(int(n_ranges), MAX_TASKS), "path", "range_start")
    return dealt.mapInPandas(_read(with_content), _RECORDS)
