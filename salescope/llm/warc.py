"""WARC archives with a two-level capture index (operator 10).

Pages become WARC/1.1 records, each a gzip member of its own, in one archive
per task. The capture index has two levels: lines sorted by reversed-host URL
key in compressed blocks, and a sparse directory with the first key and place
of each block, kept beside each index file. A search of sorted keys bisects the list
of index files, then a file's directory, then the lines of one block, and reads the
record by its byte range. One URL is searched on the driver, a table of URLs in tasks.
"""

from __future__ import annotations

import bisect
import datetime as dt
import functools
import gzip
import hashlib
import json
import posixpath
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, scratch_path, write_table

#: Payloads below so many bytes are never revisits.
MIN_REVISIT_BYTES = 100
#: Lines of a compressed index block.
BLOCK_LINES = 3000
#: Files of an index at most; a search holds one short key for each.
INDEX_FILES = 16384
#: Directories hold so many characters of a block's first key; keys that agree in
#: them are told apart inside the blocks.
KEY_CHARACTERS = 256
#: An archive is closed, and the next begun, beyond so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Reading goes in units of so many bytes of an archive.
READ_BYTES = 16 << 20
_GZIP_LEVEL = 6


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed and joined by commas, ")", and the
    rest; scheme dropped, host in lower case. Null is empty."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(url, "(?s)^[^/?#]*?://", "")
    host = F.lower(F.regexp_extract(rest, "(?s)^[^/?#]*", 0))
    return F.concat(
        F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.substring(rest, F.length(host) + 1, 1 << 30)
    )


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, bytes, refers_to of ``pages``.

    Of equal payloads of at least :data:`MIN_REVISIT_BYTES` bytes the smallest
    page_id is the response. The minimum is taken with map-side aggregation
    over digests only; a digest that many pages share is one row to join. Null
    html is an empty payload. Rows that repeat the smallest page_id are all
    responses; a null page_id revisits any other with its payload.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    hashed = pages.select(
        "page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes")
    )
    first = (
        hashed.where(F.col("bytes") >= MIN_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    first = write_table(first, "digests")
    return hashed.join(first, "digest", "left").select(
        "page_id",
        "url",
        F.when(
            F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(None).cast("string")
        ).otherwise(F.coalesce("html", F.lit(""))).alias("html"),
        "digest",
        "bytes",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )


def record_id(page_id, digest: str) -> str:
    """A record's id. Rows that repeat both page_id and payload have the same one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{json.dumps(page_id)}:{digest}')}>"


# Fixed value: the characters that stay as they are in a URI.
_URI_CHARACTERS = "!#$%&'()*+,/:;=?@[]~"


def record_bytes(page_id, url: str | None, body: bytes | None, digest: str, size: int, refers_to, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit without.

    The target URI is the url with white space, control and non-ASCII characters
    escaped; where that changes it, or it is null or empty (``about:blank``), an
    extension field holds its exact text.
    """
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (body or b"")
    target = urllib.parse.quote(url, safe=_URI_CHARACTERS) if url else "about:blank"
    header = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "X-Payload-Length": str(size),
        "X-Page-ID": json.dumps(page_id),
    }
    if target != url:
        header["X-Target-Text"] = json.dumps(url)
    if refers_to is not None:
        header["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        header["WARC-Refers-To"] = record_id(refers_to, digest)
        header["X-Refers-To-Page-ID"] = json.dumps(refers_to)
    header["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in header.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes, keep_payload: bool = True) -> dict:
    """page_id, url, type, refers_to, digest, size and payload of a record. The
    payload of a response is hashed again and checked against its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    header = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(header["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind = header["WARC-Type"]
    told = header["WARC-Payload-Digest"].partition(":")[2]
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else told
    size = len(payload) if kind == "response" else int(header["X-Payload-Length"])
    if digest != told or size != int(header["X-Payload-Length"]):
        raise ValueError(f"payload of record {header['WARC-Record-ID']} does not match its header")
    text = header.get("X-Target-Text")
    return {
        "page_id": json.loads(header["X-Page-ID"]),
        "url": header["WARC-Target-URI"] if text is None else json.loads(text),
        "type": kind,
        "refers_to": json.loads(header["X-Refers-To-Page-ID"]) if kind == "revisit" else None,
        "digest": digest,
        "size": size,
        "payload": payload if kind == "response" and keep_payload else None,
    }


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def write_archives(captured: DataFrame, folder: str, date: dt.datetime | None = None) -> DataFrame:
    """Write ``captured`` (see :func:`captures`) into archives under ``folder``, a
    shared folder, and return their index lines: key, page_id, file, start, length.
    ``date`` is the capture time of the records, now if not given.

    Files are named after the task's attempt, so an attempt that is run again
    writes files of its own, and only the files of the attempt whose rows were
    kept are ever named by the index.
    """

    stamp = (date or dt.datetime.now(dt.UTC)).astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        task = TaskContext.get()
        stem = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        out, name, at, number = None, "", 0, 0
        try:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at, number = f"pages-{stem}-{number:04d}.warc.gz", 0, number + 1
                        out = system.open_output_stream(posixpath.join(root, name), compression=None)
                    body = None if row["html"] is None else row["html"].encode()
                    raw = gzip.compress(
                        record_bytes(row["page_id"], row["url"], body, row["digest"], row["bytes"], row["refers_to"], stamp),
                        _GZIP_LEVEL, mtime=0,
                    )
                    out.write(raw)
                    rows.append((row["key"], row["page_id"], name, at, len(raw)))
                    at += len(raw)
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, LINE_TYPES, strict=True)], names=LINE_NAMES
                )
        finally:
            if out is not None:
                out.close()

    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    keyed = captured.withColumn("key", url_key(F.col("url")))
    return write_table(keyed.mapInArrow(write, LINE_SCHEMA), "lines")


LINE_NAMES = ["key", "page_id", "file", "start", "length"]
LINE_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
LINE_SCHEMA = "key string, page_id long, file string, start long, length long"
DIRECTORY_SCHEMA = "first string, last string, file string, start long, length long, lines long"


def write_index(lines: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort ``lines`` by key into compressed blocks under ``folder`` and return the
    sparse directory: first and last key, file, start, length and lines of a block.

    Beside each index file its part of the directory is written too, for searches.
    Files are named in the order of their keys."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        task = TaskContext.get()
        name = f"index-{task.partitionId():06d}-{task.taskAttemptId()}.cdx.zz"
        held: list[dict] = []
        entries: list[list] = []
        at = 0
        with system.open_output_stream(posixpath.join(root, name), compression=None) as out:

            def block(rows: list[dict]) -> pa.RecordBatch:
                nonlocal at
                raw = zlib.compress("\n".join(json.dumps([r[k] for k in LINE_NAMES]) for r in rows).encode())
                out.write(raw)
                row = (rows[0]["key"], rows[-1]["key"], name, at, len(raw), len(rows))
                entries.append([rows[0]["key"][:KEY_CHARACTERS], at, len(raw)])
                at += len(raw)
                types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                names = ["first", "last", "file", "start", "length", "lines"]
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

            for batch in batches:
                held += batch.to_pylist()
                while len(held) >= block_lines:
                    yield block(held[:block_lines])
                    held = held[block_lines:]
            if held:
                yield block(held)
        if entries:
            with system.open_output_stream(posixpath.join(root, name + ".dir"), compression=None) as out:
                out.write(zlib.compress(json.dumps(entries).encode()))

    n = min(INDEX_FILES, max(1, lines.count() // (8 * block_lines)))
    ordered = lines.repartitionByRange(n, "key", "page_id", "file", "start").sortWithinPartitions(
        "key", "page_id", "file", "start"
    )
    return write_table(ordered.mapInArrow(write, DIRECTORY_SCHEMA), "directory")


def read_block(folder: str, file: str, start: int, length: int) -> list[list]:
    """The index lines of one block."""
    return [json.loads(x) for x in zlib.decompress(read_range(folder, file, start, length)).decode().split("\n")]


def read_range(folder: str, file: str, start: int, length: int) -> bytes:
    system, root = _file_system(folder)
    with system.open_input_file(posixpath.join(root, file)) as f:
        return f.read_at(length, start)


def _between(firsts: list[str], key: str) -> range:
    """Places of sorted ``firsts`` (shortened first keys) whose part can hold ``key``:
    those with its shortened key, and the one before them."""
    short = key[:KEY_CHARACTERS]
    return range(max(0, bisect.bisect_left(firsts, short) - 1), bisect.bisect_right(firsts, short))


def index_files(directory: DataFrame) -> list[tuple[str, str]]:
    """(shortened first key, name) of every index file in the order of keys; at most
    :data:`INDEX_FILES` of them."""
    first = F.substring("first", 1, KEY_CHARACTERS)
    rows = directory.groupBy("file").agg(F.min(first).alias("first")).orderBy("file").collect()
    return [(r["first"], r["file"]) for r in rows]


class Finder:
    """Blocks that can hold a key, by bisecting the list of index files and then a
    file's directory. Holds the directories last used, so keys in order cost one read
    for each file."""

    def __init__(self, files: list[tuple[str, str]], folder: str):
        self.firsts = [f for f, _ in files]
        self.names = [n for _, n in files]
        self.directory = functools.lru_cache(maxsize=4)(functools.partial(self._read, folder))

    @staticmethod
    def _read(folder: str, file: str) -> tuple[list[str], list[list]]:
        system, root = _file_system(folder)
        with system.open_input_file(posixpath.join(root, file + ".dir")) as f:
            entries = json.loads(zlib.decompress(f.read()))
        return [e[0] for e in entries], entries

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        for i in _between(self.firsts, key):
            firsts, entries = self.directory(self.names[i])
            for j in _between(firsts, key):
                yield self.names[i], entries[j][1], entries[j][2]


def captures_in(lines: list[list], key: str) -> list[list]:
    """The lines of a block that have ``key``, by bisect."""
    low = bisect.bisect_left(lines, key, key=lambda x: x[0])
    return lines[low : bisect.bisect_right(lines, key, lo=low, key=lambda x: x[0])]


def lookup(directory: DataFrame, folder: str, url: str) -> list[dict]:
    """The captures of ``url``: binary search of the index files and of the directory
    of one, one block (more only where a key fills several, or begins one), and a byte
    range for each capture."""
    key = directory.sparkSession.range(1).select(url_key(F.lit(url))).first()[0]
    return [
        parse_record(gzip.decompress(read_range(folder, file, start, length)))
        for block in Finder(index_files(directory), folder).blocks(key)
        for _, _, file, start, length in captures_in(read_block(folder, *block), key)
    ]


RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, digest string, size long, payload binary"
_PLACE_SCHEMA = "key string, file string, start long, length long"


def find(urls: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """Index lines of every capture of ``urls`` (a column ``url``): key, page_id, file,
    start, length. Null is searched as the empty url.

    Distinct keys are sorted over ranges; a task bisects the index files and their
    directories for its keys and names the blocks. Blocks are then dealt, each is read
    once, and its keys are bisected in it. A key that fills many blocks is searched in
    many tasks.
    """
    files = index_files(directory)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(files, folder)
        found: list[tuple] = []
        for batch in batches:
            for key in batch.column("key").to_pylist():
                for place in finder.blocks(key):
                    found.append((key, *place))
                    if len(found) == 4096:
                        yield _batch(found, _PLACE_TYPES, _PLACE_NAMES)
                        found = []
        if found:
            yield _batch(found, _PLACE_TYPES, _PLACE_NAMES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start, length), group in by_key(batches, "file", "start", "length"):
            lines = read_block(folder, file, start, length)
            rows = [x for key in group.column("key").to_pylist() for x in captures_in(lines, key)]
            if rows:
                yield _batch(rows, LINE_TYPES, LINE_NAMES)

    keys = urls.select(url_key(F.col("url")).alias("key")).distinct()
    sought = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(locate, _PLACE_SCHEMA)
    dealt = sought.repartition("file", "start").sortWithinPartitions("file", "start", "key")
    return dealt.mapInArrow(read, LINE_SCHEMA)


_PLACE_NAMES = ["key", "file", "start", "length"]
_PLACE_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64()]


def _batch(rows: list, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def index_lines(directory: DataFrame, folder: str) -> DataFrame:
    """Every line of the index, block by block."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch(read_block(folder, row["file"], row["start"], row["length"]), LINE_TYPES, LINE_NAMES)

    return directory.repartition("file", "start").mapInArrow(ranges, LINE_SCHEMA)


def read_records(lines: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of index ``lines``, read by their byte ranges; the ranges of a piece
    of an archive are read together and in order."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        names = ["page_id", "url", "type", "refers_to", "digest", "size", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        shown = ["page_id", "url", "record_type", "refers_to", "digest", "size", "payload"]
        for (file, _), group in by_key(batches, "file", "piece"):
            with system.open_input_file(posixpath.join(root, file)) as f:
                part, held = [], 0
                for start, length in zip(group.column("start").to_pylist(), group.column("length").to_pylist(), strict=True):
                    record = parse_record(gzip.decompress(f.read_at(length, start)), payloads)
                    part.append([record[n] for n in names])
                    held += len(record["payload"] or b"")
                    if len(part) == 256 or held > READ_BYTES:
                        yield _batch(part, types, shown)
                        part, held = [], 0
                if part:
                    yield _batch(part, types, shown)

    placed = lines.withColumn("piece", F.floor(F.col("start") / READ_BYTES)).repartition("file", "piece")
    return placed.sortWithinPartitions("file", "piece", "start").mapInArrow(records, RECORD_SCHEMA)


def read_archives(directory: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record that the index names, read back."""
    return read_records(index_lines(directory, folder), folder, payloads)


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write ``pages`` into archives with an index in the session's shared folder;
    returns the directory and the folder."""
    folder = scratch_path(pages.sparkSession, f"warc-{uuid.uuid4().hex[:8]}")
    lines = write_archives(captures(pages), folder)
    return write_index(lines, folder), folder


def round_trip(pages: DataFrame) -> DataFrame:
    """Digest of every record after writing and reading back: page_id,
    payload_bytes, payload_digest, record_type, refers_to. The records are found by
    searching the index for the urls of ``pages``."""
    directory, folder = archive(pages)
    return read_records(find(pages, directory, folder), folder, payloads=False).select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


def index_of(spark: SparkSession, directory_path: str) -> DataFrame:
    """A directory that was kept as a table."""
    return spark.read.schema(DIRECTORY_SCHEMA).parquet(directory_path)
