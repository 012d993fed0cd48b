"""WARC archives of pages and a two-level capture index over them.

Archives are Zstandard WARC files of at most ARCHIVE_BYTES (or of one record): each record is a frame of its own, so it can be read alone
from its offset. Spark's text writer puts the frames' bytes into the shared folder (its commit protocol discards a lost task's files); its
line separator is an empty skippable frame, which decoders pass over. A task begins a new archive when one is full.

The index has a line per record, sorted by the URL with its host reversed, in compressed blocks of equal line counts; the directory
holds each block's first and last key. Blocks get as many lines as keep the directory under MAX_DIRECTORY rows, so it can be
broadcast at any corpus size. A look-up searches the directory, then the lines of the blocks found. Records are then read by their byte
ranges: tasks sort what they are to read by file and offset, seek, and read neighbours in one go. That takes a path that Python can open
(a folder mounted everywhere, or a store that pyarrow knows); from one that only Spark's readers reach, whole archives are read and sliced.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, shared_path, slices, written

SEPARATOR = b"P*M\x18\x00\x00\x00\x00"
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 8 << 20
"""Neighbouring records are read together up to so many bytes."""
READ_GAP = 1 << 16
"""Bytes between two records that are read over rather than sought over."""
LINES_PER_BLOCK = 3000
MAX_DIRECTORY = 500_000
BROADCAST_ROWS = 200_000
MAX_PATHS = 1000
CAPTURED = "2024-01-01T00:00:00Z"
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a column in upper-case base32: twenty bits of its hexadecimal form make four digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), *_BASE32)


def surt(url: str | None) -> str:
    """Sort-friendly form: host labels reversed and joined by commas, `)`, then path and query; no scheme, port 80 or 443, `www.` or fragment."""
    rest = re.sub(r"[\x00-\x20\x7f]", "", url or "").partition("#")[0]
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", rest)
    host, slash, path = re.match(r"([^/?]*)(/?)(.*)", rest).groups()
    host = re.sub(r":(80|443)$", "", host.rpartition("@")[2].lower())
    host = re.sub(r"^www\d*\.", "", host).strip(".")
    name, colon, port = host.partition(":")
    return f"{','.join(reversed(name.split('.')))}{colon}{port})/{path}" if host or slash or path else "-"


def _header(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(kind: str, name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record. Its block is an HTTP response; of a revisit only the head, whose Content-Length is still the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {CAPTURED}", f"WARC-Target-URI: {_header(url)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The record's headers, type, payload (None of a revisit) and its payload's length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind = headers["WARC-Type"]
    if kind == "response" and len(payload) != length:
        raise ValueError("the payload's length is wrong")
    return {"headers": headers, "kind": kind, "payload": None if kind == "revisit" else payload, "length": length}


def _id(text: str | None) -> int | None:
    found = re.search(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def write(pages: DataFrame, path: str, min_revisit: int = 0, key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A record for each row of pages, in archives under path.

    The payload is html in UTF-8, of null none. Of equal payloads of at least min_revisit bytes the smallest key's record is the
    response and the others are revisits. Repeated rows of the smallest key are responses, as are rows without a key, which
    nothing can refer to. A null url is an empty one. Other columns are left out, and an empty table leaves archives without records.
    """
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    groups = rows.where((F.octet_length("html") >= min_revisit) & F.col("key").isNotNull()).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1").drop("n"), "payloads")
    rows = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, "digest", "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        roll = size = 0
        for batch in slices(batches):
            frames, rolls = [], []
            for name, link, body, digest, first in zip(*(column(batch, c) for c in ("key", "url", "html", "digest", "first")), strict=True):
                kind = "revisit" if first is not None and name is not None and name != first else "response"
                frame = compress(record(kind, str(name), link, body.encode("utf-8", "surrogatepass"), digest, str(first)))
                if size and size + len(frame) > archive_bytes:
                    roll, size = roll + 1, 0
                size += len(frame) + len(SEPARATOR)
                frames.append(frame), rolls.append(roll)
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary()), pa.array(rolls, pa.int32())], names=["frame", "roll"])

    frames = rows.select("key", "url", "html", "digest", "first").mapInArrow(pack, "frame binary, roll int").select(F.col("frame").cast("string").alias("value"), "roll")
    frames.write.partitionBy("roll").option("lineSep", SEPARATOR.decode()).text(path)


def records(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each frame. A separator's bytes within a frame are told by the frame's checksum."""
    expand = zstandard.ZstdDecompressor()
    at = 0
    while at < len(content):
        end = content.find(SEPARATOR, at)
        while True:
            if end < 0:
                raise ValueError("the archive ends within a record")
            try:
                data = expand.decompressobj().decompress(content[at:end])
                parse(data)
                break
            except (zstandard.ZstdError, ValueError, KeyError, TypeError):
                end = content.find(SEPARATOR, end + 1)
        yield at, end - at, data
        at = end + len(SEPARATOR)


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(paths).select("path", "content")


def index(spark: SparkSession, archive: str) -> DataFrame:
    """The blocks of an archive folder's index, as a written table: block, first, last, n, lines (compressed).

    A line is the key and a JSON object with page, date, type, digest, file, offset and length.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(column(batch, "path"), column(batch, "content"), strict=True):
                keys, pages, lines = [], [], []
                for offset, length, data in records(content):
                    h = parse(data)["headers"]
                    page = _id(h["WARC-Record-ID"])
                    keys.append(surt(h["WARC-Target-URI"]))
                    pages.append(page)
                    lines.append(json.dumps({"page": page, "date": h["WARC-Date"], "type": h["WARC-Type"], "digest": h["WARC-Payload-Digest"], "file": path, "offset": offset, "length": length}))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(pages, pa.int64()), pa.array(lines, pa.string())], names=["key", "page", "line"])

    entries = written(_files(spark, archive).mapInArrow(scan, "key string, page long, line string"), "captures")
    n = entries.count()
    per_block = max(LINES_PER_BLOCK, -(-n // (MAX_DIRECTORY // 2)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[str, str]] = []

        def block(part: list[tuple[str, str]]) -> pa.RecordBatch:
            lines = zlib.compress("\n".join(f"{k}\t{v}" for k, v in part).encode("utf-8", "surrogatepass"))
            return pa.RecordBatch.from_pydict({"first": [part[0][0]], "last": [part[-1][0]], "n": [len(part)], "lines": [lines]})

        for batch in batches:
            waiting += zip(column(batch, "key"), column(batch, "line"), strict=True)
            while len(waiting) >= per_block:
                yield block(waiting[:per_block])
                waiting = waiting[per_block:]
        if waiting:
            yield block(waiting)

    parts = max(1, min(n // per_block, MAX_DIRECTORY // 2))
    # Spark samples what it partitions by, so that is kept short; the line's hash parts repeated captures of one page.
    ordered = entries.withColumn("hash", F.xxhash64("line")).repartitionByRange(parts, "key", "page", "hash").sortWithinPartitions("key", "page", "hash").select("key", "line")
    blocks = ordered.mapInArrow(fold, "first string, last string, n long, lines binary").withColumn("block", F.monotonically_increasing_id())
    return written(blocks, "index")


def look_up(keys: DataFrame, blocks: DataFrame) -> DataFrame:
    """The captures of keys, a table with column `key` (see `surt`): key, page, file, offset, length. Keys without capture give no row."""
    directory = sorted((r["first"], r["last"], r["block"]) for r in blocks.select("first", "last", "block").toLocalIterator())
    if len(directory) > 2 * MAX_DIRECTORY:
        raise ValueError(f"the directory has {len(directory)} rows")
    shared = keys.sparkSession.sparkContext.broadcast(directory)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [x[0] for x in shared.value], [x[1] for x in shared.value]
        for batch in batches:
            out_key, out_block = [], []
            for k in column(batch, "key"):
                # A key may run over several blocks: from the first that ends at or after it to the last that begins at or before it.
                for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k)):
                    out_key.append(k), out_block.append(shared.value[i][2])
            yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.string()), pa.array(out_block, pa.int64())], names=["key", "block"])

    wanted = keys.select("key").where("key is not null").distinct().mapInArrow(find, "key string, block long")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for data in right["lines"]:
            lines = [x.split("\t", 1) for x in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")]
            names = [x[0] for x in lines]
            for k in left["key"]:
                for i in range(bisect.bisect_left(names, k), bisect.bisect_right(names, k)):
                    e = json.loads(lines[i][1])
                    out.append((k, e["page"], e["file"], e["offset"], e["length"]))
        return pd.DataFrame(out, columns=["key", "page", "file", "offset", "length"]).astype({"page": "Int64", "offset": "int64", "length": "int64"})

    return wanted.groupBy("block").cogroup(blocks.select("block", "lines").groupBy("block")).applyInPandas(search, "key string, page long, file string, offset long, length long")


def _open(path: str):
    """The file of a path as Spark writes it, to seek and read in. Raises if Python reaches no such path."""
    if (local := re.sub("^file:/+", "/", path)).startswith("/"):
        return open(local, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _seekable(archive: str) -> bool:
    if re.match("(file:)?/", archive):
        return True
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(archive)
    except (pa.ArrowException, ValueError, OSError):
        return False
    return True


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _checked(data: bytes) -> tuple:
    """The row of a record; its payload is checked against its digest."""
    r = parse(data)
    h = r["headers"]
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if r["payload"] is not None and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest:
        raise ValueError(f"the payload of {h['WARC-Record-ID']} doesn't have its digest")
    return _id(h["WARC-Record-ID"]), h["WARC-Target-URI"], r["length"], digest, r["kind"], _id(h.get("WARC-Refers-To")), r["payload"]


def read(captures: DataFrame, archive: str) -> DataFrame:
    """The records of captures (file, offset, length; a written table): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Each payload is checked against its digest. payload is null of a revisit; its record's payload_bytes are those of the payload it refers to.
    Repeated captures give repeated rows, no captures no rows.
    """
    if not _seekable(archive):
        return _read_whole(captures, archive)
    total = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        name, file = None, None
        try:
            for batch in batches:
                files, offsets, lengths = (column(batch, c) for c in ("file", "offset", "length"))
                i = 0
                while i < len(files):
                    if files[i] != name:
                        if file is not None:
                            file.close()
                        name, file = files[i], _open(files[i])
                    j, end = i + 1, offsets[i] + lengths[i]
                    while j < len(files) and files[j] == name and offsets[j] - end <= READ_GAP and offsets[j] + lengths[j] - offsets[i] <= READ_BYTES:
                        end = max(end, offsets[j] + lengths[j])
                        j += 1
                    file.seek(offsets[i])
                    data = file.read(end - offsets[i])
                    rows = [_checked(expand.decompressobj().decompress(data[o - offsets[i] : o - offsets[i] + n])) for o, n in zip(offsets[i:j], lengths[i:j], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=[f.split()[0] for f in _READ.split(", ")])
                    i = j
        finally:
            if file is not None:
                file.close()

    # A task reads about one archive's bytes; what is wanted of an archive is one task's, in the order of the file.
    parts = max(1, -(-total // ARCHIVE_BYTES))
    return captures.select("file", "offset", "length").repartition(parts, "file").sortWithinPartitions("file", "offset").mapInArrow(fetch, _READ)


def _read_whole(captures: DataFrame, archive: str) -> DataFrame:
    """The same where Spark's readers alone reach the archives: each wanted one is read whole and sliced; a task holds one at a time."""
    wanted = captures.select("file").distinct()
    n = max(1, wanted.count())
    # A look-up of a few pages opens their archives only; beyond MAX_PATHS the folder is listed.
    paths = [r["file"] for r in wanted.collect()] if n <= MAX_PATHS else []
    files = _files(captures.sparkSession, paths or archive).withColumnRenamed("path", "file")

    def fetch(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        expand = zstandard.ZstdDecompressor()
        spans = zip(left["offset"], left["length"], strict=True)
        out = [_checked(expand.decompressobj().decompress(right["content"][0][at : at + length])) for at, length in spans] if len(right) else []
        return pd.DataFrame(out, columns=[f.split()[0] for f in _READ.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    # As many partitions as archives: a task gets a few of them, whatever the session's number of shuffle partitions is.
    return captures.repartition(n, "file").groupBy("file").cogroup(files.repartition(n, "file").groupBy("file")).applyInPandas(fetch, _READ)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", with_payload: bool = False) -> DataFrame:
    """Writes pages as archives in the shared folder, indexes them, looks every page's URL up and reads what is found: one row for each row of pages.

    Nulls and repeated rows are as in write; pages that share a URL are all found under it. Other columns are left out, and an empty table gives no rows.
    """
    spark = pages.sparkSession
    archive = shared_path(spark, "warc")
    write(pages, archive, key=key, url=url, html=html)
    blocks = index(spark, archive)

    @F.pandas_udf("string")
    def keys(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: surt(_header(u)))

    found = look_up(pages.select(keys(F.coalesce(F.col(url), F.lit(""))).alias("key")), blocks)
    out = read(written(found, "found"), archive)
    return out if with_payload else out.drop("payload")
