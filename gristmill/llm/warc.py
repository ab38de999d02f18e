"""WARC archives with a two-level capture index.

Writing. A page's payload digest decides its record: the least page_id of equal payloads is a response, the others are revisits of
it. A record's head and payload are one string and the record's closing CRLF CRLF is the text writer's line separator, so Spark's
own committed writer produces plain .warc content on any file system; each task's file is an archive.

Index. A pass reads the heads of each archive's records, skipping their blocks, and gives a capture line for each: reversed-host key,
url, digest, offset, length, file. The lines are sorted by key over all tasks and packed into compressed blocks of LINES; a sparse
directory keeps each block's first and last key, in sorted pages of LINES, too. `lookup` binary-searches the pages' keys, then the page,
then the block, and reads only the record's range of its archive. `read_back` goes the same way for all captures: directory, blocks, then
ranges, dealt by archive and SEGMENT and read in order. An executor opens archives itself where pyarrow knows the store; where only
Spark's readers do, they hand it the archive, which is why archives are kept small.

Defined cases: a null html is an empty payload; a null url is an empty one; control letters and blanks in a url are written as %20; a
null page_id is the least of nothing: it revisits a page with an id, if one has its payload; repeated rows are records of their own,
all of them responses if theirs is the least id; an empty table gives no archives and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import cut, join_by, new_folder

LINES = 2000
#: Pages in one archive at most.
ARCHIVE_PAGES = 20_000
#: Bytes of an archive whose ranges are read by one task after another.
SEGMENT = 64 << 20
#: A list of revisits up to this size is broadcast; a longer one is joined by page_id.
REVISIT_BYTES = 8 << 20
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def b32(hex_column: str) -> Column:
    """Base32 of a column of 40 hexadecimal digits."""
    code = f"cast(conv(substr({hex_column}, g * 5 + 1, 5), 16, 10) as int)"
    letters = ", ".join(f"substr('{_B32}', (shiftright({code}, {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
    return F.expr(f"array_join(transform(sequence(0, 7), g -> concat({letters})), '')")


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, hex, first: the pages that revisit another one."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = cut(pages.select("page_id", F.sha1(payload).alias("hex"), F.octet_length(payload).alias("n")).where(F.col("n") >= least_bytes))
    firsts = keyed.groupBy("hex").agg(F.min("page_id").alias("first"), F.count("*").alias("many")).where("many > 1 AND first IS NOT NULL")
    joined = join_by(keyed.drop("n"), firsts, "hex", "many")
    return cut(joined.where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct())


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Writes a record for each row of `pages` (page_id, url, html) below `folder`."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    again = revisits(pages, least_bytes).withColumnRenamed("page_id", "_page").withColumnRenamed("hex", "_hex")
    if again.count() * 64 <= REVISIT_BYTES:
        again = F.broadcast(again)
    rows = pages.withColumn("hex", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("hex") == F.col("_hex")), "left").withColumn("b32", b32("hex"))
    is_new = F.col("first").isNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    lines = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    http = lines("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: ", F.col("n").cast("string"), CRLF + CRLF)
    head = lines(
        "WARC/1.1" + CRLF + "WARC-Type: ", F.when(is_new, "response").otherwise("revisit"), CRLF + "WARC-Record-ID: ", name("page_id"),
        f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: ", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20"),
        CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "WARC-Payload-Digest: sha1:", F.col("b32"),
        F.when(is_new, "").otherwise(lines(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: ", name("first"))),
        CRLF + "X-Payload-Length: ", F.col("n").cast("string"), CRLF + "Content-Length: ", F.when(is_new, F.octet_length(http) + F.col("n")).otherwise(F.octet_length(http)).cast("string"), CRLF + CRLF,
    )
    record = F.concat(head, http, F.when(is_new, F.col("html")).otherwise(F.lit("")))
    rows.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", ARCHIVE_PAGES).text(folder)


def key_of(url: str) -> str:
    """The url with its host reversed, so that a site's captures lie together."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.lower()
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + path.lower()


def read_head(stream: BinaryIO) -> tuple[dict[str, str], int] | None:
    """The head fields of the record where the stream stands, and the head's length; None at the end."""
    lines, n = [], 0
    while True:
        line = stream.readline()
        if not line:
            return None
        n += len(line)
        if line == b"\r\n":
            break
        lines.append(line[:-2].decode("utf-8"))
    return dict(x.split(": ", 1) for x in lines[1:]), n


def walk(stream: BinaryIO) -> Iterator[tuple[int, int, dict[str, str]]]:
    """offset, length and head fields of each record of an archive; blocks are skipped."""
    at = 0
    while (head := read_head(stream)) is not None:
        fields, n = head
        length = n + int(fields["Content-Length"]) + 4
        yield at, length, fields
        at += length
        stream.seek(at)


def opened(path: str, content: bytes | None) -> BinaryIO:
    """An archive as a stream that can seek: its content if that was handed over, else from its store."""
    if content is not None:
        return io.BytesIO(content)
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return io.BufferedReader(store.open_input_file(name))


def _known_store(folder: str) -> bool:
    """Whether executors can open files of a folder's store without Spark."""
    if urlsplit(folder).scheme in ("", "file"):
        return True
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(folder)
    except (pa.ArrowException, OSError, ImportError):
        return False
    return True


def parse(record: bytes) -> tuple:
    """The digest row of one record. A response's payload is digested anew and has to agree with its head."""
    fields, n = read_head(io.BytesIO(record))
    own = lambda name: None if (x := fields[name][len("<urn:page:") : -1]) == "null" else int(x)
    size, told = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][len("sha1:") :]
    if fields["WARC-Type"] == "response":
        payload = memoryview(record)[record.index(b"\r\n\r\n", n) + 4 : n + int(fields["Content-Length"])]
        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != told:
            raise ValueError(f"digest of {fields['WARC-Record-ID']}")
    return own("WARC-Record-ID"), size, told, fields["WARC-Type"], own("WARC-Refers-To") if "WARC-Refers-To" in fields else None


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            with opened(path, content.as_py()) as stream:
                rows = [(key_of(f["WARC-Target-URI"]), f["WARC-Target-URI"], f["WARC-Payload-Digest"][5:], at, n, path) for at, n, f in walk(stream)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "url", "digest", "offset", "length", "file"])


def packed(lines: list[tuple[str, str]]) -> dict[str, list]:
    """Sorted (key, line) pairs as one compressed block."""
    return {"first_key": [lines[0][0]], "last_key": [lines[-1][0]], "block": [zlib.compress("\n".join(x for _, x in lines).encode(), 6)]}


def unpacked(block: bytes) -> list[list[str]]:
    return [x.split("\t") for x in zlib.decompress(block).decode().split("\n")]


def _pack(columns: tuple[str, ...]):
    """Rows in order, the first column their key, into blocks of LINES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                held.append((r[0], "\t".join(map(str, r))))
                if len(held) == LINES:
                    yield pa.record_batch(packed(held))
                    held = []
        if held:
            yield pa.record_batch(packed(held))

    return run


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of each archive; the content is null, and not read, where executors open the store themselves."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", F.lit(None).cast("binary").alias("content") if _known_store(folder) else F.col("content"))


_BLOCK = "first_key string, last_key string, block binary"


def write_index(spark: SparkSession, folder: str, index: str) -> None:
    """Blocks (sorted over all files) and the pages of their sparse directory, from the archives in `folder`."""
    lines = cut(archives(spark, folder).mapInArrow(_captures, "key string, url string, digest string, offset long, length long, file string"))
    # offset and file part equal keys, so that a hot url doesn't fill one range
    ordered = lines.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    blocks = ordered.mapInArrow(_pack(("key", "url", "digest", "offset", "length", "file")), _BLOCK)
    blocks.withColumn("block_id", F.monotonically_increasing_id()).write.parquet(f"{index}/blocks")
    entries = spark.read.parquet(f"{index}/blocks").select("first_key", "last_key", "block_id")
    entries = entries.repartitionByRange("first_key", "block_id").sortWithinPartitions("first_key", "block_id")
    pages = entries.mapInArrow(_pack(("first_key", "last_key", "block_id")), _BLOCK)
    pages.withColumn("page", F.monotonically_increasing_id()).write.parquet(f"{index}/directory")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page in batch.column("block").to_pylist():
            yield pa.record_batch({"block_id": pa.array([int(r[2]) for r in unpacked(page)], pa.int64())})


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column("block").to_pylist():
            rows = unpacked(block)
            yield pa.record_batch({"path": [r[5] for r in rows], "offset": pa.array([int(r[3]) for r in rows], pa.int64()), "length": pa.array([int(r[4]) for r in rows], pa.int64())})


_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_RECORD_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _rows(records: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in records], f.type) for i, f in enumerate(_RECORD)], schema=_RECORD)


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records at places that come by archive and offset. One record is held at a time."""
    stream, now = None, None
    try:
        for batch in batches:
            found = []
            for path, at, n in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path != now:
                    if stream is not None:
                        stream.close()
                    stream, now = opened(path, None), path
                stream.seek(at)
                found.append(parse(stream.read(n)))
            yield _rows(found)
    finally:
        if stream is not None:
            stream.close()


def _cut_ranges(places: pa.Table, files: pa.Table) -> pa.Table:
    """The same from the content of one archive."""
    content = files.column("content")[0].as_py() if files.num_rows else b""
    found = [parse(content[at : at + n]) for at, n in zip(places.column("offset").to_pylist(), places.column("length").to_pylist(), strict=True)]
    return pa.Table.from_batches([_rows(found)])


def read_back(spark: SparkSession, folder: str, index: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture that the directory leads to."""
    named = spark.read.parquet(f"{index}/directory").select("block").mapInArrow(_entries, "block_id long")
    blocks = spark.read.parquet(f"{index}/blocks").select("block_id", "block").join(named, "block_id")
    places = blocks.select("block").mapInArrow(_places, "path string, offset long, length long")
    if _known_store(folder):
        places = places.repartition("path", F.floor(F.col("offset") / SEGMENT)).sortWithinPartitions("path", "offset")
        return places.mapInArrow(_read_ranges, _RECORD_SQL)
    return places.groupBy("path").cogroup(archives(spark, folder).groupBy("path")).applyInArrow(_cut_ranges, _RECORD_SQL)


def _range(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """A range of a file of any store that Spark reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def _within(key: str, firsts: list[str], lasts: list[str]) -> range:
    """Which of sorted spans can hold a key, by two binary searches."""
    return range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))


def lookup(spark: SparkSession, index: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """Head fields and content block of each capture of one url. Reads the directory's top, the pages, blocks and ranges that can hold it.

    The top has one row for LINES * LINES captures; it is all that a search has in memory beside one page or block.
    """
    key = key_of(url)
    pages, blocks = spark.read.parquet(f"{index}/directory"), spark.read.parquet(f"{index}/blocks")
    top = pages.select("first_key", "last_key", "page").orderBy("first_key", "page").collect()
    found = []
    for i in _within(key, [r["first_key"] for r in top], [r["last_key"] for r in top]):
        entries = unpacked(pages.where(F.col("page") == top[i]["page"]).first()["block"])
        for j in _within(key, [e[0] for e in entries], [e[1] for e in entries]):
            rows = unpacked(blocks.where(F.col("block_id") == int(entries[j][2])).first()["block"])
            keys = [r[0] for r in rows]
            for r in rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                if r[1] == url:
                    content = _range(spark, r[5], int(r[3]), int(r[4]))
                    fields, n = read_head(io.BytesIO(content))
                    found.append((fields, content[n:-4]))
    return found


def through_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes archives and index to a fresh shared folder and reads them back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, f"{folder}/archives", least_bytes)
    write_index(spark, f"{folder}/archives", f"{folder}/index")
    return read_back(spark, f"{folder}/archives", f"{folder}/index")
