"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a skippable frame at the head of each file.

A file is a skippable frame (magic 0x184D2A5D, length, dictionary) and then a frame for each record, so a reader can start
at any frame.  Records are WARC/1.1: version line, headers, empty line, block, two empty lines.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, table
from .files import open_file, write_file

#: Pages from whose heads the dictionary is trained, bytes of each, and the size aimed at.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8192, 32 << 10
LEAST_REVISIT = 1000
#: Compressed bytes after which a file is closed.
FILE_BYTES = 64 << 20
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 3
READ = 1 << 20
#: The date of records where the caller names none, so that reruns write the same bytes.
DATE = "1970-01-01T00:00:00Z"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class BadRecord(ValueError):
    """An archive that breaks the format: wrong magic, missing or repeated headers, lengths or digests that do not hold."""


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for payloads like the samples; empty where there is too little to learn from."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def head_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def urn(page_id: int | None) -> str:
    return f"<urn:rxweave:page:{'' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, size: int, sha1: str, date: str = DATE) -> bytes:
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": urn(page_id),
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date": date,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(),
        "X-Payload-Length": str(size),
    }
    if revisit:
        headers |= {"WARC-Refers-To": urn(refers_to), "WARC-Profile": PROFILE}
    block = b"" if revisit else payload
    headers |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record, after its headers, lengths and digest are checked."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise BadRecord("no version line or no end of headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "surrogatepass").partition(":")
        if not colon or name in headers:
            raise BadRecord(f"bad header line {line[:80]!r}")
        headers[name] = value.strip(" ")
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Payload-Digest", "Content-Length"):
        if name not in headers:
            raise BadRecord(f"no {name}")
    length = headers["Content-Length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord("the block is not as long as Content-Length says")
    block = rest[:-4]
    if headers["WARC-Type"] == "revisit":
        if block or "WARC-Refers-To" not in headers:
            raise BadRecord("a revisit with a block or without WARC-Refers-To")
    elif headers["WARC-Type"] != "response":
        raise BadRecord(f"unknown record type {headers['WARC-Type']}")
    elif hashlib.sha1(block).digest() != base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")):
        raise BadRecord("the payload does not have its digest")
    elif headers.get("X-Payload-Length", length) != length:
        raise BadRecord("two lengths")
    return headers, block


def _rest_of_frame(f, data: bytes, decoder) -> Iterator[tuple[bytes, bytes]]:
    """Yield the content of each frame of a file from the bytes in data on."""
    while True:
        if not data and not (data := f.read(READ)):
            return
        if data[:4] != FRAME_MAGIC and len(data) >= 4:
            raise BadRecord("no frame where one has to begin")
        one, parts = decoder.decompressobj(), []
        while not one.eof:
            if not data and not (data := f.read(READ)):
                raise BadRecord("the file ends inside a frame")
            parts.append(one.decompress(data))
            data = one.unused_data if one.eof else b""
        yield b"".join(parts)


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive one after the other; a record at a time is held in memory."""
    import zstandard

    with open_file(path) as f:
        head = f.read(8)
        if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
            raise BadRecord("no dictionary frame at the head")
        (size,) = struct.unpack("<I", head[4:])
        dictionary = f.read(size)
        if len(dictionary) != size:
            raise BadRecord("the dictionary is cut short")
        if dictionary[:4] == FRAME_MAGIC:  # the dictionary itself may be compressed
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
        for content in _rest_of_frame(f, b"", decoder):
            yield parse_record(content)


def _writer(folder: str, dictionary: bytes, date: str = DATE):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        options = {"level": LEVEL, "write_content_size": True, "write_checksum": True}
        coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), **options) if dictionary else zstandard.ZstdCompressor(**options)
        part, seq, frames, size, rows = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush():
            nonlocal seq, frames, size, rows
            path = write_file(folder, f"pages-{part:06d}-{seq:04d}.warc.zst", [head_frame(dictionary), *frames])
            out = pa.RecordBatch.from_pydict({"path": [path], "records": [rows]})
            seq, frames, size, rows = seq + 1, [], 0, 0
            return out

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                page_id, url, html, sha1, length, refers_to, revisit = row
                frame = coder.compress(make_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, revisit, length, sha1, date))
                frames.append(frame)
                size, rows = size + len(frame), rows + 1
                if size >= FILE_BYTES:
                    yield flush()
        if rows:
            yield flush()

    return write


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda name: int(name[len("<urn:rxweave:page:") : -1]) if name[len("<urn:rxweave:page:") : -1] else None
    for batch in batches:
        for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids, sizes, digests, kinds, refers = [], [], [], [], []
            for headers, block in read_archive(path):
                revisit = headers["WARC-Type"] == "revisit"
                ids.append(number(headers["WARC-Record-ID"]))
                sizes.append(int(headers["X-Payload-Length"]) if revisit else len(block))
                digests.append(base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex())
                kinds.append(headers["WARC-Type"])
                refers.append(number(headers["WARC-Refers-To"]) if revisit else None)
            if len(ids) != records:
                raise BadRecord(f"{path} has {len(ids)} records of {records}")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), pa.array(refers, pa.int64())],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, sha1, length, refers_to, revisit): html is null in revisits.

    Payloads are equal when their SHA-256 is.  Only digests that occur twice or more are joined, as a written
    table, so a payload that fills a third of the pages can be split among tasks.  Of rows that repeat the largest page_id of
    their payload, one is the response as much as the other; null page_ids are below all others.
    """
    size = F.octet_length(F.coalesce("html", F.lit("")))
    marked = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("sha1"), size.cast("long").alias("length"))
    equal = F.when(size >= least, F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)).alias("sha256")
    keyed = pages.select("page_id", equal).filter("sha256 is not null")
    groups = cut(keyed.groupBy("sha256").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("sha256").alias("of"), "first"))
    few = groups.limit(50_001).count() <= 50_000
    joined = marked.withColumn("sha256", F.when(F.col("length") >= least, F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)))
    joined = joined.join(F.broadcast(groups) if few else groups, F.col("sha256") == F.col("of"), "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("of").isNotNull(), F.lit(False))
    return joined.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "sha1", "length", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write pages (page_id, url, html) as archives into folder; (path, records), a row for each file.

    The dictionary is trained on the heads of SAMPLE_PAGES pages chosen by hash, a bounded sample that decides about compression
    alone.  Null and empty html is an empty payload; pages of any length are one record.  Rows that repeat are written as often as
    they occur, see with_revisits for ties.  An empty table writes no file.  Other columns of pages are not read.
    """
    keyed = pages.filter("html is not null").select(F.xxhash64("page_id", "html").alias("h"), F.substring("html", 1, SAMPLE_BYTES).alias("head"))
    chosen = [r.h for r in keyed.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]  # numbers only; the heads of those alone follow
    sample = keyed.filter(F.col("h").isin(chosen)).groupBy("h").agg(F.min("head").alias("head")).orderBy("h").collect() if chosen else []
    dictionary = train_dictionary([r.head.encode("utf-8", "surrogatepass")[:SAMPLE_BYTES] for r in sample])
    rows = with_revisits(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), "sha1", "length", F.col("refers_to").cast("long"), "revisit")
    return cut(rows.mapInArrow(_writer(folder, dictionary, date), "path string, records long"))


def read_archives(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row per record of the archives (path, records)."""
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.repartition(tasks, "path").mapInArrow(_reader, FIELDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_archives(files)


def op7_sql() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= {LEAST_REVISIT} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_REVISIT} AND page_id <> top THEN top END AS refers_to
FROM g"""
