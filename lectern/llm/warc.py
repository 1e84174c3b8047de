r"""WARC archives with per-record Zstandard frames and an embedded dictionary.

An archive is a leading skippable frame (magic 0x184D2A5D) that holds a dictionary trained on the archive's own records, then
one frame per record, each compressed alone with that dictionary. Archives are cut by payload size, so a task holds one
archive at a time. They are written by Spark's text writer, one file per row: bytes pass through it unchanged and its line
separator is an empty skippable frame, which every Zstandard reader steps over. So any file system that Spark writes to will do,
and a lost task's half-written archive is discarded by the commit protocol.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.store import new_path, table

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame (magic 0x184D2A50, length 0): all its bytes are ASCII.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
DATE = "2024-01-01T00:00:00Z"


def record(row: dict) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    payload = b"" if row["refers_to"] is not None else row["payload"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        f"WARC-Date: {DATE}",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["refers_to"] is not None:
        head += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _samples(records: list[bytes], sample_bytes: int, piece: int = 32 << 10) -> list[bytes]:
    """Pieces of the records for training: whole small ones, windows of large ones, evenly spread over the archive if they are more than sample_bytes."""
    total = sum(map(len, records))
    piece = max(8, min(piece, total // 16))  # few or short records are cut into windows, so that there are enough samples
    cuts = [(k, s) for k, r in enumerate(records) for s in range(0, len(r), piece)]
    step = max(1.0, total / sample_bytes)
    return [records[k][s : s + piece] for k, s in (cuts[int(i * step)] for i in range(int(len(cuts) / step)))]


def _trained(samples: list[bytes], size: int, level: int) -> zstandard.ZstdCompressionDict:
    """A dictionary of the samples: trained; from the samples repeated where they are too few or too alike; their own bytes where that fails too."""
    short = [s.ljust(8) for s in samples] * max(1, -(-64 // len(samples)), -(-(16 << 10) // sum(map(len, samples))))
    for train in (lambda: zstandard.train_dictionary(size, samples, level=level), lambda: zstandard.train_dictionary(size, short, k=64, d=8, level=level)):
        try:
            return train()
        except zstandard.ZstdError:
            continue
    return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], dictionary_bytes: int = 64 << 10, sample_bytes: int = 4 << 20, level: int = 3) -> bytes:
    """An archive of the records, however few and long they are: a dictionary trained on them all, or, beyond sample_bytes, on windows spread over them."""
    if not records:
        return b""
    dictionary = _trained(_samples(records, sample_bytes), dictionary_bytes, level)
    raw = dictionary.as_bytes()
    packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw + b"".join(packer.compress(r) for r in records)


def _pack(archive_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive(rows, level=level)], pa.binary())], names=["archive"])

        rows, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = record({n: batch.column(n)[k].as_py() for n in batch.schema.names})
                if rows and size + len(row) > archive_bytes:
                    yield out(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row)
        if rows:
            yield out(rows)

    return run


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, read as a stream."""
    dictionary = None
    if len(content) >= 8:
        magic, size = struct.unpack_from("<II", content)
        if magic == DICTIONARY_MAGIC:
            dictionary = zstandard.ZstdCompressionDict(content[8 : 8 + size])
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    with unpacker.stream_reader(io.BytesIO(content), read_across_frames=True) as raw:
        stream = io.BufferedReader(raw, 1 << 16)
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            headers = {}
            while (line := stream.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().partition(":")
                headers[name.lower()] = value.strip()
            size = int(headers["content-length"])
            block = stream.read(size)
            if len(block) != size or stream.read(4) != b"\r\n\r\n":
                raise ValueError("truncated WARC record")
            yield headers, block


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    key = lambda s: int(k) if s and (k := s.removeprefix("<urn:page:").removesuffix(">")) else None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for h, block in records_of(content.as_py()):
                rows.append((key(h["warc-record-id"]), h.get("warc-target-uri"), int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"], key(h.get("warc-refers-to")), block))
                size += len(block)
                if size > 4 << 20:
                    yield out(rows)
                    rows, size = [], 0
            yield out(rows)


def with_revisits(pages: DataFrame, min_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to for each row.

    Of rows with equal payloads of min_bytes or more, those with the smallest id are responses and the others refer to it;
    rows with a null id never are referred to. Only digests found twice are joined back. The minimum is combined before
    the shuffle, and AQE can split the join's hot digest.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").select(F.col("payload_digest").alias("__digest"), "__first")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("__first")), F.col("__first"))
    return (
        rows.join(first, (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_bytes") >= min_bytes), "left")
        .withColumn("refers_to", refers)
        .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
        .drop("__digest", "__first")
    )


def write_warc(pages: DataFrame, path: str, archive_bytes: int = 16 << 20, level: int = 3, **columns) -> None:
    """Writes a record per row as archives of at most archive_bytes of records each (or one record) under path.

    A null payload is empty, a null url has no target header, a null id an empty record id; an empty table writes no archive.
    """
    rows = with_revisits(pages, **columns).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    packed = rows.mapInArrow(_pack(archive_bytes, level), "archive binary")
    packed.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", SEPARATOR).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records (RECORDS) of all archives under path; a revisit's payload is empty."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_unpack, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    whole = F.col("record_type") == "response"  # measured on what was read; a revisit has its original's figures in its headers
    return read_warc(spark, path).select(
        "page_id",
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 100 AND least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND least <> page_id THEN least END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
