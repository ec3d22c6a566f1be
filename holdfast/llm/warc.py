"""WARC archives: a deterministic sharded writer and its reader.

Records go to shards by ranges of page_id, are sorted there and written as
gzip members. A file is closed when its compressed size passes ``roll_bytes``;
it gets its name only when complete, and the manifest lists every file. All
headers and digests are made anew from the payload, and nothing depends on the
run: the same table gives the same bytes.

Of equal payloads the page with the greatest id is written as a response, the
others as revisits that name it. Who revisits whom is found on digests alone;
these small rows are sorted in among the pages they belong to, so the payloads
are shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.storage import committed, open_file, range_shards
from holdfast.session import drop, land, scratch_path

SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
DATE = "2020-01-01T00:00:00Z"  # a record's date would differ from run to run
_MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    inner = name.removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One uncompressed record; ``refers_to`` (a record name) makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        # control characters would end the header
        f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127)))) if url else _name(page_id)[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)  # no name, no time
    return gzip.compress(data) + gzip.flush()


def _info(name: str) -> bytes:
    block = b"software: holdfast\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Date: {DATE}\r\n"
    head += f"WARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return _member(head.encode() + block + b"\r\n\r\n")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(shard, record) of each page; a note that it is a revisit comes just before it."""
    noted, refers_to = None, None
    for batch in batches:
        columns = [batch.column(c) for c in ("shard", "page_id", "sha", "note", "url", "html", "refers_to")]
        for row in zip(*columns):
            shard, page_id, sha, note, url = (x.as_py() for x in row[:5])
            if note == 0:
                noted, refers_to = (page_id, sha), row[6].as_py()
                continue
            payload = (row[5].as_py() or "").encode()
            known = _name(refers_to) if noted == (page_id, sha) else None
            yield shard, record(page_id, url, payload, known)


def _writer(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = _records(batches)
        current, part, last = next(todo, None), 0, None
        while current:
            shard = current[0]
            part = part + 1 if shard == last else 0
            last = shard
            name = f"shard-{shard:06d}-{part:05d}.warc.gz"
            with committed(folder, name) as out:
                head = _info(name)
                out.write(head)
                size, count = len(head), 0
                while current and current[0] == shard and size < roll_bytes:
                    data = _member(current[1])
                    out.write(data)
                    size, count = size + len(data), count + 1
                    current = next(todo, None)
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "file": name, "records": count, "bytes": size}], schema=_MANIFEST
            )

    return run


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the pages whose payload a greater page_id has too.

    Payloads below ``min_bytes`` are never revisited. Rows that share the greatest
    page_id are all responses; a null id is below every other.
    """
    sized = pages.filter(F.octet_length("html") >= min_bytes) if min_bytes else pages
    digests = sized.select("page_id", "sha")
    shared = digests.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    path = scratch_path(pages.sparkSession, "shared")
    shared = land(shared.filter("n > 1 AND refers_to IS NOT NULL").drop("n"), path)
    older = F.coalesce(F.col("page_id") < F.col("refers_to"), F.lit(True))
    return digests.join(shared, "sha").filter(older).select("page_id", "sha", "refers_to").distinct()


def write(
    pages: DataFrame,
    folder: str,
    *,
    min_bytes: int = 0,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write (page_id, url, html) as WARC files; returns the manifest, landed beside them.

    Null html is an empty payload; a null url is replaced by the record's name.
    Null ids are in the first shard. Repeated rows are all written. An empty
    table has no files.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    plain = plain.withColumn("sha", F.unhex(F.sha1("html")))
    shard, shards = range_shards(plain, "page_id", F.octet_length("html") + 512, shard_bytes, F.col("sha"))
    path = scratch_path(spark, "revisits")
    notes = land(revisits(plain, min_bytes), path)
    none = F.lit(None).cast("string")
    both = plain.select("page_id", "sha", F.lit(1).alias("note"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    both = both.union(notes.select("page_id", "sha", F.lit(0), none, none, "refers_to")).withColumn("shard", shard)
    order = ["shard", "page_id", "sha", "note", "url"]
    placed = both.repartitionById(shards, F.col("shard")).sortWithinPartitions(*order)
    manifest = land(placed.mapInArrow(_writer(folder, roll_bytes), "shard int, file string, records long, bytes long"), f"{folder}/manifest")
    drop(spark, path)
    return manifest


def read_records(source, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an open file of gzip members."""
    data, gzip, out = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = source.read(chunk)
            if not data:
                return
        out.append(gzip.decompress(data))
        data = gzip.unused_data
        if gzip.eof:
            head, _, rest = b"".join(out).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            gzip, out = zlib.decompressobj(31), []


def _parse(headers: dict[str, str], block: bytes) -> dict | None:
    """A page's row; the digests in the headers must be those of the bytes."""
    if headers["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    response = headers["WARC-Type"] == "response"
    if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}" or response and (digest(payload), len(payload)) != (stated, length):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return {
        "page_id": _number(headers["WARC-Record-ID"]),
        "url": headers["WARC-Target-URI"],
        "payload_bytes": length,
        "payload_digest": stated,
        "record_type": headers["WARC-Type"],
        "refers_to": None if response else _number(headers["WARC-Refers-To"]),
    }


def _reader(folder: str):
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with open_file(folder, name) as source:
                    rows = [row for row in (_parse(*x) for x in read_records(source)) if row]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per page record of the files that the manifest lists."""
    files = max(1, manifest.count())
    return manifest.repartition(files, "file").select("file").mapInArrow(_reader(folder), _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    return read_back(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder).drop("url")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (((strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 + 1 AS INTEGER), 1)) - 1) * 16
      + strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 + 2 AS INTEGER), 1)) - 1) >> (3 - 5 * i % 4)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM q
"""
