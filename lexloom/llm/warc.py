"""WARC archives: write them, normalise monolithic gzip files, and read records back through an offset index.

A monolithic archive is one gzip stream over many records, so no record can be read without inflating all before it.
normalise() inflates such a file once, as a stream, writes every record as a gzip member of its own and keeps a sidecar
index (one JSON line a record: id, type, offset, length). read_records() opens the index and reads members by their offsets.

Files go to the shared folder through pyarrow's file systems: under a temporary name first, then renamed, so a task that
runs twice leaves one whole file. Python holds one record and one buffer at a time.

Defined cases: null html is an empty payload; a null or unusable url becomes urn:page:<page_id>; a null page_id is
written as such and never refers or is referred to unless all rows of its payload lack an id; rows that repeat the
largest page_id of a payload are all responses, with record ids of their own, and its revisits then name the page, not a record; an empty table writes no archive and gives an empty result.
"""

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

CHUNK = 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ARCHIVES = "archive string, records long"


def record_id(key: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}"


def build_record(page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, key: str, refers_key: str | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that names the response it repeats. key, refers_key: what their record ids are made of."""
    uri = url if url and not re.search(r"[\x00-\x20\x7f]", url) else f"urn:page:{page_id}"
    block = HTTP + (payload if refers_to is None else b"")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id(key)}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("X-Page-ID", page_id), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", refers_to)]
    if refers_key is not None:
        head += [("WARC-Refers-To", f"<{record_id(refers_key)}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head)).encode() + b"\r\n" + block + b"\r\n\r\n"


def inflate(source) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or many members, read as a stream."""
    z, data = zlib.decompressobj(31), source.read(CHUNK)
    while data:
        yield z.decompress(data, CHUNK)
        while z.unconsumed_tail:
            yield z.decompress(z.unconsumed_tail, CHUNK)
        if z.eof:
            data, z = z.unused_data, zlib.decompressobj(31)
            data = data or source.read(CHUNK)
        else:
            data = source.read(CHUNK)


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record as it stands) of each record of a plain WARC stream."""
    buffer = bytearray()

    def fill(size: int) -> bool:
        while len(buffer) < size:
            more = next(chunks, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while True:
        start = 0
        while (end := buffer.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(buffer) - 3)
            if not fill(len(buffer) + 1):
                if bytes(buffer).strip():
                    raise ValueError("the archive ends within a record's header")
                return
        headers = parse_headers(bytes(buffer[:end]))
        size = end + 4 + int(headers["content-length"]) + 4
        if not fill(size):
            raise ValueError("the archive ends within a record")
        yield headers, bytes(buffer[:size])
        del buffer[:size]


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record here: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


class _Output:
    """A file under a temporary name until it is closed."""

    def __init__(self, uri: str, attempt: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{attempt}.part"
        self.stream, self.size = self.fs.open_output_stream(self.part, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.path)


def write_monolithic(records: DataFrame, folder: str, roll: int = 64 << 20, level: int = 1) -> DataFrame:
    """Write records (page_id, url, payload, digest, refers_to, first) as .warc.gz files of one gzip stream each, about `roll` plain bytes a file.

    first: whether the response with this payload is one record only, which has an id of its page and payload; other ids hold the record's place.

    Gives archive, records: run it once, by writing its result.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), str(task.taskAttemptId())
        out, z, plain, count, number = None, None, 0, 0, 0
        for batch in batches:
            for x in batch.itertuples(index=False):
                if out is None:
                    uri = f"{folder}/part-{part:06d}-{number:04d}.warc.gz"
                    out, z, plain, count, number = _Output(uri, attempt), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0, number + 1
                named = f"page:{x.page_id if x.refers_to is None else x.refers_to}:{x.digest}" if x.first else None
                key = named if named and x.refers_to is None else f"place:{x.page_id}:{uri}:{count}"
                record = build_record(x.page_id, x.url, x.payload, x.digest, x.refers_to, key, named)
                out.write(z.compress(record))
                plain, count = plain + len(record), count + 1
                if plain >= roll:
                    out.write(z.flush())
                    out.close()
                    out = None
                    yield pd.DataFrame({"archive": [uri], "records": [count]})
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pd.DataFrame({"archive": [uri], "records": [count]})

    return records.select("page_id", "url", "payload", "digest", "refers_to", "first").mapInPandas(write, ARCHIVES)


def normalise_file(source_uri: str, target_uri: str, attempt: str = "0", level: int = 3) -> tuple[int, int]:
    """Rewrite one archive with a member for every record, and its index beside it as <target>.idx: a JSON line a record. Gives records, bytes."""
    fs, path = pafs.FileSystem.from_uri(source_uri)
    out, records = _Output(target_uri, attempt), 0
    side = _Output(f"{target_uri}.idx", attempt)
    with fs.open_input_stream(path, compression=None) as source:
        for headers, record in split_records(inflate(source)):
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            member, offset = z.compress(record) + z.flush(), out.size
            out.write(member)
            entry = {"id": headers.get("warc-record-id", "").strip("<>"), "type": headers.get("warc-type"), "offset": offset, "length": len(member)}
            side.write((json.dumps(entry) + "\n").encode())
            records += 1
    out.close()
    side.close()
    return records, out.size


def one_a_task(archives: DataFrame) -> DataFrame:
    """The rows of a table of archives, each in a partition of its own while there are no more than 20,000; such a number, Spark does not lower."""
    return archives.repartition(int(min(max(archives.count(), 1), 20_000)))


def normalise(archives: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Normalise every archive of `archives` (archive: uri) into folder, each with its index beside it. Gives archive, records, bytes: run it once, by writing its result."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = str(TaskContext.get().taskAttemptId())
        for batch in batches:
            for uri in batch["archive"]:
                target = f"{folder}/{uri.rpartition('/')[2]}"
                yield pd.DataFrame([(target, *normalise_file(uri, target, attempt, level))], columns=["archive", "records", "bytes"])

    return one_a_task(archives.select("archive")).mapInPandas(rewrite, f"{ARCHIVES}, bytes long")


def read_index(uri: str) -> Iterator[dict]:
    """The entries (id, type, offset, length) of an archive's index, a line at a time."""
    fs, path = pafs.FileSystem.from_uri(f"{uri}.idx")
    with fs.open_input_stream(path, compression=None) as side:
        rest = b""
        while data := side.read(CHUNK):
            *lines, rest = (rest + data).split(b"\n")
            yield from map(json.loads, lines)


def read_member(file, entry: dict) -> bytes:
    """The record of an index entry, whatever stands before it in the open archive."""
    return zlib.decompress(file.read_at(entry["length"], entry["offset"]), 31)


def read_records(archives: DataFrame) -> DataFrame:
    """Read normalised archives by their indexes: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for a revisit)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["archive"]:
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as file:
                    rows, size = [], 0
                    for entry in read_index(uri):
                        rows.append(_parsed(read_member(file, entry)))
                        size += len(rows[-1][-1] or b"")
                        if len(rows) == 500 or size > 16 * CHUNK:
                            yield pd.DataFrame(rows, columns=COLUMNS)
                            rows, size = [], 0
                    yield pd.DataFrame(rows, columns=COLUMNS)

    return one_a_task(archives.select("archive")).mapInPandas(read, "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")


COLUMNS = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]


def _parsed(record: bytes) -> tuple:
    end = record.index(b"\r\n\r\n")
    h = parse_headers(record[:end])
    block = record[end + 4 : end + 4 + int(h["content-length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    if h["warc-type"] == "response":
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(h["x-payload-length"]):
            raise ValueError(f"record {h['warc-record-id']} is damaged")
        return h["x-page-id"], h["warc-target-uri"], "response", len(payload), digest, None, payload
    return h["x-page-id"], h["warc-target-uri"], "revisit", int(h["x-payload-length"]), digest, h["x-refers-to-page"], None


def page_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """The records of a page table, equal payloads of `least` bytes or more as revisits of the one with the largest page_id."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"))
    large = rows.where(F.octet_length("payload") >= least)
    each = large.groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    repeated = each.groupBy("digest").agg(F.max("page_id").alias("last"), F.max_by("n", "page_id").alias("rows"), F.sum("n").alias("n")).where("n > 1 AND last IS NOT NULL").select(F.col("digest").alias("_d"), "last", "rows")
    # few payloads repeat: Spark broadcasts this side if it is small, and otherwise may split a skewed digest
    joined = rows.join(repeated, F.when(F.octet_length("payload") >= least, F.col("digest")) == F.col("_d"), "left")
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last").cast("string"))
    return joined.select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page_id"), "url", "payload", "digest", refers.alias("refers_to"), F.coalesce(F.col("rows") == 1, F.lit(False)).alias("first"))


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write a page table as monolithic archives, normalise them, read every record back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    ws = Workspace(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType
    archives = ws.save(write_monolithic(page_records(pages, least), ws.path("monolithic")), "archives")
    members = ws.save(normalise(archives, ws.path("members")), "normal")
    ws.drop("monolithic")
    page = F.when(F.col("page_id") != "null", F.col("page_id")).cast(kind)
    return read_records(members).select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


#: DuckDB SQL for op6_warc.
ORACLE_SQL = """
WITH r AS (
  SELECT page_id, encode(coalesce(html, '')) AS p, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT payload_digest, max(page_id) AS first FROM r WHERE octet_length(p) >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, CAST(octet_length(p) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN octet_length(p) >= 1000 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(p) >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM r LEFT JOIN f USING (payload_digest)
"""
