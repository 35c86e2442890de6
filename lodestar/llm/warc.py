"""WARC (10): Zstandard archives with a leading dictionary, written and read back.

An archive is one byte string: a skippable frame that holds the dictionary, then one frame per
record. A record whose payload another page also has, with a larger page_id, is a revisit. Archives
are rows (archive, content) of a table, the shape in which Spark's binaryFile source gives files.

Defined results: a null html is an empty payload; a null url is an empty target. A null page_id is
smaller than all others. Rows that repeat a page_id and payload are records of the same type. An
empty table gives no archives. Extra columns are ignored. A damaged archive raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import salted_lookup, stored, tune

# Fixed values of the two formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of payload in an archive, bytes of its dictionary, and records from which that is trained.
ARCHIVE_BYTES, DICT_BYTES, DICT_RECORDS = 8 << 20, 16 << 10, 128
#: Every record's date; the pages have none.
DATE = "2000-01-01T00:00:00Z"
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 0

READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_of(name: str | None) -> int | None:
    if name is None or name == record_id(None):
        return None
    if not (m := re.fullmatch(r"<urn:page:(-?\d+)>", name)):
        raise ValueError(f"record id {name!r}")
    return int(m[1])


def record(page: int | None, url: str, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One record: header, block (an HTTP response; without its body in a revisit), two line ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url, safe='/:?#[]@!$&()*+,;=%~-._')}", f"WARC-Block-Digest: sha1:{digest(block)}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


# Records that hold no page.
OTHER_RECORDS = ("warcinfo", "request", "metadata", "resource", "conversion", "continuation")


def parse(data: bytes) -> dict:
    """A record's fields, after its lengths and digests have been checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"header line {line!r}")
        fields[name.strip().lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ValueError(f"header without {sorted(missing)}")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"length {fields['content-length']} of a block of {len(rest) - 4} bytes")
    block, kind = rest[:-4], fields["warc-type"]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest")
    if kind in OTHER_RECORDS:
        return {"record_type": kind}
    http, found, payload = block.partition(b"\r\n\r\n")
    if kind not in ("response", "revisit") or not found or not (size := re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)):
        raise ValueError(f"{kind} record without an HTTP header")
    given = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (int(size[1]) != len(payload) or given != digest(payload)):
        raise ValueError("payload length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("revisit with a payload or without what it refers to")
    return {"page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(size[1]), "payload_digest": given, "record_type": kind, "refers_to": page_of(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None}


def archive(records: list[bytes]) -> bytes:
    """Dictionary frame, then a frame for each record."""
    samples = records[:DICT_RECORDS]
    try:
        trained = zstd.train_dictionary(DICT_BYTES, samples, level=3).as_bytes()
    except zstd.ZstdError:  # too few or too short samples: raw content serves as a dictionary
        trained = b"".join(samples)[:DICT_BYTES].ljust(8, b"\0")
    made = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(trained), write_checksum=True)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(trained)) + trained + b"".join(made.compress(r) for r in records)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at `at` ends, by its own header and block sizes."""
    if len(data) < at + 6 or int.from_bytes(data[at : at + 4], "little") != FRAME_MAGIC:
        raise ValueError(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    here = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        if here + 3 > len(data):
            raise ValueError("frame cut short")
        head = int.from_bytes(data[here : here + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        here += 3 + (1 if kind == 1 else size)
    here += 4 * (flags >> 2 & 1)
    if here > len(data):
        raise ValueError("frame cut short")
    return here


def records(content: bytes) -> Iterator[dict]:
    """The pages' records of an archive, in order; other records are validated and passed over."""
    if len(content) < 8:
        raise ValueError("no dictionary frame")
    magic, size = struct.unpack("<II", content[:8])
    if magic != SKIPPABLE_MAGIC or len(content) < 8 + size:
        raise ValueError("no dictionary frame")
    words = content[8 : 8 + size]
    if words[:4] == FRAME_MAGIC.to_bytes(4, "little"):
        words = zstd.ZstdDecompressor().decompress(words)
    reader = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(words))
    view, at = memoryview(content), 8 + size
    while at < len(view):
        end = frame_end(view, at)
        one = reader.decompressobj()  # a frame need not say its content's size
        try:
            data = one.decompress(bytes(view[at:end]))
        except zstd.ZstdError as e:
            raise ValueError(f"frame at byte {at}: {e}") from e
        if not one.eof:
            raise ValueError(f"frame at byte {at} cut short")
        found = parse(data)
        if found["record_type"] not in OTHER_RECORDS:
            yield found
        at = end


def with_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, record_type, refers_to. Only ids and digests meet by digest, in salted groups; payloads meet them by page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.cast("binary").alias("payload"), F.sha1(html).alias("sha"))
    ids = page.select("page_id", "sha", F.length("payload").alias("n")).filter(F.col("n") >= min_bytes)
    owners = ids.groupBy("sha").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies")).filter("copies > 1").select("sha", "owner")
    revisits = salted_lookup(ids, owners, ["sha"], "page_id", "inner").filter(~F.col("page_id").eqNullSafe(F.col("owner"))).select("page_id", "sha", "owner").distinct()
    a, b = page.alias("a"), revisits.alias("b")
    both = a.join(b, F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.sha") == F.col("b.sha")), "left")
    return both.select("a.page_id", "a.url", "a.payload", F.when(F.col("b.sha").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("b.owner").alias("refers_to"))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """archive, content: the records of all pages, in archives of about `archive_bytes` of payload."""
    tune(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, n, size, held = TaskContext.get().partitionId(), 0, 0, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{pid:06d}-{n:06d}.warc.zst"]), pa.array([archive(held)], pa.binary())], ["archive", "content"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "record_type", "refers_to")), strict=True):
                held.append(record(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    n, size, held = n + 1, 0, []
        if held:
            yield out()

    return with_types(pages, min_bytes).mapInArrow(run, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives given as rows with their bytes in `content`."""
    tune(archives.sparkSession)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for content in batch.column("content"):
                for r in records(content.as_py()):
                    held.append(r)
                    if len(held) >= 256:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return archives.select("content").mapInArrow(run, READ).select(*names)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from written archives."""
    return read_archives(stored(write_archives(pages), "archives")).drop("url", "payload")


#: The query's result in DuckDB SQL; base32 by groups of 5 bytes.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM q
"""
