"""WARC archives compressed with Zstandard: writer and reader.

An archive is a skippable frame that holds the dictionary, then one frame per
record (the layout of .warc.zst files). Archives are rows (archive, content) of a
bounded size, so that any store Spark can write takes them; files read with
spark.read.format("binaryFile") go through the same reader.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import bounded_batches, trimmed

# Fixed values of the formats.
DICT_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
ZSTD_DICT = 0xEC30A437
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 16_000_000
DICT_BYTES = 32_768
DICT_SAMPLE_BYTES = 2_000_000
MIN_REVISIT_BYTES = 1000


def _train(samples: list[bytes]) -> bytes:
    """A dictionary from the first records of an archive; with too few of them, one trained on nothing but their own start."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:4096] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def _dict(data: bytes) -> zstandard.ZstdCompressionDict:
    whole = len(data) >= 4 and struct.unpack("<I", data[:4])[0] == ZSTD_DICT
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if whole else zstandard.DICT_TYPE_RAWCONTENT)


def _record(page_id, url, html: str, digest: str, refers_to) -> bytes:
    payload = html.encode()
    rid = lambda i, d: f"<urn:uuid:{uuid.UUID(hex=hashlib.sha256(f'{i}/{d}'.encode()).hexdigest()[:32])}>"
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", rid(page_id, digest)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", sha),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if url:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload
    if refers_to is not None:
        block = http
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", rid(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (archive string, content binary) of pages (page_id, url, html, digest, refers_to), a task's rows in turn.

    Records are revisits where refers_to is set, else responses. A null html is
    an empty payload. A task holds one archive (archive_bytes before
    compression, or one longer record) at a time.
    """
    bounded_batches(pages.sparkSession)

    def archive(records: list[bytes]) -> bytes:
        samples, size = [], 0
        for r in records:
            if size >= DICT_SAMPLE_BYTES:
                break
            samples.append(r[:65_536])
            size += len(samples[-1])
        d = _train(samples)
        c = zstandard.ZstdCompressor(level=3, dict_data=_dict(d), write_checksum=True, write_content_size=True)
        return struct.pack("<II", DICT_FRAME, len(d)) + d + b"".join(map(c.compress, records))

    @trimmed
    def run(batches):
        task, n, records, size = None, 0, [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([f"{task:08d}-{n:06d}.warc.zst"]), pa.array([archive(records)], pa.binary())], names=["archive", "content"])
        for b in batches:
            for p, page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                task = p
                records.append(_record(page_id, url, html or "", digest, refers_to))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield row()
                    n, records, size = n + 1, [], 0
        if records:
            yield row()

    return pages.select(F.spark_partition_id(), "page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "archive string, content binary")


def frames(content: bytes):
    """The frames of an archive: (is skippable, bytes). Lengths come from the block headers alone."""
    at, n = 0, len(content)
    while at < n:
        if n - at < 8:
            raise ValueError("truncated frame")
        magic = struct.unpack_from("<I", content, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + struct.unpack_from("<I", content, at + 4)[0]
            if end > n:
                raise ValueError("truncated skippable frame")
            yield magic, content[at + 8 : end]
            at = end
            continue
        if magic != ZSTD_FRAME:
            raise ValueError(f"not a frame at byte {at}")
        end = at + zstandard.frame_header_size(content[at : at + 18])
        while True:
            if end + 3 > n:
                raise ValueError("truncated frame")
            head = int.from_bytes(content[end : end + 3], "little")
            end += 3 + (1 if (head >> 1) & 3 == 1 else head >> 3)
            if head & 1:
                break
        end += 4 * ((content[at + 4] >> 2) & 1)  # checksum
        if end > n:
            raise ValueError("truncated frame")
        yield magic, content[at:end]
        at = end


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; ValueError unless version, headers, length and end are right."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("malformed header")
        headers[name.strip().decode().lower()] = value.strip().decode()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise ValueError(f"no {need}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("content-length does not match the record")
    return headers, rest[:-4]


def read_records(content: bytes):
    """(headers, payload) of each record: the dictionary from the leading skippable frame, one record per frame, digests checked."""
    reader = None
    for i, (magic, data) in enumerate(frames(content)):
        if magic != ZSTD_FRAME:
            if magic == DICT_FRAME:
                if i:
                    raise ValueError("a dictionary after the first frame")
                if data[:4] == struct.pack("<I", ZSTD_FRAME):
                    data = zstandard.ZstdDecompressor().decompress(data)
                reader = zstandard.ZstdDecompressor(dict_data=_dict(data))
            continue
        reader = reader or zstandard.ZstdDecompressor()
        headers, block = parse_record(reader.decompress(data, max_output_size=1 << 31) if zstandard.frame_content_size(data) < 0 else reader.decompress(data))
        payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
        digest = headers.get("warc-payload-digest", "")
        if headers["warc-type"] == "response" and digest.startswith("sha1:") and base64.b32decode(digest[5:]) != hashlib.sha1(payload).digest():
            raise ValueError("payload does not match its digest")
        yield headers, payload


READ_SCHEMA = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, record_id string, refers_to_id string, html string"


def read_archives(archives: DataFrame, content: str = "content") -> DataFrame:
    """The records of archives (binary column content). A broken archive is an error, an empty one gives no rows; html is null for revisits."""

    bounded_batches(archives.sparkSession)
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    number = lambda x: int(x) if x else None

    @trimmed
    def run(batches):
        for b in batches:
            for c in b.column(0).to_pylist():
                rows, size = [], 0
                for h, payload in read_records(c or b""):
                    digest = h.get("warc-payload-digest", "")
                    revisit = h["warc-type"] == "revisit"
                    rows.append((number(h.get("x-page-id")), h["warc-type"], int(h.get("x-payload-length", len(payload))), base64.b32decode(digest[5:]).hex() if digest else hashlib.sha1(payload).hexdigest(), number(h.get("x-refers-to-page")), h.get("warc-target-uri"), h["warc-record-id"], h.get("warc-refers-to"), None if revisit else payload.decode()))
                    size += len(payload)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return archives.select(content).mapInArrow(run, READ_SCHEMA)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) plus digest (SHA-1 of the payload) and refers_to.

    Of rows with equal payloads of at least min_bytes, those with the largest
    page_id are responses (refers_to null) and others refer to it; null page_ids
    refer to the largest, and stay responses if there is none. Only digests are
    grouped; the payloads move once, by page_id and digest.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    large = rows.where(F.col("bytes") >= min_bytes).select("page_id", "digest")
    tops = large.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("digest", "top")
    # one row a page after distinct(), so that repeated rows do not multiply; a hot digest is split by AQE's skew join
    later = large.join(tops, "digest").where(~F.col("page_id").eqNullSafe(F.col("top"))).select("page_id", "digest", F.col("top").alias("refers_to")).distinct()
    later = later.withColumnsRenamed({"page_id": "r_id", "digest": "r_digest"})
    return rows.join(later, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM t
"""
