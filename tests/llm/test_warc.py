import hashlib
import struct

import pytest
import zstandard

from flowlark.llm import warc


def expect(rows, least=1000):
    top = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= least and i is not None:
            top[p] = max(top.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        ref = top.get(p)
        ref = None if ref is None or ref == i else ref
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


def read_back(df, size=warc.ARCHIVE_BYTES):
    archives = warc.write_archives(warc.with_revisits(df), size)
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect()), key=str)


def test_pages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in df.collect()]
    assert read_back(df) == expect(rows) and read_back(df, 20_000) == expect(rows)


def test_odd_pages(spark):
    big, other = "é" * 700, "b" * 1000
    rows = [(1, "u", big), (2, None, big), (2, "u", big), (3, "a\r\nb", None), (4, "u", ""), (None, "u", big), (5, "u", "b" * 999), (6, "u", "b" * 999), (7, "u", other), (9, "u", other), (8, "u", other), (None, None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, top string")
    assert read_back(df) == expect(rows)
    assert read_back(df.limit(0)) == []


def test_html_comes_back(spark):
    df = spark.createDataFrame([(1, "u", "<p>é\r\n\r\nx</p>")], "page_id long, url string, html string")
    r = warc.read_archives(warc.write_archives(warc.with_revisits(df))).first()
    assert (r.html, r.url, r.record_type) == ("<p>é\r\n\r\nx</p>", "u", "response")


def test_reader_rejects_what_is_broken(spark):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string")
    raw = bytes(warc.write_archives(warc.with_revisits(df).coalesce(1)).first().content)
    assert len(list(warc.read_records(raw))) == 40 and raw[:4] == struct.pack("<I", warc.DICT_FRAME)
    for bad in (raw[:-3], raw + b"1234567890", raw[:4], raw + struct.pack("<II", warc.DICT_FRAME, 1) + b"x"):
        with pytest.raises(ValueError):
            list(warc.read_records(bad))
    head, block = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Date: d\r\nContent-Length: 3\r\n\r\n", b"abc\r\n\r\n"
    assert warc.parse_record(head + block)[1] == b"abc"
    for bad in (b"HTTP/1.1" + head[8:] + block, head + b"abcd\r\n\r\n", head.replace(b"WARC-Date: d\r\n", b"") + block, head.replace(b"Type:", b"Type") + block, head + block[:-2]):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    assert list(warc.read_records(b"")) == []


def test_compressed_and_missing_dictionaries():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nWARC-Date: d\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [p for _, p in warc.read_records(zstandard.ZstdCompressor().compress(record))] == [b"abc"]
    d = b"WARC-Type: resource\r\nWARC-Record-ID" * 4
    packed = zstandard.ZstdCompressor().compress(d)
    body = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(record)
    assert [p for _, p in warc.read_records(struct.pack("<II", warc.DICT_FRAME, len(packed)) + packed + body)] == [b"abc"]
