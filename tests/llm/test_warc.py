"""WARC archives: round trips, foreign archives, repeated ids."""

import gzip
import hashlib

from pyspark.sql import functions as F

from reciprospark.llm import warc

PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark, tmp_path):
    long = "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" + "é" * 900
    rows = [(1, "http://a/b?c", "short"), (2, None, long), (3, "http://a/\r\nX: y", long), (7, "http://z", long), (8, "u", None), (9, "v", ""), (10, "http://a", "short"), (None, "http://a", "x"), (11, "http://b", "\r\n\r\n"), (12, "http://b", "x\r\n\r\n\r\n\r\ny")]
    table = spark.createDataFrame(rows, PAGES).select("*", *[F.lit(1).alias(c) for c in ("digest", "length", "original", "value", "record_id")])
    warc.write_archive(table, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w")).cache()
    assert records.count() == 27
    found = warc.captures(records)
    got = {r.page_id: r for r in warc.payload_report(found).collect()}
    for i, _, html in rows:
        if i is not None:
            raw = (html or "").encode()
            kind = "revisit" if i in (2, 3) else "response"
            assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), kind, 7 if kind == "revisit" else None)
    one = found.filter("page_id = 1").first()
    assert one.request.http_headers.startswith("GET /b?c HTTP/1.1") and bytes(one.response.payload) == b"short" and one.metadata.fields == {"pageId": "1"}


def test_repeated_ids_and_empty_tables(spark, tmp_path):
    long = "long " * 300
    rows = [(1, "http://a", long), (7, "http://b", long), (7, "http://b", long), (8, "http://c", "x"), (8, "http://d", "y")]
    warc.write_archive(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"))
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.payload_report(warc.captures(warc.read_records(spark, str(tmp_path / "w")))).collect()]
    assert sorted(got) == [(1, 1500, "revisit", 7), (7, 1500, "response", None), (7, 1500, "response", None), (8, 1, "response", None), (8, 1, "response", None)]
    warc.write_archive(spark.createDataFrame([], PAGES), str(tmp_path / "e"))
    assert warc.payload_report(warc.captures(warc.read_records(spark, str(tmp_path / "e")))).count() == 0


def record(kind, name, near=(), block=b"", content="application/http"):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *[f"WARC-Concurrent-To: {n}" for n in near], f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    meta = "application/warc-fields"
    first = [
        record("warcinfo", "<i>", content=meta, block=b"software: x"),
        record("response", "<a>", block=http + b"A\xff\r\n\r\nB"), record("request", "<a-r>", ["<a>"], b"GET /a"), record("metadata", "<a-m>", ["<a-r>"], b"k: a\r\n", meta),  # metadata names the request
        record("request", "<b-r>", [], b"GET /b"), record("response", "<b>", ["<b-r>", "<b-m>"], http + b"\r\n\r\n"), record("metadata", "<b-m>", [], b"k: b\r\n", meta),  # the response names both
    ]
    second = [
        record("response", "<c>", block=http), record("metadata", "<c-m>", ["<nowhere>", "<c>"], b"k: c\r\n", meta),  # several, one of them unknown
        record("metadata", "<d-m>", ["<elsewhere>"], b"k: d\r\n", meta), record("response", "<e>", block=http + b"E" * 100_000),
        record("request", "<f-r>", ["<f-m>"], b"GET /f"), record("metadata", "<f-m>", ["<f>"], b"k: f\r\n", meta), record("response", "<f>", block=http + b"F"),  # the request names the metadata
    ]
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in first))  # a member a record
    (folder / "two.warc").write_bytes(b"".join(second))
    got = {r.record_id: r for r in warc.captures(warc.read_records(spark, str(folder))).collect()}
    about = {k: (r.request and r.request.http_headers, r.metadata and r.metadata.fields.get("k"), bytes(r.response.payload)) for k, r in got.items()}
    assert about == {"<a>": ("GET /a", "a", b"A\xff\r\n\r\nB"), "<b>": ("GET /b", "b", b"\r\n\r\n"), "<c>": (None, "c", b""), "<e>": (None, None, b"E" * 100_000), "<f>": ("GET /f", "f", b"F")}
