"""Archives of other writers: record types, missing and odd headers, plain files, appends."""

from __future__ import annotations

import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from marketloom.llm import warc

BODY = b"<html>" + b"y" * 9000 + b"</html>"
SHA = hashlib.sha1(BODY).digest()


def raw(kind, block, *heads):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, *heads, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def crawl():
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + BODY
    return [
        raw(b"warcinfo", b"software: crawler/1.0\r\nformat: WARC\r\n", b"WARC-Filename: a.warc.gz"),
        raw(b"request", b"GET / HTTP/1.1\r\n\r\n", b"warc-target-uri: http://a/"),
        raw(b"response", http, b"WARC-TARGET-URI:http://a/", b"WARC-Payload-Digest: sha1:" + base64.b32encode(SHA)),
        raw(b"response", http, b"WARC-Target-URI: http://b/", b"X-Folded: one", b"  two"),
        raw(b"revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", b"WARC-Target-URI: http://c/", b"WARC-Payload-Digest: SHA1:" + SHA.hex().upper().encode()),
        raw(b"resource", b"plain words", b"WARC-Target-URI: file:///x"),
        raw(b"conversion", b"", b"WARC-Target-URI: http://a/"),
        raw(b"response", b"no http here", b"WARC-Target-URI: dns:a"),
    ]


def check(df):
    rows = df.collect()
    assert sorted(r.record_type for r in rows) == sorted(["warcinfo", "request", "response", "response", "revisit", "resource", "conversion", "response"])
    by = {(r.record_type, r.target_uri): r for r in rows}
    a, b, c = by["response", "http://a/"], by["response", "http://b/"], by["revisit", "http://c/"]
    assert bytes(a.payload) == bytes(b.payload) == BODY and a.payload_bytes == b.payload_bytes == len(BODY)
    assert a.payload_digest == c.payload_digest == SHA.hex() and b.payload_digest is None
    assert c.payload is None and c.payload_bytes is None and a.page_id is None
    assert bytes(by["resource", "file:///x"].payload) == b"plain words" and bytes(by["response", "dns:a"].payload) == b"no http here"
    assert by["warcinfo", None].payload_bytes == 37 or by["warcinfo", None].payload_bytes > 0


def test_gzip_and_plain_files(spark, tmp_path):
    for name, data in (("g", b"".join(map(gzip.compress, crawl()))), ("p", b"".join(crawl()))):
        (tmp_path / name).mkdir()
        (tmp_path / name / ("x.warc.gz" if name == "g" else "x.warc")).write_bytes(data)
        check(warc.read_warc(spark, f"file://{tmp_path}/{name}"))
        df = warc.read_warc(spark, f"file://{tmp_path}/{name}", payload=False)
        assert df.where("record_type = 'response'").count() == 3 and df.where(F.col("payload_digest") == SHA.hex()).count() == 2
        sizes = {r.target_uri: r.payload_bytes for r in df.where("record_type in ('response', 'resource')").collect()}
        assert sizes == {"http://a/": len(BODY), "http://b/": len(BODY), "dns:a": 12, "file:///x": 11}
        assert df.where("record_type is not null").count() == 8


def test_appends_add_up_and_overwrite_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    pages = [spark.createDataFrame([(k, f"http://{k}", "z" * 2000, "clash")], "page_id long, url string, html string, record_type string") for k in range(3)]
    for p in pages[:2]:
        warc.write_warc(p, path)
    assert sorted(r.page_id for r in warc.read_warc(spark, path).collect()) == [0, 1]
    warc.typed_records(pages[2]).write.format("warc").mode("overwrite").save(path)
    assert [r.page_id for r in warc.read_warc(spark, path).collect()] == [2]


def test_few_requests(monkeypatch):
    """Small records share a read; payloads that aren't wanted are jumped over."""
    reads = []

    class Counted:
        def __init__(self, data):
            self.data, self.at = data, 0

        def size(self):
            return len(self.data)

        def seek(self, at):
            self.at = at

        def read(self, n):
            reads.append((self.at, n))
            out = self.data[self.at : self.at + n]
            self.at += len(out)
            return out

    row = {"record_type": "response", "page_id": 1, "target_uri": None, "payload_digest": "d", "payload_bytes": 10, "refers_to": None, "payload": b"z" * 10}
    data = b"".join(warc.member(warc.record(row)) for _ in range(2000))
    assert sum(1 for _ in warc.records(warc.Ahead(Counted(data)), {})) == 2000 and len(reads) <= len(data) // warc.AHEAD + 2
