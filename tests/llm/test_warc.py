import hashlib
from collections import defaultdict

from prodlake.llm import warc
from prodlake.session import scratch_path

PAGES = "page_id bigint, url string, html string"
LONG = "é" * 700  # 1400 bytes


def want(rows, least=1000):
    of = defaultdict(list)
    for page_id, _, html in rows:
        of[html or ""].append(page_id)
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        keeper = max((p for p in of[html or ""] if p is not None), default=None)
        revisit = len(payload) >= least and page_id != keeper
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = [
        (1, "http://a/", LONG), (9, "http://b/", LONG), (3, None, LONG), (4, "http://x\r\nWARC-Type: revisit\r\n", LONG + "x"),
        (5, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", LONG), (10, "u", "y" * 1000), (11, "u", "y" * 1000),
        (12, "u", "z" * 999), (13, "u", "z" * 999), (14, "u", "w" * 2000), (14, "u", "w" * 2000), (15, "u", "\r\nWARC-Type: revisit\r\n" * 90),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], PAGES + ", header string")
    got = warc.archive_round_trip(pages).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want(rows)


def test_whole_records(spark):
    rows = [(1, "http://a/", LONG), (2, "http://b/", LONG), (3, "http://c/", "é")]
    pages, path = spark.createDataFrame(rows, PAGES), scratch_path(spark, "archive")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 2  # bytes are stored once
    records = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    for page_id, url, html in rows:
        r = records[page_id]
        payload = html.encode()
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert lines[0] == "WARC/1.1" and bytes(r.payload) == payload
        assert fields["WARC-Target-URI"] == url and fields["WARC-Record-ID"] == f"<urn:page:{page_id}>"
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
        body = body.removesuffix(b"\r\n\r\n")
        assert len(body) == int(fields["Content-Length"])
        assert body == (b"" if page_id == 1 else payload)
        assert (fields.get("WARC-Refers-To") == "<urn:page:2>") == (page_id == 1)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in warc.archive_round_trip(pages).collect()), key=repr) == want(rows)


def test_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0
