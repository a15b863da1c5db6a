import hashlib

import pytest

from sightline.llm import archives as A

ARC1 = (
    b"filedesc://x.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Internet Archive\n"
    b"URL IP-address Archive-date Content-type Archive-length\n"
    b"\nhttp://a.b/x y 1.2.3.4 199702171021 text/html 31\nHTTP/1.0 200 OK\r\n\r\nHello\nworld\r\n\nftp://f/ 5.6.7.8 19970217 text/plain 4\n\n\n\r\n\n"
)


def test_both_header_versions_and_declared_lengths():
    (one, block), (two, other) = A.arc_records(ARC1)
    assert one["URL"] == "http://a.b/x y" and one["Archive-date"] == "199702171021" and block == b"HTTP/1.0 200 OK\r\n\r\nHello\nworld\r"
    assert two["URL"] == "ftp://f/" and other == b"\n\n\r\n"
    records = [A.arc_record(2, u, "20000101000000", "text/html", b, 7, "n.arc") for u, b in (("http://é/ x", b"\n\nfiledesc: no\n"), (None, b""))]
    (a, x), (b, y) = A.arc_records(A.arc_file(2, "n.arc", "20000101000000", records))
    assert (a["URL"], a["Result-code"], a["Filename"], x) == ("http://%C3%A9/%20x", "200", "n.arc", b"\n\nfiledesc: no\n")
    assert (b["URL"], y) == ("urn:missing", b"")
    with pytest.raises(ValueError):
        list(A.arc_records(A.arc_file(1, "n", "2000", records)[:-8].replace(b" 15\n", b" 999\n")))


def test_dates_ids_and_records():
    assert [A.warc_date(d) for d in ("20010203040506", "200102030405", "20010203")] == ["2001-02-03T04:05:06Z", "2001-02-03T04:05:00Z", "2001-02-03T00:00:00Z"]
    row = {"url": "u", "ip": "1.1.1.1", "date": "20010203", "content_type": "text/html", "page_id": 4, "head": b"HTTP/1.0 200 OK\r\n\r\n", "payload": b"WARC/1.1\r\n\r\nx", "payload_bytes": 13, "payload_digest": "d", "refers_to": None}
    both = A.warc_record(row) + b"\r\n\r\n" + A.warc_record(row | {"refers_to": 2, "head": b""}) + b"\r\n\r\n"
    (f, block), (g, rest) = A.warc_records(both)
    assert f["WARC-Type"] == "response" and block.endswith(b"WARC/1.1\r\n\r\nx") and f["WARC-Record-ID"].startswith("<urn:uuid:")
    assert g["WARC-Type"] == "revisit" and rest == b"" and g["X-Refers-To-Page-Id"] == "2"


def test_round_trip_with_repeated_payloads(spark):
    big = "<p>WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n</p>" * 5
    rows = [(i, f"http://h/{i}", f"page {i} é" * (i * 3)) for i in range(40)] + [(50 + i, "http://same/", big) for i in range(30)]
    rows += [(200, None, None), (201, "http://x y/\n", ""), (202, "u", "small"), (203, "u", "small"), (None, "n", big), (None, "n", "alone" * 50), (60, "http://same/", big), (204, "long", "x" * 3_000_000)]
    pages = spark.createDataFrame([(i, u, h, "q") for i, u, h in rows], "page_id long, url string, html string, payload string").repartition(3)
    got = A.converted(pages).collect()
    raw = [((h or "").encode(), i) for i, _, h in rows]
    first = {}
    for payload, i in raw:
        if len(payload) >= A.LEAST_REVISIT and i is not None:
            first[payload] = min(i, first.get(payload, i))
    want = []
    for payload, i in raw:
        refers = first[payload] if payload in first and first[payload] != i else None
        want.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.sound for r in got)
    assert A.converted(pages.limit(0)).collect() == []


def test_resource_records_and_plain_blocks(spark):
    path = A.shared_path(spark, "resources")
    content = spark.createDataFrame([(bytearray(ARC1),), (None,)], "content binary")
    A.write_warc(A.to_warc(A.parse_arc(content)), path)
    got = {r.target: (r.record_type, r.payload_bytes, r.date) for r in A.read_warc(spark, path).collect()}
    assert got == {"http://a.b/x y": ("response", 12, "1997-02-17T10:21:00Z"), "ftp://f/": ("resource", 4, "1997-02-17T00:00:00Z")}
