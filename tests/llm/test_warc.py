"""Archives: exact round trip, revisits, odd pages."""

import base64
import gzip
import hashlib

import pytest

from heddle.llm.warc import archive, archived_pages, members, parse, read_archives, resolve_revisits, rewrite_archives
from heddle.plans.storage import shared_path

PAGES = [(5, "http://a/?q=é\r\nX: y", "<p>same</p>"), (2, None, "<p>same</p>"), (9, "u9", "<p>same</p>"), (7, "u7", None), (8, "u8", ""), (1, "u1", "x\r\n\r\nWARC/1.1\r\n" * 50), (None, "un", "<p>same</p>"), (4, "u4", "é漢" * 70_000), (9, "u9", "<p>same</p>"), (None, "um", "only")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, payload string")


def expected():
    out, rows = [], [(p, (h or "").encode()) for p, _, h in PAGES]
    for h in {h for _, h in rows}:
        own = sorted((p for p, x in rows if x == h), key=lambda p: (p is None, p))
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        out += [(p, len(h), digest, "revisit" if i else "response", own[0] if i else None) for i, p in enumerate(own)]
    return sorted(out, key=str)


def test_round_trip(pages):
    assert sorted((tuple(r) for r in archived_pages(pages).collect()), key=str) == expected()


def test_files_are_warc_and_payloads_whole(spark, pages):
    path = shared_path(spark, "warc-test")
    manifest = archive(pages.repartition(3), path).collect()
    assert sum(m.records for m in manifest) == len(PAGES)
    back = read_archives(spark, path).collect()
    payloads = {h for _, _, h in PAGES}
    assert {bytes(r.payload) for r in back if r.record_type == "response"} == {(h or "").encode() for h in payloads}
    names = {r.record_id for r in back}
    assert len(names) == len(PAGES) and all(r.refers_to_id in names for r in back if r.record_type == "revisit")
    raw = spark.sparkContext.binaryFiles(f"{path}/*.warc.gz").collect()
    for _, data in raw:
        assert b"".join(members(data)) == gzip.decompress(data)
        for m in members(data):
            h = parse(m)
            assert len(h["block"]) == int(h["content-length"]) and m.endswith(b"\r\n\r\n")


def test_small_payloads_can_be_left_alone(spark, pages):
    path = shared_path(spark, "warc-test")
    archive(pages, path, min_payload=5)
    assert all(r.record_type == "response" for r in read_archives(spark, path, False).collect() if r.payload_bytes < 5)


def test_rewriting_resolves_again(spark, pages):
    one, two = shared_path(spark, "warc-test"), shared_path(spark, "warc-test")
    archive(pages, one)
    rewrite_archives(spark, one, two)
    get = lambda p: sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_archives(spark, p, False).collect()), key=str)
    assert get(one) == get(two) == expected()


def test_no_pages_and_broken_archives(spark, pages):
    assert archived_pages(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        list(members(gzip.compress(b"abc")[:-3]))
    with pytest.raises(ValueError):
        parse(b"HTTP/1.1 200 OK\r\n\r\n")


def test_very_long_pages_and_equal_digests(spark):
    long = "<p>é" * 4_000_000
    df = spark.createDataFrame([(3, "u", long), (1, "v", long), (2, "w", long + "x")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in archived_pages(df).collect()}
    size = len(long.encode())
    assert got == {1: (size, "response", None), 2: (size + 1, "response", None), 3: (size, "revisit", 1)}
    # payloads that share a SHA-1 but no SHA-256 are not equal
    headers = spark.createDataFrame([(0, 1, "u", 5, "D", "x"), (1, 2, "u", 5, "D", "y"), (2, 3, "u", 5, "D", "y")], "row long, page_id long, url string, payload_bytes long, payload_digest string, payload_sha256 string")
    assert [(r.row, r.refers_to) for r in resolve_revisits(headers).collect()] == [(2, 2)]
