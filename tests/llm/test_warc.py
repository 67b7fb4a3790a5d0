import gzip
import hashlib
import io

import pytest

from rowsmith.llm import warc

PAGES = "page_id bigint, url string, html string, path string, payload string, digest string"
BIG, OTHER = "<p>é" + "x" * 1200, "y" * 999
ROWS = [
    (1, "http://a/", BIG), (2, None, BIG), (3, "http://b/\r\nWARC-Type: x", BIG), (3, "http://b/", BIG), (4, " c ", OTHER), (5, "d", OTHER), (6, "e", None), (7, "", ""),
    (None, "f", BIG), (8, "long", "z" * 300_000), (None, "g", "w" * 2000), (None, "g", "w" * 2000), (9, "crlf", "a\r\n\r\nWARC/1.1\r\n\r\n"),
]


def expected(rows):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        owner = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        revisit = len(payload) >= 1000 and owner is not None and i != owner
        out.append((str(i), len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("archive_bytes", [500, warc.ARCHIVE_BYTES])
def test_round_trip(spark, archive_bytes):
    pages = spark.createDataFrame([(*r, "p", "q", "d") for r in ROWS], PAGES).repartition(3)
    found = warc.round_trip(spark, pages, archive_bytes=archive_bytes).collect()
    assert sorted(((str(x["page_id"]), x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in found), key=str) == expected(ROWS)
    stored = {(x["page_id"], bytes(x["payload"])) for x in found if x["record_type"] == "response"}
    assert (9, b"a\r\n\r\nWARC/1.1\r\n\r\n") in stored and (8, b"z" * 300_000) in stored and (6, b"") in stored
    assert all(x["payload"] is None for x in found if x["record_type"] == "revisit")
    assert {x["url"] for x in found if x["page_id"] == 3} == {"http://b/", "http://b/%0D%0AWARC-Type: x"} and {x["url"] for x in found if x["page_id"] == 4} == {"%20c%20"}


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def archive():
    one = warc.page_record(1, "u", hashlib.sha1(b"hello").hexdigest(), b"hello", None, "2000-01-01T00:00:00Z", "x")
    two = warc.page_record(2, "u", hashlib.sha1(b"hello").hexdigest(), b"hello", 1, "2000-01-01T00:00:00Z", "y")
    return [warc._member(r, 6) for r in (one, two)]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_each_record_is_a_member_and_read_in_steps(chunk):
    members = archive()
    assert all(gzip.decompress(m).startswith(b"WARC/1.1\r\n") for m in members)
    records = list(warc.Reader(io.BytesIO(b"".join(members)), "a", chunk))
    assert [f["warc-type"] for f, _ in records] == ["response", "revisit"]
    assert [warc.payload_of(f, b) for f, b in records] == [b"hello", None]


def test_damage_is_noticed():
    first, second = archive()
    for broken in (
        (first + second)[:-9], first[:20], b"no archive", warc._member(b"no header", 6), warc._member(gzip.decompress(first).replace(b"hello", b"hallo"), 6),
        warc._member(gzip.decompress(first) + b"more", 6),
    ):
        with pytest.raises(warc.BrokenArchive):
            list(warc.Reader(io.BytesIO(broken), "a"))
    fields, block = next(iter(warc.Reader(io.BytesIO(first), "a")))
    with pytest.raises(warc.BrokenArchive):
        warc.payload_of(fields, block.replace(b"hello", b"hallo"))
