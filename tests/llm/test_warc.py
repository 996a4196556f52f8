import base64
import hashlib

import pytest

from siftlode.llm import warc
from siftlode.llm.shared import shared_path

SCHEMA = "page_id long, url string, html string, block int, rid string"


def rows():
    big = "é€😀" * 9000 + "\r\n\r\nWARC/1.1\r\n\r\n"
    return [
        (1, "http://a/", "x", 0, ""), (2, "http://b/%41", "x", 0, ""), (3, None, "x", 0, None), (4, "u\r\nX: y", "", 0, ""), (5, "u", None, 0, ""),
        (6, "u", big, 0, ""), (7, "u", big, 0, ""), (8, "v", big + "!", 0, ""), (None, "n", "x", 0, ""), (None, "n", "alone", 0, ""), (9, "r", "rep", 0, ""),
        (9, "r", "rep", 0, ""), (10, "q", "z" * 16384, 0, ""), (11, "q", "0\r\n\r\n", 0, ""), (12, "q", big * 2, 0, ""), (12, "q", big * 2, 0, ""),
    ]


@pytest.mark.parametrize("bound", [warc.MAX_BROADCAST, 0])
def test_round_trip(spark, monkeypatch, bound):
    monkeypatch.setattr(warc, "MAX_BROADCAST", bound)
    src = rows()
    docs = spark.createDataFrame(src, SCHEMA).repartition(3)
    path = shared_path(spark, "t")
    warc.write_archives(docs, path)
    got = warc.read_archives(spark, path).collect()
    assert sorted((str(r.page_id), str(r.url)) for r in got) == sorted((str(a), str(b)) for a, b, *_ in src)
    most = {}
    for i, _, h, *_ in src:
        most[h or ""] = max(most.get(h or "", -1), -1 if i is None else i)
    by = {(i, u): (h or "").encode() for i, u, h, *_ in src if (i, u) != (None, "n")}
    for r in got:
        if (r.page_id, r.url) == (None, "n"):
            assert (r.record_type, r.refers_to, r.payload_bytes) in {("revisit", 3, 1), ("response", None, 5)}
            continue
        p = by[r.page_id, r.url]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        of = most[p.decode()]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == of else ("revisit", of))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == p


def test_archives_are_well_formed(spark):
    path = shared_path(spark, "t")
    warc.write_archives(spark.createDataFrame(rows(), SCHEMA), path)
    data = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    found = [f for d in data for f, _ in warc.parsed(d)]
    assert {f["warc-type"] for f in found} == {"response", "revisit", "continuation"}
    for f in found:
        assert f["warc-record-id"].startswith("<urn:uuid:") and "warc-date" in f
        assert ("warc-segment-origin-id" in f) == (f["warc-type"] == "continuation")


def test_lost_segments_and_broken_chunks_fail(spark):
    seg = spark.createDataFrame([("a", 1, None, b"x"), ("a", 3, 3, b"z")], "rid string, seg int, total long, block binary")
    with pytest.raises(Exception, match="gap"):
        warc.reassembled(seg).collect()
    with pytest.raises(Exception, match="bytes of"):
        warc.reassembled(seg.where("seg = 1")).collect()
    ok = spark.createDataFrame([("a", 2, 2, b"y"), ("a", 1, None, b"x"), ("a", 1, None, b"x")], "rid string, seg int, total long, block binary")
    assert bytes(warc.reassembled(ok).first().block) == b"xy"
    with pytest.raises(ValueError, match="short"):
        warc.unchunked(b"4\r\nab\r\n0\r\n\r\n")
    assert warc.unchunked(warc.chunked(b"a" * 9000)) == b"a" * 9000 and warc.unchunked(b"2;x=1\r\nab\r\n0\r\n\r\n") == b"ab"


def test_empty(spark):
    assert warc.op10_warc(spark.createDataFrame([], SCHEMA)).collect() == []
