import base64
import hashlib

import numpy as np
import pytest
import zstandard

from emberline.llm import warc
from emberline.llm.common import shared_path, written


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://www.b.example.com:80/x?q=1#f", "<p>hi</p>"), (2, "https://a.example.com/", "<p>hi</p>"), (3, None, None), (4, "", ""), (5, "no scheme/with space\r\nEvil: 1", "P*M\x18\x00\x00\x00\x00 in a page P*M\x18\x00\x00\x00\x00"), (6, "http://a.example.com/", "ü" * 70_000), (6, "http://a.example.com/", "ü" * 70_000), (None, "http://z.org", "<p>hi</p>"), (7, "http://a.example.com/", "WARC/1.1\r\n\r\nx"), (8, "http://a.example.com/", "<p>hi</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({})


def test_round_trip(spark, pages):
    out = warc.round_trip(pages.selectExpr("*", "1 AS digest", "2 AS key"), with_payload=True).collect()
    assert len(out) == pages.count()
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    for r in out:
        assert r.payload_bytes == len(html[r.page_id])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html[r.page_id]).digest()).decode()
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) == html[r.page_id])
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in out)
    assert kinds == sorted([(1, "response", None), (2, "revisit", 1), (8, "revisit", 1), (-1, "response", None), (3, "response", None), (4, "revisit", 3), (5, "response", None), (6, "response", None), (6, "response", None), (7, "response", None)])


def test_archives_are_plain_zstandard(spark, pages):
    path = shared_path(spark, "warc")
    warc.write(pages, path)
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect():
        whole = zstandard.ZstdDecompressor().stream_reader(bytes(r.content), read_across_frames=True).read()
        assert whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")


def test_index_is_searched_by_key(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "LINES_PER_BLOCK", 2)
    path = shared_path(spark, "warc")
    warc.write(pages, path)
    blocks = warc.index(spark, path)
    assert blocks.count() >= 4
    keys = spark.createDataFrame([("com,example,a)/",), ("com,example,b)/x?q=1",), ("org,nowhere)/",), (None,)], "key string")
    found = warc.look_up(keys, blocks).collect()
    assert sorted((f.key, f.page) for f in found) == [("com,example,a)/", 2), ("com,example,a)/", 6), ("com,example,a)/", 6), ("com,example,a)/", 7), ("com,example,a)/", 8), ("com,example,b)/x?q=1", 1)]


def test_no_pages(spark, pages):
    assert warc.round_trip(pages.where("false")).count() == 0


@pytest.mark.parametrize(("url", "key"), [("http://www.Example.com:80/A?b#c", "com,example)/A?b"), ("https://user@h.org:8443/", "org,h:8443)/"), (None, "-"), ("http://[bad", "[bad)/")])
def test_surt(url, key):
    assert warc.surt(url) == key


def test_damage_is_noticed(spark, pages):
    good = warc.record("response", "1", "u", b"abc", "D", None)
    assert warc.parse(good)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(good[:-5])


def test_archives_are_bounded_by_bytes_and_read_by_range(spark, monkeypatch):
    """Pages of several MB that don't compress: an archive holds a few, and a look-up reads no more than the records' bytes."""
    rng = np.random.default_rng(0)
    rows = [(i, f"http://h{i % 5}.org/{i}", rng.integers(0x4E00, 0x9FFF, 1_500_000 if i < 4 else 2000).astype("<u2").tobytes().decode("utf-16-le")) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = shared_path(spark, "warc")
    warc.write(pages, path, archive_bytes=6 << 20)
    sizes = [r.length for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("length").collect()]
    assert len(sizes) >= 3 and max(sizes) <= 6 << 20
    found = written(warc.look_up(spark.createDataFrame([("org,h2)/7",), ("org,h1)/1",)], "key string"), warc.index(spark, path)), "found")
    got = {r.page_id: (r.url, bytes(r.payload)) for r in warc.read(found, path).collect()}
    assert got == {i: (rows[i][1], rows[i][2].encode()) for i in (7, 1)}
    assert {r.page_id for r in warc._read_whole(found, path).collect()} == {7, 1}
    assert warc.read(found.where("false"), path).count() == 0


def test_a_file_is_opened_once_and_read_in_order(tmp_path, spark, monkeypatch):
    path = shared_path(spark, "warc")
    warc.write(spark.range(300).selectExpr("id AS page_id", "concat('http://a.org/', id) AS url", "repeat(cast(id AS string), 50) AS html").coalesce(1), path)
    found = written(warc.look_up(spark.range(0, 300, 3).selectExpr("concat('org,a)/', id) AS key"), warc.index(spark, path)), "found")
    assert sorted(r.page_id for r in warc.read(found, path).collect()) == list(range(0, 300, 3))
    monkeypatch.setattr(warc, "READ_GAP", -1)
    assert sorted(r.page_id for r in warc.read(found, path).collect()) == list(range(0, 300, 3))


def test_paths_that_only_spark_reads_are_told():
    assert warc._seekable("file:///tmp/x") and warc._seekable("/tmp/x") and not warc._seekable("viewfs://cluster/x")
