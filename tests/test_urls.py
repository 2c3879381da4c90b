from __future__ import annotations

import io

import pytest

from tableforge.sources import urls as us
from tableforge.sources.urls import read_urls


def _files(tmp_path, *contents):
    out = []
    for i, data in enumerate(contents):
        (tmp_path / f"f{i}").write_bytes(data)
        out.append((tmp_path / f"f{i}").as_uri())
    return out


def test_lines_of_files(spark, tmp_path):
    urls = _files(tmp_path, b"a\nb\r\n\nc", b"", b"d\n")
    found = read_urls(spark, [*urls, urls[2], None, ""])
    assert sorted(r.value for r in found.collect()) == ["", "a", "b", "c", "d", "d"]
    assert found.schema.simpleString() == "struct<value:string>"
    assert "Exchange" not in found._jdf.queryExecution().toString()


def test_no_urls_no_lines(spark):
    assert read_urls(spark, []).collect() == [] and read_urls(spark, [None]).collect() == []


def test_one_path(spark, tmp_path):
    spark.dataSource.register(us.UrlSource)
    (url,) = _files(tmp_path, b"x\ny")
    assert [r.value for r in spark.read.format(us.URL_FORMAT).load(url).collect()] == ["x", "y"]


def test_an_unreadable_url_fails_the_job(spark, tmp_path):
    with pytest.raises(Exception, match="absent"):
        read_urls(spark, [(tmp_path / "absent").as_uri()]).collect()


def test_pieces_must_have_a_size(spark):
    with pytest.raises(Exception, match="pieceBytes"):
        read_urls(spark, [], piece_bytes=0).collect()


def test_every_range_is_a_partition_and_every_line_comes_once(spark):
    # A stand-in for the network: 500 lines behind one address, asked for by byte range.
    data = "".join(f"line {i}\n" for i in range(500)).encode()

    class Ranged(us.UrlSource):
        opener = staticmethod(lambda url, first, last, tag=None: io.BytesIO(data[first : last + 1]))
        extent = staticmethod(lambda url: (len(data), "v1"))

        @classmethod
        def name(cls) -> str:
            return "ranged_urls"

    spark.dataSource.register(Ranged)
    read = spark.read.format("ranged_urls").option("pieceBytes", 700).load("http://example.com/x")
    assert read.rdd.getNumPartitions() == -(-len(data) // 700)
    assert sorted(r.value for r in read.collect()) == sorted(f"line {i}" for i in range(500))
