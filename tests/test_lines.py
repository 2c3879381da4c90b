from __future__ import annotations

import base64
import io
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableforge import fetch_lines, lines_from_values, read_lines
from tableforge.sources import lines
from tableforge.sources.lines import _piece_lines
from tableforge.workspace import fresh_folder


def _brute(data: bytes) -> list[str]:
    """Lines ended by \\n, \\r\\n or a lone \\r; a final terminator opens no further line."""
    parts = re.split("\r\n|\r|\n", data.decode("utf-8", "replace"))
    return parts[:-1] if parts[-1] == "" else parts


SAMPLES = [
    b"",
    b"\n",
    b"\n\n",
    b"one",
    b"one\n",
    b"one\r\ntwo\r\n",
    b"one\rtwo",
    b"one\rtwo\r",
    b"a\r\r\nb\n\rc",
    "naïve\n日本語\r\nü".encode(),
    b"\xff\xfe bad\nok\n",
]


def _pieces(data: bytes, size: int) -> list[str]:
    lines = []
    for start in range(0, len(data), size):
        stream = io.BytesIO(data[max(start - 1, 0):])
        lines += _piece_lines(stream, start, min(start + size, len(data)), len(data))
    return lines


@pytest.mark.parametrize("data", SAMPLES)
def test_pieces_give_each_line_once(data):
    assert list(_piece_lines(io.BytesIO(data), 0, None, None)) == _brute(data)
    for size in range(1, len(data) + 2):
        assert _pieces(data, size) == _brute(data), size


def test_random_bytes_in_pieces():
    rng = random.Random(7)
    for _ in range(300):
        data = bytes(rng.choice(b"ab\n\r") for _ in range(rng.randrange(40)))
        size = rng.randrange(1, 12)
        assert _pieces(data, size) == _brute(data), (data, size)


@settings(deadline=None)
@given(st.binary(max_size=200), st.integers(1, 60))
def test_any_bytes_in_pieces(data, size):
    assert _pieces(data, size) == _brute(data)


@settings(deadline=None)
@given(st.text(alphabet="a\u00e9\u65e5\n\r\x0b\x85\u2028", max_size=80), st.integers(1, 30))
def test_any_text_in_pieces(text, size):
    assert _pieces(text.encode(), size) == _brute(text.encode())


@pytest.mark.parametrize("cut", range(1, 17))
def test_a_short_download_is_an_error(cut):
    data = b"first\nsecond\nlast"
    for start, end in ((0, 4), (0, 18), (4, 12), (6, 13), (13, 18)):
        stream = io.BytesIO(data[max(start - 1, 0):cut])
        try:
            got = list(_piece_lines(stream, start, end, len(data)))
        except OSError:
            continue
        # Whatever is not refused is whole: the cut came after the piece's last line.
        assert got == list(_piece_lines(io.BytesIO(data[max(start - 1, 0):]), start, end, len(data)))


def test_a_whole_read_must_use_up_its_length():
    stream = io.BytesIO(b"a\nhal")
    with pytest.raises(OSError):
        list(_piece_lines(_Sized(b"a\nhal", left=3), 0, None, None))
    assert list(_piece_lines(_Sized(b"a\nb", left=0), 0, None, None)) == ["a", "b"]
    assert list(_piece_lines(stream, 0, None, None)) == ["a", "hal"]


class _Sized(io.BytesIO):
    """A stream that tells how many bytes have not come yet, as an HTTP answer does."""

    def __init__(self, data, left):
        super().__init__(data)
        self.length = left


def test_memory_lines(spark):
    lines = ["a", "", None, " b "]
    df = lines_from_values(spark, lines)
    assert df.columns == ["value"]
    assert [r.value for r in df.collect()] == lines


def test_text_files_break_at_every_terminator(spark, tmp_path):
    data = b"one\r\ntwo\rthree\n\nlast"
    (tmp_path / "f.txt").write_bytes(data)
    assert [r.value for r in read_lines(spark, str(tmp_path)).collect()] == _brute(data)


def _data_url(text: str) -> str:
    return "data:text/plain;base64," + base64.b64encode(text.encode()).decode()


def test_fetch_same_as_text_source(spark):
    texts = ["a\nb", "ü\r\nv\rw", "", "\n", "x" * 100_000 + "\ny"]
    urls = spark.createDataFrame([(_data_url(t),) for t in texts] + [(None,)], "url string")
    expected = sorted(line for t in texts for line in _brute(t.encode()))
    assert sorted(r.value for r in fetch_lines(urls).collect()) == expected


def test_big_http_resource_is_read_in_ranges(spark, tmp_path):
    path = str(tmp_path / "resource")
    data = "".join(f"line {i} é\n" if i % 7 else "\r" for i in range(5000)).encode()
    with open(path, "wb") as f:
        f.write(data)
    asked = fresh_folder(spark, "asked")

    def opener(url, first, last):
        import os
        import uuid

        os.makedirs(asked, exist_ok=True)
        open(f"{asked}/{first}-{last}-{uuid.uuid4().hex}", "w").close()
        stream = open(path, "rb")
        stream.seek(first)
        return stream

    urls = spark.createDataFrame([("http://example.com/resource",)], "url string")
    fetched = fetch_lines(
        urls, piece_bytes=4096, partitions=8, opener=opener, size_of=lambda url: len(data)
    )
    assert sorted(r.value for r in fetched.collect()) == sorted(_brute(data))
    import os

    assert len(os.listdir(asked)) == -(-len(data) // 4096)


def test_http_resource_without_ranges_is_read_whole(spark):
    def opener(url, first, last):
        import io

        assert (first, last) == (0, None)
        return io.BytesIO(b"p\nq\n")

    urls = spark.createDataFrame([("https://example.com/x",)], "url string")
    fetched = fetch_lines(urls, opener=opener, size_of=lambda url: None)
    assert sorted(r.value for r in fetched.collect()) == ["p", "q"]


class _Answer(io.BytesIO):
    def __init__(self, data=b"", status=200, **headers):
        super().__init__(data)
        self.status = status
        self.headers = {k.replace("_", "-"): v for k, v in headers.items()}


def test_size_is_used_only_where_ranges_are_served(monkeypatch):
    def answer_with(answer):
        def urlopen(request, timeout):
            assert request.get_method() == "HEAD"
            if isinstance(answer, Exception):
                raise answer
            return answer

        monkeypatch.setattr(lines.urllib.request, "urlopen", urlopen)
        return lines.url_extent("http://example.com/x")

    assert answer_with(_Answer(Content_Length="12", Accept_Ranges="bytes")) == (12, None)
    assert answer_with(_Answer(Content_Length="12")) is None
    assert answer_with(_Answer(Accept_Ranges="bytes")) is None
    refused = lines.urllib.error.HTTPError("http://example.com/x", 405, "no HEAD", {}, None)
    assert answer_with(refused) is None


def test_the_tag_is_a_strong_etag_or_a_date(monkeypatch):
    def extent(**headers):
        answer = _Answer(Content_Length="12", Accept_Ranges="bytes", **headers)
        monkeypatch.setattr(lines.urllib.request, "urlopen", lambda request, timeout: answer)
        return lines.url_extent("http://example.com/x")

    assert extent(ETag='"a"', Last_Modified="Monday") == (12, '"a"')
    assert extent(ETag='W/"a"', Last_Modified="Monday") == (12, "Monday")
    assert extent(ETag='W/"a"') == (12, None)


def test_a_resource_that_changes_between_its_pieces_fails_the_job(spark):
    def opener(url, first, last, tag):
        if first > 0 and tag == "old":
            raise OSError("changed since it was measured")
        return io.BytesIO(b"one\ntwo\n"[first:])

    urls = spark.createDataFrame([("http://example.com/x",)], "url string")
    same = fetch_lines(urls, opener=opener, size_of=lambda url: (8, "new"), piece_bytes=4)
    assert sorted(r.value for r in same.collect()) == ["one", "two"]
    with pytest.raises(Exception, match="changed since"):
        fetch_lines(urls, opener=opener, size_of=lambda url: (8, "old"), piece_bytes=4).collect()


def test_lone_carriage_returns_are_read_once_and_in_blocks():
    data = b"".join(b"line %d\r" % i for i in range(200_000))

    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, size=-1):
            block = super().read(size)
            self.read_bytes += len(block)
            return block

    total, got = 0, []
    step = len(data) // 8 + 1
    for start in range(0, len(data), step):
        stream = Counted(data[max(start - 1, 0):])
        got += _piece_lines(stream, start, min(start + step, len(data)), len(data))
        total += stream.read_bytes
    assert got == [f"line {i}" for i in range(200_000)]
    assert total < len(data) + 8 * 2 * 64 * 1024


def test_a_range_must_be_answered_with_a_range(monkeypatch):
    asked = []

    def urlopen(request, timeout):
        asked.append(request.get_header("Range"))
        return _Answer(b"x", status=206 if len(asked) == 1 else 200)

    monkeypatch.setattr(lines.urllib.request, "urlopen", urlopen)
    assert lines.open_url("http://example.com/x", 5, 9).read() == b"x"
    with pytest.raises(OSError, match="range"):
        lines.open_url("http://example.com/x", 5, 9)
    lines.open_url("http://example.com/x", 0, None)
    assert asked == ["bytes=5-9", "bytes=5-9", None]


def test_copies_of_one_url_are_all_fetched(spark):
    urls = spark.range(300).selectExpr(f"'{_data_url('same')}' AS url")
    counts = fetch_lines(urls).groupBy("value").count().collect()
    assert [tuple(r) for r in counts] == [("same", 300)]


def test_an_unreadable_url_fails_the_job(spark, tmp_path):
    urls = spark.createDataFrame([(f"file://{tmp_path}/absent",), (_data_url("ok"),)], "url string")
    with pytest.raises(Exception, match="absent"):
        fetch_lines(urls).collect()


def test_fetching_needs_no_package_on_the_executors(tmp_path):
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps(_piece_lines))
    code = (
        "import io, pickle, sys\n"
        "lines = pickle.load(open('f', 'rb'))\n"
        "assert 'tableforge' not in sys.modules\n"
        "print(list(lines(io.BytesIO(b'a\\nb'), 0, None, None)))"
    )
    assert pickle.loads((tmp_path / "f").read_bytes()) is not None
    out = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60
    )
    assert out.stdout.strip() == "['a', 'b']", out.stderr
