"""Bounded lines and envelopes read piece by piece, against whole-file readings."""

from __future__ import annotations

import gzip
import io
import json
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from kvspace.sources import files, readers


def lines_of(raw: bytes, longest: int):
    parts = raw.split(b"\n")
    parts = parts[:-1] if parts[-1] == b"" else parts
    return [None if len(p) > longest else p.removesuffix(b"\r") for p in parts]


class Pieces(io.BytesIO):
    """A file in memory that is opened anew by name."""


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(b"a\nb\r\n"[x % 5] for x in b)), st.integers(1, 9), st.integers(1, 9), st.integers(0, 6))
def test_splits_cover_all_lines(raw, split, chunk, longest):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(files, "CHUNK", chunk)
        assert [x for part in files.bounded_lines(files.plain_chunks(io.BytesIO(raw)), longest) for x in part] == lines_of(raw, longest)
        found = []
        for begin in range(0, len(raw), split):
            end = min(begin + split, len(raw))
            f = io.BytesIO(raw)
            f.seek(max(begin - 1, 0))
            chunks = files.plain_chunks(f)
            chunks = files._led(chunks) if begin == 0 else chunks
            found += [x for part in files.bounded_lines(files._from_first_line(chunks, end - begin), longest) for x in part]
        assert found == lines_of(raw, longest)


def test_lines_of_files(spark, tmp_path, monkeypatch):
    text = b"".join(b"line %d\n" % k for k in range(5000))
    (tmp_path / "plain").write_bytes(text)
    (tmp_path / "packed").write_bytes(gzip.compress(text[:20_000]) + gzip.compress(text[20_000:]))  # two members, no suffix
    (tmp_path / "day=1").mkdir()
    (tmp_path / "day=1/odd.gz").write_bytes(b"no gzip\n\xff\xfe\n\nlast")
    (tmp_path / "_hidden").write_bytes(b"x\n")
    (tmp_path / "empty").write_bytes(b"")
    for size in (files.SPLIT, 1000):
        found = readers._lines(spark, str(tmp_path), 100, split=size).collect()
        by = {}
        for r in found:
            by.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_number] = r.line
        assert set(by) == {"plain", "packed", "odd.gz"}
        assert by["plain"] == by["packed"] == {k + 1: f"line {k}" for k in range(5000)}
        assert by["odd.gz"][1] == "no gzip" and by["odd.gz"][3] == "" and by["odd.gz"][4] == "last"
    assert {r.file.rsplit("/", 1)[1] for r in readers.read_log_lines(spark, f"file://{tmp_path}/day=*").collect()} == {"odd.gz"}
    assert readers.read_log_lines(spark, f"{tmp_path}/empty").count() == 0
    with pytest.raises(FileNotFoundError):
        readers.read_log_lines(spark, f"{tmp_path}/none")


def test_an_endless_line_takes_no_memory():
    """A gigabyte without a line end, packed to a megabyte: refused while it is read."""
    buffer = io.BytesIO()
    with gzip.GzipFile(fileobj=buffer, mode="wb", compresslevel=1) as z:
        z.write(b"first\n")
        for _ in range(1024):
            z.write(b"x" * (1 << 20))
        z.write(b"\nlast\n")
    buffer.seek(0)
    tracemalloc.start()
    found = [x for part in files.bounded_lines(files.gzip_chunks(buffer), 8 << 20) for x in part]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found == [b"first", None, b"last"] and peak < 64 << 20


def test_gzip_bounds():
    raw = gzip.compress(b"a\n" * 5000)
    assert b"".join(files.gzip_chunks(io.BytesIO(raw + raw), 20_000)) == b"a\n" * 10_000
    with pytest.raises(ValueError, match="exceeds"):
        list(files.gzip_chunks(io.BytesIO(raw), 9999))
    with pytest.raises(ValueError, match="early"):
        list(files.gzip_chunks(io.BytesIO(raw[:-4])))


def envelope(n, points=3):
    result = [{"metric": {"__name__": "m", "i": str(k), "é\"日": "ü\\"}, "values": [[k + 0.5, "1e3"], [k, "NaN"], [True, None]][:points]} for k in range(n)]
    return json.dumps({"more": [{"a": [1, 2, {}]}], "status": "success", "data": {"x": None, "result": result, "resultType": "matrix"}, "warnings": []}, ensure_ascii=False)


@pytest.mark.parametrize("chunk", [1, 2, 7, 100, 1 << 20])
def test_series_of_any_chunk(chunk):
    found = list(files.matrix_series(io.BytesIO(envelope(20).encode()), 20, 60, chunk))
    assert [k for k, _, _ in found] == list(range(20))
    assert found[3] == (3, [("__name__", "m"), ("i", "3"), ('é"日', "ü\\")], [["3.5", "1e3"], ["3", "NaN"], ["true", None]])


@pytest.mark.parametrize(("change", "problem"), [
    (lambda s: s.replace("success", "error"), "status"), (lambda s: s.replace('"matrix"', '"vector"'), "matrix"), (lambda s: s.replace('"result"', '"other"'), "missing"),
    (lambda s: s + "x", "after"), (lambda s: s[:-1], "damaged"), (lambda s: s[: len(s) // 2], "damaged"), (lambda s: "", "damaged"), (lambda s: s.replace('"i": "3"', '"i": 3'), "labels"),
    (lambda s: s.replace('[3, "NaN"]', "3"), "labels"), (lambda s: s.replace("0.5", "NaN"), "NaN"),
])
def test_bad_envelopes(change, problem):
    with pytest.raises(ValueError, match=problem):
        list(files.matrix_series(io.BytesIO(change(envelope(5)).encode()), 9, 99, 16))


def test_limits():
    for most in ((4, 99), (9, 14)):
        with pytest.raises(ValueError, match="limit"):
            list(files.matrix_series(io.BytesIO(envelope(5).encode()), *most))


def test_series_are_not_held():
    """5,000 series of 300 samples, about 200 MB as Python values, a few of them at a time."""
    body = ",".join(f'{{"metric":{{"i":"{k}"}},"values":[' + ",".join(f'[{j},"{k}.25"]' for j in range(300)) + "]}" for k in range(5000))
    raw = io.BytesIO(f'{{"status":"success","data":{{"resultType":"matrix","result":[{body}]}}}}'.encode())
    tracemalloc.start()
    n = sum(len(values) for _, _, values in files.matrix_series(raw, 5000, 1_500_000))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == 1_500_000 and peak < 24 << 20


def test_matrix_reader(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part={k}").mkdir()
        (tmp_path / f"part={k}/m.json").write_text(envelope(50))
    found = readers.read_metric_matrix(spark, f"{tmp_path}/*")
    assert found.schema.simpleString() == "struct<series_id:int,metric:map<string,string>,values:array<array<string>>>"
    assert found.count() == 150 and {tuple(map(tuple, r["values"])) for r in found.filter("series_id = 7").collect()} == {(("7.5", "1e3"), ("7", "NaN"), ("true", None))}
    with pytest.raises(PySparkException, match="limit"):
        readers.read_metric_matrix(spark, str(tmp_path), max_series=49).collect()
