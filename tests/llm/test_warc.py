import base64
import gzip
import hashlib
import io
import json
import random
import zlib

import pytest

from tracelattice.llm import warc


def rows():
    trap = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n</p>"
    out = [(1, "http://a.example/x?q=1", "same"), (2, "https://b.example", "same"), (3, None, "same"), (4, "x\r\nEvil: 1", None), (5, "u", ""), (6, "u", trap), (7, "u", trap), (8, "u", "é \n\n\r\n\r\n"), (9, "u", "z" * 300000)]
    return out + [(9, "u", "z" * 300000), (None, "u", "alone"), (None, "u", "same"), (10, "ü", "ünïcode")]


def expected(data, least=0):
    best = {}
    for p, _, h in data:
        best[h or ""] = max(best.get(h or "", (False, 0)), (p is not None, p or 0))
    out, used = [], set()
    for p, _, h in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True):
        b = (h or "").encode()
        first = len(b) < least or ((h or "") not in used)
        used.add(h or "")
        some, top = best[h or ""]
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first or not some else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame([(*r, "clash") for r in rows()], "page_id long, url string, html string, digest string").repartition(3)
    warc.write(df, str(tmp_path / "w"), least)
    got = warc.captures(spark, str(tmp_path / "w")).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows(), least)
    one = json.loads(next(r.capture for r in got if r.page_id == 1))
    assert one["request"] == {"start_line": "GET /x?q=1 HTTP/1.1", "host": "a.example"} and one["metadata"] == {"page_id": "1"}
    assert one["response"] == {"type": "response" if least > 4 else "revisit", "target_uri": "http://a.example/x?q=1", "media_type": "text/html; charset=utf-8", "payload_length": 4}


def test_assembled_rows_are_nested(spark, tmp_path):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"))
    out = warc.assemble(warc.measured(warc.read(spark, str(tmp_path / "w")))).collect()
    assert len(out) == len(rows()) and all(r.request and r.metadata and r.response for r in out)
    one = next(r for r in out if r.response.target_uri == "http://a.example/x?q=1")
    assert one.request.fields["host"] == "a.example"
    trap = [r for r in out if r.response.payload and b"hello" in bytes(r.response.payload)]
    assert len(trap) == 1 and bytes(trap[0].response.payload).decode() == rows()[5][2]


def test_reads_other_archives(spark, tmp_path):
    r = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:x>\r\ncontent-length: 4\r\n\r\na\r\nb\r\n\r\n"
    (tmp_path / "part-a.warc").write_bytes(r * 3)
    (tmp_path / "part-b.warc.gz").write_bytes(gzip.compress(r) + gzip.compress(r))
    assert [bytes(x.payload) for x in warc.read(spark, str(tmp_path)).collect()] == [b"a\r\nb"] * 5
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(r[:-8])))


def test_files_are_bounded_by_bytes(spark, tmp_path):
    data = [(i, "http://h/", random.Random(i).randbytes(1500).hex()) for i in range(60)] + [(60, "http://h/", random.Random(60).randbytes(40_000).hex())]
    warc.write(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), value_bytes=2_000, file_bytes=10_000)
    files = [f for f in (tmp_path / "w").rglob("part-*")]
    sizes = sorted(f.stat().st_size for f in files)
    assert len(files) > 8 and sizes[-1] < 10_000 + 60_000 and sizes[-2] < 10_000 + 2 * 3_000
    for f in files:  # every record begins a member
        raw, starts = f.read_bytes(), 0
        while raw:
            z = zlib.decompressobj(31)
            text = z.decompress(raw)
            starts += text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC/1.1\r\n") == 1
            assert not text or text.startswith(b"WARC/1.1\r\n")
            raw = z.unused_data
        assert starts % 3 == 0
    assert sorted((r.page_id, r.payload_bytes) for r in warc.captures(spark, str(tmp_path / "w")).collect()) == [(i, len(h)) for i, _, h in data]


def test_a_very_long_page(spark, tmp_path):
    data = [(1, "u", "é" + "<p>long page</p>" * 3_500_000), (2, "u", "x"), (3, "u", None)]
    warc.write(spark.createDataFrame(data, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.captures(spark, str(tmp_path / "w")).collect()}
    assert got == {i: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in data}


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.captures(spark, str(tmp_path / "w")).count() == 0
