import base64
import hashlib
import io
import random

import pytest

from clausula.llm import arc

SCHEMA = "page_id long, url string, html string, payload string, top int"


def test_round_trip(spark):
    rng = random.Random(1)
    texts = ["é" * 700, "x" * 1000, "y" * 999, "", None, "a\n\nWARC/1.1\r\n\r\n" * 100]
    rows = [(i, f"http://h/{i} b", rng.choice(texts), "c", 1) for i in range(80)] + [(None, None, "x" * 1000, None, None), (79, "http://h/79 b", "x" * 1000, "c", 1), (79, "http://h/79 b", "x" * 1000, "c", 1), (200, "u", "long " * 300_000, None, None)]
    out = arc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for key, _, html, _, _ in rows:
        raw = (html or "").encode()
        same = [k for k, _, h, _, _ in rows if (h or "").encode() == raw and k is not None]
        repeat = len(raw) >= 1000 and same and (key is None or key < max(same))
        want.append((key, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if repeat else "response", max(same) if repeat else None))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in out)


def test_empty(spark):
    assert arc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files(version):
    content = [("http://a/b c", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\n\r\nbody\n\n1 2 3\n"), ("http://a/", "2001", "image/png", b"\x00\xff"), ("http://a/", "20010203040506", "text/plain", b"")]
    raw = b"".join(arc.arc_file("f.arc", version, iter(content)))
    found = list(arc.read_arc(io.BytesIO(raw)))
    assert [(f["URL"], f["Archive-date"], f["Content-type"], c) for f, _, c in found[1:]] == content
    assert len(found[1][0]) == len(arc.FIELDS[version]) and found[0][0]["URL"] == "filedesc://f.arc"
    records = [next(arc.read_warc(io.BytesIO(arc.convert_record(f, c, "s")))) for f, _, c in found]
    assert [h["WARC-Type"] for h, _ in records] == ["warcinfo", "response", "resource", "resource"]
    assert records[1][0]["WARC-Date"] == "2001-02-03T04:05:06Z" and records[2][0]["WARC-Date"] == "1970-01-01T00:00:00Z"
    assert records[1][0]["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"body\n\n1 2 3\n").digest()).decode()
    assert records[1][1] == content[0][3]
    with pytest.raises(arc.ArcError):
        list(arc.read_arc(io.BytesIO(raw[:-5])))
    with pytest.raises(arc.ArcError):
        list(arc.read_arc(io.BytesIO(b"no header\n")))
