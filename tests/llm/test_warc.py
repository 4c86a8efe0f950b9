import base64
import gzip
import hashlib
import os
import random
import zlib

import pytest

from veridelta.llm import warc as W


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 3) for i, u, h in rows], "page_id long, url string, html string, size string, digest int")


ROWS = [(5, "http://a/x y\n", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "http://c", ""), (2, "u", None), (4, "u", "é\r\n\r\nWARC/1.1\r\n" * 3), (7, "u", "x" * 300_000), (None, "u", "same")]


def digest(h):
    return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


def brute(rows, least):
    out = []
    for i, _, h in rows:
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        size = len((h or "").encode())
        again = size >= least and i is not None and min(same) < i
        out.append((i, size, digest(h), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "compression"), [(0, "gzip"), (3, "none")])
def test_round_trip(spark, least, compression):
    got = W.round_trip(pages(spark, ROWS), least, compression).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS, least)


def test_no_pages(spark):
    assert W.round_trip(pages(spark, [])).collect() == []


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_filters_reach_the_reader(spark, tmp_path, compression):
    W.write_warc(pages(spark, ROWS), f"file://{tmp_path}/a", compression=compression)
    df = W.read_warc(spark, f"file://{tmp_path}/a").where("record_type = 'revisit' AND target_uri LIKE 'http://a%'")
    assert [r.record_id for r in df.collect()] == ["urn:page:5"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    kept = [line for line in plan.split("\n") if " Filter (" in line]
    assert not any("record_type" in line or "target_uri" in line for line in kept), plan
    bare = W.read_warc(spark, f"file://{tmp_path}/a", payload=False)
    assert bare.where("payload is not null").count() == 0 and bare.where("record_type <> 'warcinfo'").count() == len(ROWS)


def test_skipped_blocks_are_not_inflated(spark, tmp_path, monkeypatch):
    r = random.Random(1)
    rows = [(i, "u", "".join(chr(r.randrange(32, 1000)) for _ in range(200_000))) for i in range(6)] + [(9, "u", "short")]
    W.write_warc(pages(spark, rows).coalesce(1), f"file://{tmp_path}/a")
    (path,) = [p for p in (tmp_path / "a").glob("part-*")]
    inflated = []

    class Meter:
        def __init__(self, bits):
            self.inner = zlib_decompressobj(bits)

        def decompress(self, data):
            out = self.inner.decompress(data)
            inflated.append(len(out))
            return out

        def flush(self):
            return self.inner.flush()

    zlib_decompressobj = zlib.decompressobj
    monkeypatch.setattr(W.zlib, "decompressobj", Meter)

    def read(wanted, payloads):
        inflated.clear()
        with W._opened(str(path)) as f:
            return [(h.get("warc-record-id"), len(b or b"")) for _, h, _, b in W.records(f, wanted, payloads)], sum(inflated)

    every, whole = read(lambda h: True, True)
    assert len(every) == 8 and whole > 1_200_000
    one, few = read(lambda h: h.get("warc-record-id") == "<urn:page:9>", True)
    assert [x for x, _ in one] == ["<urn:page:9>"] and few < 40_000
    assert len(read(lambda h: True, False)[0]) == 8 and sum(inflated) < 40_000


def test_files_of_failed_attempts_are_deleted(spark, tmp_path):
    w = W.WarcWriter({"path": f"file://{tmp_path}/a"}, False)
    os.makedirs(tmp_path / "a")
    for name in ("part-00000-1-x.warc.gz", "part-00000-2-y.warc.gz"):
        (tmp_path / "a" / name).write_bytes(W.member(W.INFO))
    w.commit([W.Written("part-00000-2-y.warc.gz"), None])
    assert os.listdir(tmp_path / "a") == ["part-00000-2-y.warc.gz"]


def test_members_are_gzip():
    assert gzip.decompress(W.member(W.INFO) + W.member(b"x")) == W.INFO + b"x"


def test_reads_gzip_members_and_foreign_records(spark, tmp_path):
    def record(kind, body, *more):
        head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *more, f"Content-Length: {len(body)}"])
        return gzip.compress(head.encode() + b"\r\n\r\n" + body + b"\r\n\r\n")

    os.makedirs(tmp_path / "g")
    data = record("warcinfo", b"software: x") + record("resource", b"\x00\xff", "Content-Type: image/png", "X-Folded: a", "\tb") + record("response", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody", "Content-Type: application/http;msgtype=response")
    (tmp_path / "g" / "one.warc.gz").write_bytes(data)
    got = {r.record_type: r for r in W.read_warc(spark, str(tmp_path / "g")).collect()}
    assert bytes(got["resource"].payload) == b"\x00\xff" and got["resource"].headers["x-folded"] == "a b"
    assert bytes(got["response"].payload) == b"body" and got["response"].http_headers == {"a": "b"}
