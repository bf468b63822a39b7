import base64
import hashlib
import io
import tracemalloc

import pytest

from weftline.llm import warc


def brute(pages, least=0):
    body = lambda h: (h or "").encode()
    top = {}
    for i, h in pages:
        if len(body(h)) >= least:
            top[body(h)] = max(top.get(body(h), -1), i)
    out = []
    for i, h in pages:
        b = body(h)
        again = b in top and top[b] != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top[b] if again else None))
    return sorted(out)


@pytest.mark.parametrize("least,size", [(0, 7), (4, 1 << 18)])
def test_round_trip(spark, least, size):
    texts = ["<p>é</p>", "", None, "a\r\n\r\nWARC/1.1\r\nb", "x" * 5000, "abc", "\r\n", "line\nline\r\n\r\n", "𝒳" * 9]
    pages = [(i, f"http://x/{i}\r\nq", texts[i * 5 % len(texts)]) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as digest").repartition(3)
    got = warc.round_trip(df, least, size).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute([(i, h) for i, _, h in pages], least)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_chunks_carry_digests(spark, tmp_path):
    pages = [(1, "u", "é" * 1000 + "z"), (2, "u", None), (2, "u", None), (None, "u", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "w"))
    rows = warc.read(spark, str(tmp_path / "w"), 64).collect()
    own = sorted((r.chunk, bytes(r.data), r.sha1, r.bytes) for r in rows if r.page_id == 1)
    assert b"".join(d for _, d, _, _ in own) == pages[0][2].encode()
    sha = hashlib.sha1()
    for i, (number, data, digest, done) in enumerate(own):
        sha.update(data)
        assert number == i and len(data) <= 64 and digest == base64.b32encode(sha.digest()).decode()
    assert [r.last for r in rows if r.page_id == 1].count(True) == 1
    assert [r.record_type for r in rows if r.page_id == 2] == ["response", "response"]
    assert [r.record_type for r in rows if r.page_id is None] == ["response"]


def test_memory_is_a_few_chunks():
    n = 30_000_000

    class Endless(io.RawIOBase):
        def __init__(self):
            body = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % n
            digest = base64.b32encode(hashlib.sha1(b"a" * n).digest())
            head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:%b\r\nContent-Length: %d\r\n\r\n" % (digest, len(body) + n)
            self.parts, self.left = head + body, n

        def read(self, size):
            if self.parts:
                out, self.parts = self.parts[:size], self.parts[size:]
                return out
            k = min(size, self.left)
            self.left -= k
            if not k:
                out, self.end = getattr(self, "end", b"\r\n\r\n"), b""
                return out
            return b"a" * k

    raw = Endless()
    tracemalloc.start()
    count = sum(1 for _ in warc.chunks(raw, "x", 1 << 16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == -(-n // (1 << 16)) and peak < 3_000_000
