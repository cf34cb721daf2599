import gzip
import re
from pathlib import Path

from gridsonde.llm import warc


def pages(spark):
    rows = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://a/4", ""), (5, "u r l\n", "é🙂" * 40000),
            (6, "http://a/6", "x WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"), (7, "http://a/7", "\r\n\r\n" * 20),
            (8, "http://a/8", "a" * 70000), (9, "http://a/9", "é🙂" * 40000), (10, "http://a/10", "WARC/1.0\r\n" * 9000)]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, target string")


def test_archives_give_back_every_payload(spark, tmp_path):
    rows, df = pages(spark)
    path = str(tmp_path / "w")
    warc.write_archives(df, path, "page_id", "url", "html", segment=9000, per_file=7)
    records = warc.read_records(spark, path)
    assert {r["status"] for r in records.collect()} == {"ok"} and records.where("type = 'continuation'").count() > 20
    direct = warc.read_whole(spark, path)
    assert sorted(map(str, direct.collect())) == sorted(map(str, warc.reassembled(records).collect()))
    got = {r["page"]: r for r in direct.withColumn("page", warc.page_of("record_id")).withColumn("last", warc.page_of("refers_to")).collect()}
    body = {k: (h or "").encode() for k, _, h in rows}
    assert sorted(got) == sorted(body)
    for k, r in got.items():
        last = max(j for j in body if body[j] == body[k])
        assert r["status"] == "ok" and r["digest"] == warc.digest_of(body[k]) and r["payload_bytes"] == len(body[k])
        assert (r["type"], r["last"]) == (("response", None) if k == last else ("revisit", last))
        assert r["payload"] == (body[k] if k == last else None)
    files = list(Path(path).glob("*.gz"))
    assert len(files) > 3
    for f in files:  # plain archives: version line, header, block of the declared length, two line ends
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert head.startswith(b"WARC/1.0\r\n") and rest[n:n + 4] == b"\r\n\r\n"
            data = rest[n + 4:]


def test_only_payloads_from_the_least_size_on_are_revisited(spark):
    _, df = pages(spark)
    got = {r["page_id"]: r["refers_to"] for r in warc.with_revisits(df.withColumn("p", df.html.cast("binary")), "page_id", "p", 11).collect()}
    assert got[1] is None and got[5] == 9 and got[9] is None


def test_broken_records_are_told(spark):
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abcdef" * 10, 7)
    parts = [body[:40], body[40:80], body[80:]]

    def rows(name, pieces, numbers, total, digest=None, status="ok"):
        return [(f"<{name}>" if n == 1 else f"<{name}:{n}>", "response" if n == 1 else "continuation", None, None, digest, n, None if n == 1 else f"<{name}>",
                 total if k == len(pieces) - 1 else None, len(p), p, status) for k, (n, p) in enumerate(zip(numbers, pieces))]

    good = warc.digest_of(b"abcdef" * 10)
    data = (rows("ok", parts[::-1], (3, 2, 1), None, good) + rows("gap", [parts[0], parts[2]], (1, 3), len(body)) + rows("none", parts, (1, 2, 3), None)
            + rows("long", parts, (1, 2, 3), len(body) + 1) + rows("digest", parts, (1, 2, 3), len(body), "X" * 32) + rows("cut", parts, (1, 2, 3), len(body), None, "cut")
            + rows("frame", [parts[0], parts[1], b"z" * len(parts[2])], (1, 2, 3), len(body)) + rows("lost", parts[1:], (2, 3), len(body)))
    data[0] = (*data[0][:7], len(body), *data[0][8:])
    got = {r["record_id"]: r for r in warc.reassembled(spark.createDataFrame(data, warc.RECORD)).collect()}
    assert {k[1:-1]: r["status"] for k, r in got.items()} == {"ok": "ok", "gap": "gap", "none": "no_end", "long": "length", "digest": "digest", "cut": "cut",
                                                             "frame": "framing", "lost": "gap"}
    assert got["<ok>"]["payload"] == b"abcdef" * 10 and got["<gap>"]["payload"] is None


def test_chunked_framing():
    for payload in (b"", b"a", b"WARC/1.0\r\n" * 3, bytes(range(256)) * 100):
        coded = warc.chunked(payload, 50)
        assert warc.dechunked(coded) == payload
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n"):
        assert warc.dechunked(broken) is None


def record(kind, name, block, version=b"1.1", length=None):
    return b"WARC/%b\r\nWARC-Type: %b\r\nWARC-Record-ID: <%b>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (version, kind, name, len(block) if length is None else length, block)


def test_foreign_archives_are_read_by_length(spark, tmp_path):
    """Both versions, payloads that hold whole records, marks in headers, a record cut short and what follows it."""
    http = b"HTTP/1.0 200 OK\r\nContent-Type: text/plain\r\n\r\n"
    inner = record(b"response", b"inner", http + b"x", b"1.0")
    bodies = {b"a": b"plain", b"b": b"WARC/1.0\r\nWARC/1.1\r\n" * 50, b"c": inner + b"tail", b"d": b"", b"e": inner * 3, b"WARC/1.0 f": b"mark in the header"}
    good = b"".join(record(b"response", k, http + v, b"1.0" if n % 2 else b"1.1") for n, (k, v) in enumerate(bodies.items()))
    short = record(b"response", b"short", http + b"abc", length=5000)
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(gzip.compress(b"junk" + good))
    (folder / "b.warc.gz").write_bytes(gzip.compress(record(b"response", b"first", http) + short + record(b"response", b"after", http + b"!")))
    (folder / "c.warc.gz").write_bytes(gzip.compress(record(b"response", b"last", http + b"abc", length=400)))
    got = {r["record_id"][1:-1]: r for r in warc.read_whole(spark, str(folder)).collect()}
    assert {k: r["payload"] for k, r in got.items() if r["status"] == "ok"} == {**{k.decode(): v for k, v in bodies.items()}, "first": b"", "after": b"!"}
    assert {k for k, r in got.items() if r["status"] == "cut"} == {"short", "last"}


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "http://n", "n" * 60), (None, "http://n", "n" * 60), (1, "http://1", "n" * 60), (2, "http://2", "two"), (2, "http://2", "two"), (3, "http://3", "s" * 90_000), (3, "http://3", "s" * 90_000)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, "page_id", "url", "html")
    got = sorted((r["record_id"], r["type"], r["status"]) for r in warc.read_whole(spark, path).collect())
    assert got == sorted([("<urn:record:None>", "revisit", "ok")] * 2 + [("<urn:record:1>", "response", "ok")] + [("<urn:record:2>", "response", "ok")] * 2
                         + [("<urn:record:3>", "response", "gap")])


def test_empty_table(spark, tmp_path):
    _, df = pages(spark)
    path = str(tmp_path / "none")
    warc.write_archives(df.limit(0), path, "page_id", "url", "html")
    assert warc.reassembled(warc.read_records(spark, path)).collect() == []
