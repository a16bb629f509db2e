import gzip

import pytest
from pyspark.sql import functions as F

from quarry.llm import warc


def raw(kind, uri, body, more=()):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Target-URI: {uri}", "WARC-Record-ID: <urn:x>", *more, f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


RECORDS = [
    raw("warcinfo", "", b"software: x\r\n", ["Content-Type: application/warc-fields"]),
    raw("response", "http://a/1", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX: a\r\n b\r\n\r\n<p>\r\n\r\nWARC/1.0\r\n", ["Content-Type: application/http; msgtype=response"]),
    raw("response", "http://a/2", b"HTTP/1.1 404 No\r\n\r\n", ["Content-Type: application/http;msgtype=response"]),
    raw("resource", "http://b/3", b"\x00" * 700_000),
    raw("response", "http://b/4", b"not http", ["Content-Type: application/http"]),
    raw("response", "http://a/5", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"packed"), ["content-type: application/http"]),
    raw("metadata", "http://c/6", b""),
]


@pytest.fixture(scope="module", params=["plain", "members", "one member"])
def folder(request, tmp_path_factory):
    path = tmp_path_factory.mktemp("w")
    parts = [RECORDS[:4], RECORDS[4:]]
    for k, own in enumerate(parts):
        if request.param == "plain":
            (path / f"{k}.warc").write_bytes(b"".join(own))
        elif request.param == "members":
            (path / f"{k}.warc.gz").write_bytes(b"".join(map(gzip.compress, own)))
        else:
            (path / f"{k}.warc.gz").write_bytes(gzip.compress(b"".join(own)))
    (path / "other.txt").write_text("x")
    return str(path)


def test_reading(spark, folder):
    warc.register(spark)
    rows = {r.target_uri: r for r in spark.read.format("warc").load(folder).collect()}
    assert len(rows) == 7
    one = rows["http://a/1"]
    assert (one.http_status, bytes(one.payload), one.http_headers["x"]) == (200, b"<p>\r\n\r\nWARC/1.0\r\n", "a b")
    assert one.headers["warc-type"] == "response" and one.content_length == int(one.headers["content-length"]) > len(one.payload)
    assert rows["http://a/2"].http_status == 404 and bytes(rows["http://a/2"].payload) == b""
    assert rows["http://b/3"].content_length == 700_000 == len(rows["http://b/3"].payload)
    assert rows["http://b/4"].http_status is None and bytes(rows["http://b/4"].payload) == b"not http"
    assert bytes(rows["http://a/5"].payload) == b"packed"
    assert rows["http://b/3"].content_type is None


CONDITIONS = [
    "warc_type = 'response'", "warc_type in ('metadata', 'resource')", "warc_type <> 'response'", "not (warc_type in ('response'))", "target_uri like 'http://a%'", "target_uri like '%3'", "target_uri like '%b/%'",
    "content_length > 100", "content_length <= 13 and warc_type = 'warcinfo'", "content_type is null", "content_type is not null and warc_type = 'response'", "warc_date is null", "content_type <=> null", "http_status = 200", "headers['warc-type'] = 'metadata'",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_predicates(spark, folder, condition):
    """Pushed down or not, a predicate gives the same rows."""
    warc.register(spark)
    everything = spark.read.format("warc").load(folder).collect()
    schema = spark.read.format("warc").load(folder).schema
    expected = sorted(r.target_uri for r in spark.createDataFrame(everything, schema).where(condition).collect())
    assert sorted(r.target_uri for r in spark.read.format("warc").load(folder).where(condition).collect()) == expected


def test_unwanted_payloads_are_skipped(folder, monkeypatch):
    """Only the wanted record's payload is taken from the stream and decoded."""
    from pyspark.sql.datasource import EqualTo

    decoded = []
    http = warc._http
    monkeypatch.setattr(warc, "_http", lambda body: decoded.append(body) or http(body))
    taken = []
    for kind in (warc._Plain, warc._Members):
        take = kind.take
        monkeypatch.setattr(kind, "take", lambda self, n, take=take: taken.append(n) or take(self, n))
    import glob

    rows = [r for f in glob.glob(folder + "/*.warc*") for r in warc.records(f, [EqualTo(("target_uri",), "http://a/2")])]
    assert len(rows) == 1 and decoded == [b"HTTP/1.1 404 No\r\n\r\n"] and max(taken) < 10_000
    headers = [r for f in glob.glob(folder + "/*.warc*") for r in warc.records(f, payload=False)]
    assert len(headers) == 7 and all(r[9] is None for r in headers)


def test_partitions(folder):
    from pyspark.sql.types import StructType

    one = warc.WarcReader(StructType(), {"path": folder}).partitions()
    two = warc.WarcReader(StructType(), {"path": folder, "partitionbytes": "1"}).partitions()
    assert [len(p.paths) for p in one] == [2] and [len(p.paths) for p in two] == [1, 1]


def test_broken_files(tmp_path):
    for name, data in (("a.warc", b"nonsense\r\n\r\n"), ("b.warc", RECORDS[1][:-40]), ("c.warc.gz", gzip.compress(RECORDS[3])[:300])):
        (tmp_path / name).write_bytes(data)
        with pytest.raises((ValueError, EOFError)):
            list(warc.records(str(tmp_path / name)))
    (tmp_path / "d.warc").write_bytes(b"")
    assert list(warc.records(str(tmp_path / "d.warc"))) == []


@pytest.mark.parametrize("packed", [True, False])
def test_permissive(spark, tmp_path, packed):
    warc.register(spark)
    bad = RECORDS[1].replace(b"Content-Length: ", b"Content-Length: x")
    assert bad != RECORDS[1]
    pack = gzip.compress if packed else bytes
    last = pack(RECORDS[2])
    for name, parts in (("a", [RECORDS[0], bad, RECORDS[2], RECORDS[3]]), ("b", [RECORDS[0], b"nonsense\r\n\r\n", RECORDS[2]])):
        (tmp_path / f"{name}.warc").write_bytes(b"".join(map(pack, parts)))
    (tmp_path / "c.warc").write_bytes(pack(RECORDS[0]) + last[: len(last) // 2])
    whole = [r[:-2] for r in warc_rows(tmp_path, pack, RECORDS)]
    for name, good in (("a", [0, 2, 3]), ("b", [0, 2]), ("c", [0])):
        rows = list(warc.records(str(tmp_path / f"{name}.warc"), permissive=True))
        damaged = [r for r in rows if r[6] and "x-damage" in r[6]]
        assert len(damaged) == 1 and damaged[0][:6] == (None,) * 6
        assert [r[:-2] for r in rows if r not in damaged] == [whole[i] for i in good]
    df = spark.read.format("warc").option("mode", "permissive").load(str(tmp_path))
    assert df.where("headers['x-damage'] is not null").count() == 3
    assert df.where("warc_type is null").count() == 3
    with pytest.raises(Exception, match="ValueError|EOFError|error"):
        spark.read.format("warc").load(str(tmp_path)).collect()


def warc_rows(folder, pack, parts):
    other = folder / "whole"
    other.write_bytes(b"".join(map(pack, parts)))
    return list(warc.records(str(other)))


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_writing(spark, tmp_path, compression):
    warc.register(spark)
    path = str(tmp_path / "out")
    rows = [("response", "http://x/1", 200, {"Content-Type": "text/html"}, bytearray(b"body\xff"), 1), ("resource", None, None, None, None, 2)]
    df = spark.createDataFrame(rows, "warc_type string, target_uri string, http_status int, http_headers map<string,string>, payload binary, other int")
    for mode in ("append", "overwrite"):
        df.repartition(2).write.format("warc").option("path", path).option("compression", compression).mode(mode).save()
    got = {r.warc_type: r for r in spark.read.format("warc").load(path).collect()}
    assert spark.read.format("warc").load(path).count() == 2
    assert bytes(got["response"].payload) == b"body\xff" and got["response"].http_headers["content-type"] == "text/html"
    assert bytes(got["resource"].payload) == b"" and got["resource"].target_uri is None


def test_round_trip_of_pages(spark):
    rows = [(1, "http://a", "<p>x</p>\r\n\r\nWARC/1.1"), (2, None, "y"), (None, "http://b", ""), (3, "http://c", None), (1, "http://a", "<p>x</p>\r\n\r\nWARC/1.1"), (4, "http://d", "é" * 2_000_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    key = lambda r: tuple((v is None, v or "") for v in map(str, r))
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=key) == sorted(rows, key=key)
    assert warc.round_trip(pages.limit(0)).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert warc.round_trip(real).exceptAll(real).count() == 0
    assert warc.round_trip(real).agg(F.count("*")).first()[0] == real.count()
