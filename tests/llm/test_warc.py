"""Packages: round trips, ZIP64, and what a reader must refuse."""

import hashlib
import io
import zipfile

import pytest

from tensorweft.llm import warc

BIG = "<p>" + "x" * 200 + "</p>"
PAGES = [(1, "http://a/", BIG), (2, "http://b/", BIG), (0, "http://c/", BIG), (3, None, None), (4, "http://d/", ""), (5, "u", "small"), (6, "u", "small"), (7, "é", "é" * 60), (8, "é", "é" * 60), (8, "é", "é" * 60), (None, "n", BIG), (9, "u\r\nX: y", "a\r\n\r\nb" * 90)]


def plain(pages):
    first = {}
    for i, _, h in pages:
        p = (h or "").encode()
        if i is not None and len(p) >= 100:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in pages:
        p = (h or "").encode()
        f = first.get(p)
        revisit = f is not None and f != i
        out.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", str(f) if revisit else "None"))
    return sorted(out)


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    packages = warc.archive(df)
    records = warc.read_records(warc.locate(packages)).collect()
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in records)
    assert got == plain(PAGES)
    payloads = {r.page_id: bytes(r.payload).decode() for r in records if r.record_type == "response"}
    assert payloads[0] == BIG and payloads[9] == "a\r\n\r\nb" * 90 and payloads[3] == ""


def test_small_packages_and_ranges(spark):
    pages = [(i, f"http://h/{i}", f"page {i} " * 50) for i in range(60)]
    df = warc.with_references(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1))
    packages = warc.write_packages(df, warc.fresh_path(spark, "archives"), package_bytes=1500)
    assert packages.count() > 3 and packages.agg({"n_records": "sum"}).first()[0] == 60
    located = warc.locate(packages, range_bytes=400)
    assert located.count() > packages.count()
    assert sorted(r.page_id for r in warc.read_records(located).collect()) == list(range(60))


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.locate(warc.archive(df))).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", BIG, 5, "d"), (2, "u", BIG, 5, "d")], "page_id long, url string, html string, size int, digest string")
    assert sorted(r.record_type for r in warc.read_records(warc.locate(warc.archive(df))).collect()) == ["response", "revisit"]


def package(members, stored=True, comment=b"", wide=False):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as f:
                f.write(data)
        z.comment = comment
    return sink.getvalue()


def test_directory():
    data = package([("a", b"one"), ("ä/b", b"two" * 100)], comment=b"PK\x05\x06 in a comment")
    source = warc.Bytes(data)
    found = warc.members(source)
    assert {n: source.read(*x) for n, x in found.items()} == {"a": b"one", "ä/b": b"two" * 100}


def test_zip64(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    data = package([(f"m{i}", bytes([i]) * (i + 20)) for i in range(5)], wide=True)
    assert b"PK\x06\x06" in data
    source = warc.Bytes(data)
    assert warc.central_directory(source)[0] == 5
    assert {n: source.read(*x) for n, x in warc.members(source).items()} == {f"m{i}": bytes([i]) * (i + 20) for i in range(5)}


@pytest.mark.parametrize("data", [b"", b"no archive at all", package([("a", b"x")])[:-5], package([("a", b"x")]).replace(b"PK\x01\x02", b"PK\x01\x03")])
def test_broken(data):
    with pytest.raises(warc.BadPackage):
        warc.members(warc.Bytes(data))


def test_damaged_payload():
    record = warc.warc_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), False, None)
    assert warc.parse_record(record)["payload"] == b"payload"
    with pytest.raises(warc.BadPackage):
        warc.parse_record(record.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"))


def test_uri(spark, tmp_path):
    assert warc.uri(spark, str(tmp_path)) == warc.uri(spark, f"file:{tmp_path}") == warc.uri(spark, f"file://{tmp_path}") == f"file://{tmp_path}"
