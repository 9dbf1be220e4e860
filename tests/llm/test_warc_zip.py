import base64
import hashlib
import io
import zipfile

import pytest

from recordloom.llm import warc_zip


def brute(rows, least):
    """Records of (page_id, html) rows by definition."""
    first = {}
    for i, h in rows:
        p = (h or "").encode()
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, h in rows:
        p = (h or "").encode()
        r = first.get(p)
        r = None if r == i or len(p) < least else r
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
                    "response" if r is None else "revisit", r))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in df.collect()), key=str)


ROWS = [(5, "<p>a</p>"), (3, "<p>a</p>"), (9, "é😀\r\n\r\nx"), (1, None), (2, ""), (2, ""), (7, "z" * 300000),
        (None, "<p>a</p>"), (None, "only"), (8, "WARC/1.1\r\n\r\n"), (4, "<p>a</p>"), (3, "<p>a</p>")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    urls = ["http://a/ü b\n", None, "-"]
    pages = spark.createDataFrame([(i, urls[k % 3], h, 1) for k, (i, h) in enumerate(ROWS)],
                                  "page_id long, url string, html string, payload_bytes int")
    assert got(warc_zip.round_trip(pages, least_bytes=least)) == brute(ROWS, least)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_zip.round_trip(pages).count() == 0


def test_given_pages_in_many_archives(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    manifest = warc_zip.write(pages.repartition(3), str(tmp_path), archive_bytes=15_000)
    assert manifest.count() > 3
    rows = [(r.page_id, r.html) for r in pages.collect()]
    assert got(warc_zip.read(manifest).selectExpr(
        "cast(page_id as long) page_id", "payload_bytes", "payload_digest", "record_type",
        "cast(refers_to as long) refers_to")) == brute(rows, 0)
    for r in manifest.collect():
        with zipfile.ZipFile(r.path) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


@pytest.mark.parametrize("limit,count,comment", [(2**31 - 1, 65535, b""), (50, 65535, b"PK\5\6 a comment"), (50, 3, b"")])
def test_directory_with_zip64_fields(monkeypatch, limit, count, comment):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", count)
    buffer = io.BytesIO()
    contents = {f"m{k}.ü": bytes([k]) * (k * 40) for k in range(6)}
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        for name, data in contents.items():
            z.writestr(name, data)
        z.comment = comment
    raw = buffer.getvalue()
    assert (warc_zip.END64 in raw) == (limit == 50)
    found = warc_zip.directory(buffer, len(raw))
    assert {name: raw[at:at + n] for name, _, at, n in found} == contents


def test_not_a_zip():
    with pytest.raises(ValueError):
        warc_zip.directory(io.BytesIO(b"x" * 100), 100)


def test_same_result_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "MOST_GROUPS", 0)
    pages = spark.createDataFrame([(i, "u", h) for i, h in ROWS], "page_id long, url string, html string")
    assert got(warc_zip.round_trip(pages)) == brute(ROWS, 0)
