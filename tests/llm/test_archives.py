import hashlib
import io
import json
import zipfile

import pytest
from fixtures import SF, by_row

from placeweave.llm import queries, zip_warc

PAGES = "page_id long, url string, html string, digest string, first long, path string, uses int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1, "p", 2) for i, u, h in rows], PAGES).repartition(3)


def expected(rows):
    firsts = {}
    for i, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 100 and i is not None:
            firsts[payload] = min(firsts.get(payload, i), i)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        first = firsts.get(payload)
        later = first is not None and (i is None or i > first)
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if later else "response", first if later else None))
    return by_row(out)


def hard_pages():
    long, edge = "é" * 50, "x" * 99
    rows = [(i, f"http://h{i % 3}.org/{i}", f"<p>page {i % 7}</p>" * 20) for i in range(60)]
    rows += [(100 + i, "http://same.org/", long) for i in range(40)] + [(200 + i, None, edge) for i in range(5)]
    rows += [(300, "", None), (301, "http://a b\r\nWARC-Type: x{", ""), (302, None, "\r\n\r\nWARC/1.1\r\n\r\n" * 30), (303, "u", "PK\x05\x06" * 40)]
    rows += [(304, "http://big/", "long text " * 500_000), (None, "n", long), (None, None, "only without an id" * 20), (100, "http://again/", long), (100, "http://same.org/", long)]
    return rows


def packages(spark, tmp_path, rows, **sizes):
    return zip_warc.write_packages(frame(spark, rows), f"file://{tmp_path}/packages", **sizes)


def digests(df):
    return by_row(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_pages_come_back_from_their_packages(spark, tmp_path):
    rows = hard_pages()
    got = zip_warc.archive_pages(frame(spark, rows), f"file://{tmp_path}/a")
    assert digests(got) == expected(rows)
    assert zip_warc.archive_pages(frame(spark, rows).limit(0), f"{tmp_path}/b").count() == 0


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in table.collect()]
    assert digests(queries.op11_zip_warc(spark, SF)) == expected(rows)


def test_small_packages_and_small_runs_give_the_same_records(spark, tmp_path):
    rows = hard_pages()
    written = packages(spark, tmp_path, rows, package_records=7)
    assert written.count() > 10 and written.agg({"records": "sum"}).first()[0] == len(rows)
    found = zip_warc.members(written)
    wide, narrow = (zip_warc.records(zip_warc.runs(found, size)).collect() for size in (1 << 30, 1))
    assert len(wide) == len(narrow) == len(rows) and by_row(wide) == by_row(narrow)
    payloads = {r.payload_digest: bytes(r.payload) for r in wide if r.payload is not None}
    assert {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in rows} == payloads
    assert {r.url for r in wide} >= {"http://a%20b%0D%0AWARC-Type:%20x{", "", None}


def test_packages_are_plain_zip_files_with_an_index_into_the_archive(spark, tmp_path):
    written = packages(spark, tmp_path, hard_pages()).collect()
    for package in written:
        with zipfile.ZipFile(package.path.removeprefix("file://")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            assert {r["path"] for r in json.loads(z.read("datapackage.json"))["resources"]} == {zip_warc.ARCHIVE, zip_warc.INDEX}
            assert len(z.read(zip_warc.INDEX).splitlines()) == package.records


def entries(data):
    return [(e[0], e[1], e[2]) for e in zip_warc.directory(data)]


def by_zipfile(z, data):
    out = []
    for i in z.infolist():
        data.seek(i.header_offset)
        head = data.read(30)
        out.append((i.filename, i.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"), i.compress_size))
    return out


def test_directory_agrees_with_the_standard_reader():
    data = io.BytesIO(b"bytes before the archive")
    with zipfile.ZipFile(data, "a") as z:
        for n in range(50):
            z.writestr(f"archive/é{n}", b"x" * n)
    plain = by_zipfile(zipfile.ZipFile(data), data)
    assert entries(data) == plain
    with zipfile.ZipFile(data, "a") as z:
        z.comment = b"a comment with PK\x05\x06 inside" + bytes(30)
    assert entries(data) == plain
    moved = io.BytesIO(b"put before" * 9 + data.getvalue())
    assert entries(moved) == [(name, start + 90, size) for name, start, size in entries(data)]
    with pytest.raises(ValueError, match="no ZIP end record"):
        entries(io.BytesIO(b"nothing of the kind"))


def test_directory_beyond_the_limits_of_plain_zip(tmp_path):
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for n in range(66_000):
            z.writestr(f"m{n}", b"")
    assert b"PK\x06\x06" in many.getvalue()[-98:] and entries(many) == by_zipfile(zipfile.ZipFile(many), many)
    moved = io.BytesIO(b"12345" + many.getvalue())
    assert entries(moved)[-1][1] == entries(many)[-1][1] + 5
    far = tmp_path / "far.zip"
    with open(far, "w+b") as file:
        file.truncate(5 << 30)  # a hole, no bytes on the disk
        file.seek(0, 2)
        with zipfile.ZipFile(file, "a") as z:
            z.writestr("archive/a", b"beyond four gigabytes")
            z.writestr("archive/b", b"more")
        file.flush()
        (first, second) = entries(file)
        assert first[1] > 5 << 30 and second[2] == 4
        file.seek(first[1])
        assert file.read(first[2]) == b"beyond four gigabytes"


def test_damage_is_told(spark, tmp_path):
    packed = tmp_path / "deflated.wacz"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zip_warc.ARCHIVE, b"x" * 1000)
    found = zip_warc.members(spark.createDataFrame([(str(packed),)], "path string"))
    with pytest.raises(Exception, match="not stored plainly"):
        zip_warc.runs(found).collect()
    record = zip_warc.warc_record(1, "u", b"payload", "0" * 64, None, "2020-01-01T00:00:00Z")
    plain = tmp_path / "noindex.wacz"
    import gzip
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr(zip_warc.ARCHIVE, gzip.compress(record))
    ranges = zip_warc.runs(zip_warc.members(spark.createDataFrame([(str(plain),)], "path string")))
    assert ranges.count() == 1  # an archive without an index is read whole
    with pytest.raises(Exception, match="differs from its digest"):
        zip_warc.records(ranges).collect()
    alone = zip_warc.warc_record(2, "u", b"", "1" * 64, 1, "2020-01-01T00:00:00Z")
    lost = tmp_path / "lost.wacz"
    with zipfile.ZipFile(lost, "w") as z:
        z.writestr(zip_warc.ARCHIVE, gzip.compress(alone))
    found = zip_warc.records(zip_warc.runs(zip_warc.members(spark.createDataFrame([(str(lost),)], "path string"))), payloads=False)
    with pytest.raises(Exception, match="no record to revisit"):
        zip_warc.resolved(found).collect()
