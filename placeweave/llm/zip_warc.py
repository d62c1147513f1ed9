"""Web archives packaged as ZIP files: written in bounded packages, read back by byte ranges without extraction.

A package is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` (one gzip member per WARC record),
``indexes/index.cdxj`` (one line per record with its offset and length inside the archive) and ``datapackage.json``.

Reading takes three steps, each a narrow table of its own:

1. ``members``: the end record, the ZIP64 locator and end record where there is one, and the central directory with its ZIP64
   fields are read from the end of each package; a member's first byte comes from its local header.
2. ``runs``: index members are read by range, line by line; neighbouring records are put together to runs of about ``RUN_BYTES``.
   An archive that no index names is one run.
3. ``records``: the runs are dealt over the tasks; each is one range read, unpacked record by record.

Payloads equal to an earlier one are revisit records: they name the record that holds the payload and have none themselves.
``resolved`` brings its size to them.

Packages are named by a random part per attempt and listed by the rows the writing tasks return: files of a lost or repeated
attempt are in no list. Tasks open paths with ``pyarrow.fs``, so the folder may be any store it knows (a mounted path,
``hdfs://``, ``s3://``, ``gs://``); it must be one that all executors reach.

Defined results: a null html is an empty payload; a null url gives a record without target, control characters in a url are
percent-encoded; rows that repeat a page_id and its payload are one record each and of one type; with several equal payloads a
null page_id revisits the smallest id, and without any id all are responses; an empty table gives no package and no rows. A
deflated or encrypted archive or index member is refused, since it can't be read by range.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.host_words import meet
from placeweave.session import cut_lineage

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Smaller payloads are always written whole.
LEAST_REVISITED = 100
#: A package is closed at this size or number of records, whichever comes first.
PACKAGE_BYTES, PACKAGE_RECORDS = 256 << 20, 50_000
RUN_BYTES = 4 << 20
READ_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
_CONTROL = re.compile("[\x00-\x20\x7f]")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

MANIFEST = "path string, bytes long, records long"
MEMBERS = "path string, member string, start long, size long, method int, encrypted boolean"
RUNS = "path string, start long, size long"
RECORDS = "path string, offset long, record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to string"


# Writing ----------------------------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, first``: ``first`` is the smallest page with the same payload, where a page revisits it.

    Payloads are compared by digest in a narrow table; each html is shuffled once, next to the decision on its row."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    narrow = rows.filter(F.octet_length("html") >= LEAST_REVISITED).select("page_id", "digest")
    firsts = cut_lineage(narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("uses")).filter("uses > 1"))
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    revisits = meet(narrow, firsts, "digest").filter(F.col("first").isNotNull() & later).select("page_id", "digest", "first").distinct()
    keyed = [df.withColumn("_row", F.xxhash64("page_id", "digest")) for df in (rows, revisits)]
    same = (F.col("r._row") == F.col("v._row")) & F.col("r.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("r.digest") == F.col("v.digest"))
    return keyed[0].alias("r").join(keyed[1].alias("v"), same, "left").select("r.page_id", "url", "html", "r.digest", "first")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    http = _HTTP.format(len(payload)).encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_CONTROL.sub(lambda c: f'%{ord(c[0]):02X}', url)}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first)}"]
    block = http + payload if first is None else http
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class Package:
    """A package under construction; only the index lines stay in memory."""

    def __init__(self, folder: fs.FileSystem, path: str) -> None:
        self.stream = folder.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.archive = self.zip.open(_entry(ARCHIVE), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> None:
        packed = gzip.compress(warc_record(page_id, url, payload, digest, first, date), 6, mtime=0)
        self.archive.write(packed)
        about = {"url": url, "digest": f"sha256:{digest}", "mime": "text/html" if first is None else "warc/revisit",
                 "offset": self.at, "length": len(packed), "filename": ARCHIVE.rpartition("/")[2]}
        self.lines.append(f"{_CONTROL.sub('', url or '') or '-'} {re.sub('[^0-9]', '', date)} {json.dumps(about)}\n")
        self.at += len(packed)

    def close(self) -> tuple[int, int]:
        self.archive.close()
        with self.zip.open(_entry(INDEX), "w", force_zip64=True) as index:
            for line in sorted(self.lines):
                index.write(line.encode())
        self.zip.writestr(_entry("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE}, {"path": INDEX}]}))
        self.zip.close()
        size = self.stream.tell()
        self.stream.close()
        return size, len(self.lines)


def _entry(name: str) -> zipfile.ZipInfo:
    return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))


def write_packages(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", package_bytes: int = PACKAGE_BYTES,
                   package_records: int = PACKAGE_RECORDS) -> DataFrame:
    """``path, bytes, records`` of the packages written below ``folder`` (a URI or an absolute path), a record per row of ``pages``."""
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        package, done = None, []

        def close() -> None:
            done.append((path, *package.close()))

        for frame in frames:
            for page_id, url, html, digest, first in frame.itertuples(index=False):
                if package is None:
                    store.create_dir(base, recursive=True)
                    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.wacz"
                    package = Package(store, f"{base.rstrip('/')}/{path.rpartition('/')[2]}")
                package.add(_integer(page_id), url, html.encode(), digest, _integer(first), date)
                if package.at >= package_bytes or len(package.lines) >= package_records:
                    close()
                    package = None
        if package is not None:
            close()
        if done:
            yield pd.DataFrame(done, columns=["path", "bytes", "records"])

    texts = with_revisits(pages).select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("first").cast("string"))
    return cut_lineage(texts.mapInPandas(write, MANIFEST))


def _integer(text: str | None) -> int | None:
    return None if text is None else int(text)


# Reading ----------------------------------------------------------------------------------------------------------------


def directory(file) -> Iterator[tuple[str, int, int, int, bool]]:
    """(name, first byte, size, method, encrypted) of every member, from the central directory of a seekable ZIP file.

    Sizes and places beyond 32 bits and counts beyond 16 come from the ZIP64 records. Bytes before the ZIP data are allowed: all
    places are moved by the distance between where the directory should end and where it does."""
    whole = file.seek(0, 2)
    begin = max(0, whole - 65_557)  # the end record and the longest comment
    file.seek(begin)
    tail = file.read(whole - begin)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # the comment may hold the mark
    if end < 0:
        raise ValueError("no ZIP end record")
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    directory_end = begin + end
    file.seek(max(0, directory_end - 20))
    locator = file.read(20) if directory_end >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        named = struct.unpack_from("<Q", locator, 8)[0]
        # Bytes before the ZIP data move the record; without extension fields it ends where the locator begins.
        for place in (named, directory_end - 76):
            file.seek(place)
            record = file.read(56)
            if record[:4] == b"PK\x06\x06":
                break
        else:
            raise ValueError("no ZIP64 end record where the locator points")
        count, size, at = struct.unpack_from("<QQQ", record, 32)
        directory_end = place
    moved = directory_end - size - at
    if moved < 0:
        raise ValueError("the ZIP directory reaches beyond its end record")
    file.seek(at + moved)
    entries = file.read(size)
    found, place = [], 0
    for _ in range(count):
        if entries[place:place + 4] != b"PK\x01\x02":
            raise ValueError("damaged ZIP directory")
        flags, method = struct.unpack_from("<HH", entries, place + 8)
        packed, length, name_size, extra_size, comment_size = struct.unpack_from("<IIHHH", entries, place + 20)
        header = struct.unpack_from("<I", entries, place + 42)[0]
        name = entries[place + 46:place + 46 + name_size].decode("utf-8" if flags & 0x800 else "cp437")
        extra = entries[place + 46 + name_size:place + 46 + name_size + extra_size]
        length, packed, header = _wide(extra, length, packed, header)
        found.append((name, packed, header + moved, method, bool(flags & 1)))
        place += 46 + name_size + extra_size + comment_size
    for name, packed, header, method, encrypted in found:
        file.seek(header)
        local = file.read(30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no ZIP member where {name} should begin")
        yield name, header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed, method, encrypted


def _wide(extra: bytes, *fields: int) -> list[int]:
    """The fields, those that are all ones replaced in order by the 64-bit values of the ZIP64 extra block."""
    place, wide = 0, b""
    while place + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, place)
        if kind == 1:
            wide = extra[place + 4:place + 4 + size]
        place += 4 + size
    out, place = [], 0
    for field in fields:
        if field == 0xFFFFFFFF:
            field = struct.unpack_from("<Q", wide, place)[0]
            place += 8
        out.append(field)
    return out


def _open(path: str):
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def members(packages: DataFrame) -> DataFrame:
    """The members of the packages at ``path``: where their bytes begin in the package, and how many there are."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                with _open(path) as file:
                    yield pd.DataFrame([(path, *entry) for entry in directory(file)],
                                       columns=["path", "member", "start", "size", "method", "encrypted"])

    return packages.select("path").repartition("path").mapInPandas(read, MEMBERS)


def _lines(file, start: int, size: int) -> Iterator[bytes]:
    """Lines of a byte range, read piece by piece."""
    file.seek(start)
    left, rest = size, b""
    while left:
        piece = file.read(min(READ_BYTES, left))
        if not piece:
            raise ValueError("the package ends inside a member")
        left -= len(piece)
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest


def runs(found: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``path, start, size``: byte ranges of whole records in the packages, about ``run_bytes`` each (a longer record comes alone)."""
    def ranges(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        path = frame["path"].iloc[0]
        needed = frame["member"].str.startswith(("archive/", "indexes/")) & ~frame["member"].str.endswith("/")
        refused = frame[needed & ((frame["method"] != 0) | frame["encrypted"])]
        if len(refused):
            raise ValueError(f"{path}: {refused['member'].iloc[0]} is not stored plainly")
        archives = {m.member.partition("/")[2]: (m.start, m.size) for m in frame[needed].itertuples() if m.member.startswith("archive/")}
        listed: dict[str, list[tuple[int, int]]] = {}
        with _open(path) as file:
            for index in frame[needed & frame["member"].str.startswith("indexes/") & frame["member"].str.endswith((".cdx", ".cdxj"))].itertuples():
                for line in _lines(file, index.start, index.size):
                    about = json.loads(line.split(b" ", 2)[2])
                    listed.setdefault(about["filename"], []).append((int(about["offset"]), int(about["length"])))
        for name, (start, size) in archives.items():
            if name not in listed:
                out.append((start, size))
                continue
            begin = end = -1
            for offset, length in sorted(set(listed[name])):
                if offset + length > size:
                    raise ValueError(f"{path}: the index names bytes beyond {name}")
                if offset != end or end - begin >= run_bytes:
                    if begin >= 0:
                        out.append((start + begin, end - begin))
                    begin = offset
                end = offset + length
            if begin >= 0:
                out.append((start + begin, end - begin))
        return pd.DataFrame([(path, *r) for r in out], columns=["path", "start", "size"])

    return found.groupBy("path").applyInPandas(ranges, RUNS)


def _unpacked(file, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of every gzip member of a byte range."""
    file.seek(start)
    left, held, place = size, b"", start
    while left or held:
        unpack, out, begin = zlib.decompressobj(31), [], place
        while not unpack.eof:
            if not held:
                held = file.read(min(READ_BYTES, left))
                if not held:
                    raise ValueError("a record ends beyond its range")
                left -= len(held)
            out.append(unpack.decompress(held))
            place += len(held) - len(unpack.unused_data)
            held = unpack.unused_data
        yield begin, b"".join(out)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload). The payload of an HTTP message is what follows its headers."""
    head, _, block = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    block = block[:int(headers["content-length"])]
    if headers.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return headers, block


def records(ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the ranges; with ``payloads`` also their bytes. A payload that differs from its digest is an error.

    ``payload_bytes`` of a revisit record is null: ``resolved`` knows it. Records of other kinds (warcinfo, metadata) are skipped."""
    columns = [part.split()[0] for part in RECORDS.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for frame in frames:
            for path, start, size in frame[["path", "start", "size"]].itertuples(index=False):
                with _open(path) as file:
                    for place, record in _unpacked(file, start, size):
                        headers, payload = parse_record(record)
                        kind, digest = headers.get("warc-type"), headers.get("warc-payload-digest", "").removeprefix("sha256:")
                        if kind not in ("response", "revisit", "resource"):
                            continue
                        if kind != "revisit":
                            seen = hashlib.sha256(payload).hexdigest()
                            if digest and digest != seen:
                                raise ValueError(f"{path}: the payload of {headers.get('warc-record-id')} differs from its digest")
                            digest = seen
                        rows.append((path, place, headers.get("warc-record-id"), kind, headers.get("warc-target-uri"), digest,
                                     None if kind == "revisit" else len(payload), headers.get("warc-refers-to"),
                                     *([None if kind == "revisit" else payload] if payloads else [])))
                        held += len(payload) if payloads else 0
                        if held >= BATCH_BYTES or len(rows) >= 10_000:
                            yield frame_of(rows)
                            rows, held = [], 0
        if rows:
            yield frame_of(rows)

    def frame_of(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[*columns, *(["payload"] if payloads else [])])
        return out.astype({"payload_bytes": "Int64"})

    return ranges.repartition("path", "start").mapInPandas(read, RECORDS + (", payload binary" if payloads else ""))


def resolved(found: DataFrame) -> DataFrame:
    """``found`` (narrow records) with the size of their target's payload on revisit records. A revisit without its target is an error."""
    wanted = found.filter("record_type = 'revisit'")
    uses = wanted.groupBy("refers_to", "payload_digest").agg(F.count(F.lit(1)).alias("uses"))
    targets = found.filter("record_type <> 'revisit'").groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(
        F.first("payload_bytes").alias("full"))
    met = uses.join(targets, ["refers_to", "payload_digest"], "left").withColumn("target", F.struct("refers_to", "payload_digest"))
    checked = cut_lineage(met.select("target", "uses", F.coalesce("full", F.raise_error(F.concat(
        F.lit("no record to revisit: "), F.coalesce("refers_to", F.lit("none")))).cast("long")).alias("full")))
    whole = meet(wanted.withColumn("target", F.struct("refers_to", "payload_digest")), checked, "target")
    return found.filter("record_type <> 'revisit'").unionByName(
        whole.withColumn("payload_bytes", F.col("full")).select(*found.columns))


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every row, as read back from the packages below ``folder``."""
    packages = write_packages(pages, folder)
    found = resolved(cut_lineage(records(runs(members(packages)), payloads=False)))

    def page(column: str) -> F.Column:
        return F.regexp_extract(column, "^<urn:page:(.+)>$", 1).try_cast("long")

    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
