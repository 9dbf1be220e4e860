"""Web archives in ZIP packages: written by tasks, read back by byte ranges.

Writing: every task packs its pages into archives of a bounded size. An archive is a ZIP file whose members are
stored, not compressed: ``archive/data-*.warc.gz`` with one gzip member per WARC record, and
``indexes/index-*.cdxj`` with the place of each record in its data member. Pages with equal payloads of at
least ``least_bytes`` are one ``response`` (the least page id) and ``revisit`` records that name it.

Reading: the end of the file is read for its end record (and, for large packages, the ZIP64 locator and
end record), then the central directory, where sizes and offsets over 32 bits stand in ZIP64 fields,
then the index members. From the index come rows of file, offset and length, which
Spark deals out anew; each task reads ranges of neighbouring records, never a member as a whole.
Digests are recomputed from the payloads and compared.

Archives live in a folder that driver and executors share, by any scheme that ``pyarrow.fs`` opens. A task's
files have a name of their own attempt and count only once its row is in the manifest, which is stored; a
task that is run again leaves no doubled records. Payloads are never shuffled, equal payloads are found by their
digest with partial minima, and memory holds one member (``MEMBER_BYTES``) or one record, if that is larger.

Edge cases: a null page has an empty payload; rows with the least id of their payload are all responses, so
repeated rows stay repeated; null ids come last and have no id in the result; an empty table gives no archive
and an empty result. Only the id, url and payload columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordloom.llm.common import shipped_if_small
from recordloom.session import cut_lineage, stage_path
from recordloom.sources.files import open_path

#: A data member is closed at this size, an archive at the next one.
MEMBER_BYTES = 16 << 20
ARCHIVE_BYTES = 256 << 20
#: Bytes that a task asks for at once when it reads records.
READ_BYTES = 4 << 20
#: Broadcast bound for groups of equal payloads, about 80 MB in memory.
MOST_GROUPS = 500_000

DATE = "2024-01-01T00:00:00Z"
# Fixed values of the formats.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- writing ---------------------------------------------------------------------------------

def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record as a gzip member."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>",
            f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


class _Archive:
    """One ZIP package under way."""

    def __init__(self, path: str):
        self.path, self.records = path, 0
        system, place = open_path(path)
        self.stream = system.open_output_stream(place)
        self.zip = zipfile.ZipFile(_Counted(self.stream), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data, self.index, self.members, self.size = io.BytesIO(), [], 0, 0

    def add(self, page_id, digest: str, url: str | None, packed: bytes) -> None:
        at = self.data.tell()
        self.data.write(packed)
        self.index.append(f"{quote(url or '-', safe='/:?=')} {re.sub('[^0-9]', '', DATE)} " + json.dumps(
            {"id": page_id, "digest": f"sha1:{digest}", "filename": f"data-{self.members:05d}.warc.gz",
             "offset": at, "length": len(packed)}))
        self.records += 1
        self.size += len(packed)
        if self.data.tell() >= MEMBER_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.index:
            self.zip.writestr(f"archive/data-{self.members:05d}.warc.gz", self.data.getbuffer())
            self.zip.writestr(f"indexes/index-{self.members:05d}.cdxj", "\n".join(self.index) + "\n")
            self.data, self.index = io.BytesIO(), []
            self.members += 1

    def close(self) -> tuple[str, int, int]:
        self.flush()
        self.zip.close()
        size = self.stream.tell()
        self.stream.close()
        return self.path, size, self.records


class _Counted(io.RawIOBase):
    """The writable side of a stream that cannot go back."""

    def __init__(self, stream):
        super().__init__()
        self.stream = stream

    def writable(self):
        return True

    def write(self, data):
        self.stream.write(data)
        return len(data)

    def flush(self):
        pass


def _packing(folder: str, archive_bytes: int):
    """Arrow batches (id, url, payload, sha1, refers_to) -> a row per finished archive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, open_, done = uuid.uuid4().hex, None, []
        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for k in range(batch.num_rows):
                page_id, url, text, sha1, refers_to = (c[k].as_py() for c in columns)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                if open_ is None:
                    open_ = _Archive(f"{folder}/pages-{attempt}-{len(done):05d}.wacz")
                open_.add(page_id, digest, url, record(page_id, url, text.encode(), digest, refers_to))
                if open_.size >= archive_bytes:
                    done.append(open_.close())
                    open_ = None
        if open_ is not None:
            done.append(open_.close())
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))],
                ["path", "size", "records"])
    return run


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages and return the stored manifest: ``path, size, records``."""
    system, place = open_path(folder)
    system.create_dir(place, recursive=True)
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("string").alias("id"), F.col(page_id).alias("_id"),
                        F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    groups = (
        rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .where((F.col("_n") > 1) & F.col("_first").isNotNull()).select(F.col("sha1").alias("_sha1"), "_first"))
    groups = shipped_if_small(groups, MOST_GROUPS)
    told = rows.join(groups, F.col("sha1") == F.col("_sha1"), "left")
    refers_to = F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first").cast("string"))
    return cut_lineage(
        told.select("id", "url", "payload", "sha1", refers_to.alias("refers_to"))
        .mapInArrow(_packing(folder, archive_bytes), "path string, size long, records long"))


# --- reading ---------------------------------------------------------------------------------

def _range(file, at: int, n: int) -> bytes:
    file.seek(at)
    data = file.read(n)
    if len(data) != n:
        raise ValueError(f"the file ends before {at + n}")
    return data


def _end_record(file, size: int) -> tuple[int, int, int]:
    """Number of entries, size and offset of the central directory."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = _range(file, tail_at, size - tail_at)
    k = tail.rfind(END)
    # the comment must reach to the end of the file, else the signature is part of it
    while k >= 0 and not (k + 22 <= len(tail) and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] == len(tail)):
        k = tail.rfind(END, 0, k)
    if k < 0:
        raise ValueError("no end record: not a ZIP file")
    entries, length, offset = struct.unpack_from("<HII", tail, k + 10)
    if entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        at = tail_at + k - 20
        locator = _range(file, at, 20) if at >= 0 else b""
        if locator[:4] == LOCATOR64:
            end64 = _range(file, struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 end record where the locator points")
            entries, length, offset = struct.unpack_from("<QQQ", end64, 32)
    return entries, length, offset


def directory(file, size: int) -> list[tuple[str, int, int, int]]:
    """``name, method, first byte of the data, stored size`` of every member."""
    entries, length, offset = _end_record(file, size)
    table = _range(file, offset, length)
    members, at = [], 0
    for _ in range(entries):
        if table[at:at + 4] != ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", table, at + 8)
        packed, plain = struct.unpack_from("<II", table, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", table, at + 28)
        header = struct.unpack_from("<I", table, at + 42)[0]
        name = table[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = table[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                # only the fields that do not fit above, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + n:]
        members.append((name, method, header, packed))
        at += 46 + n_name + n_extra + n_comment
    found = []
    for name, method, header, packed in members:
        local = _range(file, header, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        found.append((name, method, header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed))
    return found


def _lines(file, at: int, n: int) -> Iterator[bytes]:
    """Lines of a member, a block at a time."""
    rest = b""
    while n:
        block = _range(file, at, min(n, READ_BYTES))
        at, n = at + len(block), n - len(block)
        *lines, rest = (rest + block).split(b"\n")
        yield from lines
    if rest:
        yield rest


def _indexed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Archives -> the place of every record."""
    names = ["path", "at", "length"]
    for frame in frames:
        for path, size in zip(frame["path"], frame["size"]):
            system, place = open_path(path)
            rows = []
            with system.open_input_file(place) as file:
                members = directory(file, int(size))
                stored = {name.rpartition("/")[2]: at for name, method, at, _ in members
                          if name.startswith("archive/") and method == 0}
                for name, method, at, n in members:
                    if not name.startswith("indexes/") or method != 0:
                        continue
                    for line in _lines(file, at, n):
                        entry = json.loads(line.split(b" ", 2)[2])
                        rows.append((path, stored[entry["filename"]] + entry["offset"], entry["length"]))
                        if len(rows) >= 50_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
            yield pd.DataFrame(rows, columns=names)


def parse(packed: bytes) -> tuple:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of a gzip member; checks the digest."""
    head, _, rest = gzip.decompress(packed).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"\r\ncontent-length: (\d+)", http, re.I).group(1))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (n != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    page_of = lambda x: x.removeprefix("<urn:page:").removesuffix(">") or None if x else None
    return page_of(fields["warc-record-id"]), n, digest, kind, page_of(fields.get("warc-refers-to"))


RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _ranged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of records, in order -> the records."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    for frame in frames:
        for path, rows in frame.groupby("path", sort=False):
            system, place = open_path(path)
            rows = rows.sort_values("at")
            at, n = rows["at"].to_numpy(), rows["length"].to_numpy()
            with system.open_input_file(place) as file:
                i = 0
                while i < len(at):
                    j = i + 1
                    while j < len(at) and at[j] == at[j - 1] + n[j - 1] and at[j] + n[j] - at[i] <= READ_BYTES:
                        j += 1
                    data = _range(file, int(at[i]), int(at[j - 1] + n[j - 1] - at[i]))
                    yield pd.DataFrame([parse(data[at[k] - at[i]:at[k] - at[i] + n[k]]) for k in range(i, j)], columns=names)
                    i = j


def read(manifest: DataFrame) -> DataFrame:
    """The records of all archives in a manifest (``path, size``)."""
    places = manifest.select("path", "size").repartition("path") \
        .mapInPandas(_indexed, "path string, at long, length long")
    block = F.floor(F.col("at") / READ_BYTES)
    return places.repartition("path", block).sortWithinPartitions("path", "at").mapInPandas(_ranged, RECORD)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
               least_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back; ids in their own type."""
    kind = dict(pages.dtypes)[page_id]
    manifest = write(pages, stage_path(pages.sparkSession, "archives"), page_id, url, html, least_bytes)
    return read(manifest).select(
        F.col("page_id").cast(kind).alias(page_id), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))
