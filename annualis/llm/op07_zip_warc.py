"""WARC records in ZIP-packaged archives: written from a table of pages, read back by ranges.

An archive is a ZIP file with two stored (uncompressed) members: ``archive/data.warc.gz``, a
run of separately gzipped WARC records, and ``indexes/index.cdx``, one line per record with
its offset and length in that member.  The reader never unpacks a member: it reads the end
of the file, parses the end-of-directory record (or the ZIP64 one it points to) and the
central directory, finds where the stored members start, reads the index and then reads
each record by its byte range.

Tasks write archives of bounded size under unique names into the shared folder and return
their paths, which become a written table; a repeated task writes new files, and files of a
lost attempt are in no list."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annualis.llm.common import scratch_path, written

REVISIT_BYTES = 1000
#: Compressed bytes of records after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: Bytes of neighbouring records read at once.
READ_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_EMPTY_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder named by a Spark path."""
    if "://" not in uri and not re.match(r"[a-z0-9]+:/", uri):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub(r"^([a-z0-9]+):/(?!/)", r"\1:///", uri))


# --- records -------------------------------------------------------------------------------


def target_uri(page_id: int, url: str | None) -> str:
    return urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url else f"urn:page:{page_id}"


def warc_record(page_id: int, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """A gzipped response record, or a revisit record without payload if ``refers_to`` is given."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Date: {_EMPTY_DATE}", f"WARC-Target-URI: {target_uri(page_id, url)}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(packed: bytes) -> dict:
    """Fields of a gzipped WARC record; a response's digest is computed from its payload and
    must be the one it states."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[:int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http).group(1))
    digest = field["warc-payload-digest"].removeprefix("sha1:")
    kind = field["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload of {field['warc-record-id']}")
    number = lambda v: int(v.strip("<>").rpartition(":")[2]) if v else None
    return {"page_id": number(field["warc-record-id"]), "url": field["warc-target-uri"], "payload_bytes": size,
            "payload_digest": digest, "record_type": kind, "refers_to": number(field.get("warc-refers-to")), "payload": payload}


def pack_archive(records: list[bytes], ids: list[int]) -> bytes:
    """A ZIP file of the records and their index."""
    index, at = [], 0
    for i, r in zip(ids, records, strict=True):
        index.append(f"{i} {at} {len(r)}\n")
        at += len(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(DATA), b"".join(records))
        z.writestr(zipfile.ZipInfo(INDEX), "".join(index))
    return out.getvalue()


# --- ZIP directories -----------------------------------------------------------------------


def central_directory(f, size: int) -> dict[str, dict]:
    """name -> {method, size, packed, header} of every member of a ZIP file of ``size`` bytes.

    Only the directories are read.  ZIP64 records and extra fields replace the 32-bit values
    that are at their limit."""
    tail = min(size, 22 + 65535)
    f.seek(size - tail)
    end = f.read(tail)
    at = end.rfind(b"PK\x05\x06")
    while at >= 0 and (len(end) < at + 22 or at + 22 + struct.unpack_from("<H", end, at + 20)[0] != len(end)):
        at = end.rfind(b"PK\x05\x06", 0, at)  # the signature may occur inside a comment
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", end, at + 10)
    if at >= 20 and end[at - 20:at - 16] == b"PK\x06\x07":
        f.seek(struct.unpack_from("<Q", end, at - 12)[0])
        record = f.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    f.seek(start)
    directory, members, at = f.read(length), {}, 0
    for _ in range(count):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, whole, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = directory[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # 64-bit values stand in this order, each only if its field is full
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                whole = next(wide) if whole == 0xFFFFFFFF else whole
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            e += 4 + n
        members[name] = {"method": method, "size": whole, "packed": packed, "header": header, "encrypted": bool(flags & 1)}
        at += 46 + n_name + n_extra + n_comment
    return members


def stored_start(f, member: dict) -> int:
    """Where the bytes of a stored member begin."""
    if member["method"] != 0 or member["encrypted"]:
        raise ValueError("the member is not stored: its records have no byte ranges")
    f.seek(member["header"])
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("damaged local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member["header"] + 30 + n_name + n_extra


def range_read(f, size: int) -> Iterator[bytes]:
    """The packed records of an archive in index order, by byte ranges; ranges that touch
    are read together, ``READ_BYTES`` at most at once (a longer record alone)."""
    members = central_directory(f, size)
    start = stored_start(f, members[INDEX])
    f.seek(start)
    entries = [tuple(map(int, line.split()[1:])) for line in f.read(members[INDEX]["size"]).decode().splitlines()]
    base = stored_start(f, members[DATA])
    i = 0
    while i < len(entries):
        first, j, stop = entries[i][0], i, entries[i][0]
        while j < len(entries) and entries[j][0] == stop and (j == i or stop + entries[j][1] - first <= READ_BYTES):
            stop += entries[j][1]
            j += 1
        f.seek(base + first)
        got = f.read(stop - first)
        for at, n in entries[i:j]:
            yield got[at - first:at - first + n]
        i = j


# --- on Spark ------------------------------------------------------------------------------


def with_record_types(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html (null for revisits), payload_bytes, payload_digest, refers_to."""
    raw = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    sized = pages.select("page_id", "url", "html", F.octet_length(raw).cast("long").alias("payload_bytes"), F.sha1(raw).alias("payload_digest"))
    heads = (sized.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
             .agg(F.max("page_id").alias("head"), F.min("page_id").alias("low")).where("head <> low").drop("low"))
    refers = F.when(F.col("page_id") < F.col("head"), F.col("head"))
    return sized.join(heads, "payload_digest", "left").select(
        "page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "payload_bytes", "payload_digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one WARC record per page into archives below ``folder``; (path, records) of each.

    Of records with equal payloads of at least ``least`` bytes the one with the largest id
    is a response and the others revisit it.  Null html is an empty payload; rows without an
    id have no record; rows that repeat an id each get a record, of the same type; extra
    columns are ignored."""
    rows = with_record_types(pages.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html")), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = open_fs(folder)
        records: list[bytes] = []
        ids: list[int] = []

        def closed() -> pa.RecordBatch:
            path = f"{top}/{uuid.uuid4().hex}.wacz"
            with files.open_output_stream(path) as f:
                f.write(pack_archive(records, ids))
            done = pa.record_batch([pa.array([path]), pa.array([len(ids)], pa.int64())], ["path", "records"])
            records.clear()
            ids.clear()
            return done

        files.create_dir(top, recursive=True)
        size = 0
        for b in batches:
            for i, url, html, n, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                records.append(warc_record(i, url, (html or "").encode(), n, digest, refers))
                ids.append(i)
                size += len(records[-1])
                if size >= archive_bytes:
                    size = 0
                    yield closed()
        if ids:
            yield closed()

    return written(rows.mapInArrow(run, "path string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of
    the archives listed in ``archives`` (path); url is the record's target, percent-encoded."""
    n = archives.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_fs(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with files.open_input_file(path) as f:
                    rows = []
                    for packed in range_read(f, f.size()):
                        r = parse_record(packed)
                        del r["payload"]
                        rows.append(r)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return archives.select("path").repartition(max(1, n)).mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64())])


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written as archives into the shared checkpoint folder and read back."""
    folder = scratch_path(spark, "warc")
    return read_archives(write_archives(pages, folder), folder)
