"""WARC archives: a writer of deduplicated records and a Python data source that reads them.

Records are gzip members of their own, so a reader can start at any and skip whole ones: each member's header
carries the compressed and plain sizes in an extra field (``sl``), as web archives use it. Equal payloads
are stored once: the page with the smallest id gets a ``response`` record, the others a ``revisit`` record that
refers to it and keeps the HTTP header, and with it the length of the payload, only.

Reading (``spark.read.format("warc")``) plans one partition per archive file, takes filters on record type and
on header columns, parses a record's headers before anything else, and neither inflates nor decodes the
payloads of records that the filters or the option ``payload`` = ``false`` don't want.

Nulls: a null html is an empty payload, a null url an empty target, a null page id an empty name, which reads
back as null. Rows that share a smallest id are all response. Empty tables write no archive and read no row.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .common import open_fs, staged, work_dir

#: Plain bytes after which a writer starts another archive.
ARCHIVE_BYTES = 64 << 20
NAME = "urn:tensorfold:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes bigint, headers map<string,string>, payload binary"
#: Filters the reader takes: by column, the header whose value it is.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header's value has no line ends; those of odd urls are percent-encoded."""
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", value)


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, stored: bool) -> bytes:
    """A response with its payload, or a revisit of the response of page ``first``."""
    name = lambda i: f"<{NAME}{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if stored else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if stored else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if not stored:
        head += [f"WARC-Refers-To: {name(first)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def gzip_member(plain: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field ``sl`` has its compressed and plain sizes."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBB", 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def manifest_of(path: str) -> str:
    """Where the manifest of the archives below ``path`` is."""
    return f"{path}/manifest"


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_payload: int = 0) -> DataFrame:
    """Write a record for each row of ``pages`` below ``path``; returns the manifest (file, records, bytes).

    A task names its archives by a random id, and only those of the manifest count: what a lost or repeated
    task leaves behind is never read. The manifest is a table in ``path``, so nothing is written twice.
    """
    import pyarrow as pa

    rows = pages.select(pages[page_id].cast("bigint").alias("id"), pages[url].cast("string").alias("url"), F.coalesce(pages[html].cast("string"), F.lit("")).alias("html"))
    digests = rows.withColumn("sha", F.sha1("html"))
    # Of payloads that occur once nothing has to be known; copies are counted before the shuffle.
    firsts = digests.where(F.octet_length("html") >= min_payload).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = staged(firsts.select(F.col("sha").alias("copied"), "first"), "firsts")
    named = digests.join(firsts, F.col("sha") == F.col("copied"), "left").select("id", "url", "html", "first", (F.col("copied").isNull() | F.col("id").eqNullSafe(F.col("first"))).alias("stored"))

    def run(batches):
        chunks, records, size, made = [], 0, 0, []

        def put():
            file = f"{path}/pages-{uuid.uuid4().hex}.warc.gz"
            fs, at = open_fs(file)
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            info = gzip_member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % (str(uuid.uuid4()).encode(), DATE.encode()))
            with fs.open_output_stream(at, compression=None) as out:
                for chunk in [info, *chunks]:
                    out.write(chunk)
            made.append((file, records, len(info) + sum(map(len, chunks))))

        for batch in batches:
            for i in range(batch.num_rows):
                one = [c[i].as_py() for c in batch.columns]
                plain = page_record(one[0], one[1], one[2].encode(), one[3], one[4])
                chunks.append(gzip_member(plain))
                records, size = records + 1, size + len(plain)
                if size >= ARCHIVE_BYTES:
                    put()
                    chunks, records, size = [], 0, 0
        if chunks:
            put()
        files, counts, sizes = zip(*made) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "records", "bytes"])

    manifest = named.mapInArrow(run, "file string, records bigint, bytes bigint")
    manifest.write.parquet(manifest_of(path))
    return pages.sparkSession.read.schema(manifest.schema).parquet(manifest_of(path))


class Archive:
    """Reads the records of one archive, gzipped by member or plain, headers first."""

    def __init__(self, stream, gzipped: bool):
        self.stream, self.gzipped = stream, gzipped

    def _line(self, buf: bytes) -> int:
        return buf.find(b"\r\n\r\n")

    def records(self, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """(headers, block) of the records for whose headers ``wanted`` holds; no block unless ``payload``, but the
        HTTP header at least."""
        yield from (self._gzipped(wanted, payload) if self.gzipped else self._plain(wanted, payload))

    def _gzipped(self, wanted, payload: bool):
        while head := self.stream.read(12):
            flags, start = head[3], self.stream.tell() - 12
            member_size = None
            if flags & 4:
                extra = self.stream.read(struct.unpack("<H", head[10:12])[0])
                at = 0
                while at + 4 <= len(extra):
                    tag, n = extra[at : at + 2], struct.unpack("<H", extra[at + 2 : at + 4])[0]
                    if tag == b"sl" and n == 8:
                        member_size = struct.unpack("<I", extra[at + 4 : at + 8])[0]
                    at += 4 + n
            self.stream.seek(start)
            inflate, out = zlib.decompressobj(31), b""
            while self._line(out) < 0 and not inflate.eof:
                chunk = inflate.unconsumed_tail or self.stream.read(1 << 12)
                if not chunk:
                    raise ValueError("an archive ends within a record")
                out += inflate.decompress(chunk, 1 << 12)
            headers, at = self._headers(out)
            take = wanted(headers)
            enough = 1 << 62 if take and payload else at + 4096 if take else 0
            length = int(headers.get("content-length", 0))
            while len(out) < min(enough, at + length) and not inflate.eof:
                chunk = inflate.unconsumed_tail or self.stream.read(1 << 18)
                out += inflate.decompress(chunk, 1 << 20)
            if take:
                yield headers, out[at : at + length]
            if member_size is not None:
                self.stream.seek(start + member_size)
                continue
            # Without the extra field the member's end is found by inflating, and dropping, the rest.
            while not inflate.eof:
                chunk = inflate.unconsumed_tail or self.stream.read(1 << 18)
                if not chunk:
                    raise ValueError("an archive ends within a record")
                inflate.decompress(chunk, 1 << 20)
            self.stream.seek(self.stream.tell() - len(inflate.unused_data))

    def _plain(self, wanted, payload: bool):
        buf = b""
        while True:
            while self._line(buf) < 0:
                chunk = self.stream.read(1 << 14)
                if not chunk:
                    return
                buf = (buf + chunk).lstrip(b"\r\n")
            headers, at = self._headers(buf)
            length, take = int(headers.get("content-length", 0)), wanted(headers)
            need = length if take and payload else min(length, 4096) if take else 0
            if len(buf) < at + need:
                buf += self.stream.read(at + need - len(buf))
            if take:
                yield headers, buf[at : at + need]
            rest = len(buf) - at - length
            if rest >= 0:
                buf = buf[at + length :].lstrip(b"\r\n")
            else:
                self.stream.seek(self.stream.tell() - rest)
                buf = b""

    def _headers(self, buf: bytes) -> tuple[dict[str, str], int]:
        at = self._line(buf)
        first, *lines = buf[:at].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        pairs = (line.partition(":") for line in lines)
        return {k.strip().lower(): v.strip() for k, _, v in pairs}, at + 4


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """The HTTP headers and body of a block; a block that isn't HTTP is all body."""
    if not block.startswith(b"HTTP/") or (at := block.find(b"\r\n\r\n")) < 0:
        return {}, block
    pairs = (line.partition(":") for line in block[:at].decode("latin-1").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, block[at + 4 :]


class FilePartition(InputPartition):
    def __init__(self, file: str):
        self.file = file


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.filters = options, []

    def pushFilters(self, filters: list[Filter]):
        """Takes equalities, IN and prefixes on header columns; the rest goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.filters.append((name, "prefix" if isinstance(f, StringStartsWith) else "in", f.value if isinstance(f, (In, StringStartsWith)) else [f.value]))
            else:
                yield f

    def partitions(self):
        if "manifest" in self.options:
            import pyarrow.parquet as pq

            fs, path = open_fs(self.options["manifest"])
            files = pq.read_table(path, columns=["file"], filesystem=fs)["file"].to_pylist()
        elif "files" in self.options:
            files = json.loads(self.options["files"])
        else:
            from pyarrow import fs as pafs

            fs, path = open_fs(self.options["path"])
            prefix = self.options["path"][: -len(path)] if self.options["path"].endswith(path) else "file://"
            found = [fs.get_file_info(path)] if fs.get_file_info(path).is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
            files = [prefix + x.path for x in found if x.is_file and re.search(r"\.warc(\.gz)?$", x.path)]
        return [FilePartition(f) for f in sorted(files)]

    def read(self, partition):
        if partition is None:
            return
        payload, verify = (self.options.get(k, d).lower() == "true" for k, d in (("payload", "true"), ("verify", "false")))
        tests = [(HEADERS[name], how, [self._stored(name, v) for v in values] if how == "in" else self._stored(name, values)) for name, how, values in self.filters]

        def wanted(headers: dict[str, str]) -> bool:
            return all((headers.get(h) or "").startswith(v) if how == "prefix" else headers.get(h) in v for h, how, v in tests)

        fs, path = open_fs(partition.file)
        with fs.open_input_file(path) as stream:
            for headers, block in Archive(stream, partition.file.endswith(".gz")).records(wanted, payload or verify):
                http, body = split_http(block)
                named = {c: headers.get(h) for c, h in HEADERS.items()}
                for c in ("record_id", "refers_to"):
                    named[c] = named[c] and named[c].strip("<>")
                digest = (named["payload_digest"] or "").removeprefix("sha1:") or None
                length = int(http.get("content-length", len(body))) if http or headers.get("content-length") != "0" else 0
                if verify and digest and named["record_type"] == "response" and (digest, length) != (payload_digest(body), len(body)):
                    raise ValueError(f"the payload of {named['record_id']} isn't what its digest says")
                yield named["record_type"], named["record_id"], named["target_uri"], named["date"], digest, named["refers_to"], length, headers, body if payload else None

    @staticmethod
    def _stored(name: str, value: str) -> str:
        """How a column's value stands in its header."""
        return f"<{value}>" if name in ("record_id", "refers_to") else f"sha1:{value}" if name == "payload_digest" else value


class WarcDataSource(DataSource):
    """Options: ``path`` (an archive or a folder of them), or ``files`` (a JSON list), or ``manifest`` (what
    ``write_archives`` left); ``payload`` = ``false`` leaves payloads out; ``verify`` = ``true`` reads them anyway and
    compares each response's with its digest and length."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_archives(spark: SparkSession, payload: bool = True, verify: bool = False, **options: str) -> DataFrame:
    """The records of archives: ``read_archives(spark, path=...)``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(payload=str(payload).lower(), verify=str(verify).lower(), **options).load()


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Write a record for each page, read the archives back and verify them: each page's record."""
    folder = work_dir(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    records = read_archives(spark, payload=False, verify=True, manifest=manifest_of(folder))
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(NAME) + 1}) as bigint)")
    return records.where(F.col("record_type").isin("response", "revisit")).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


_BIT = " + ".join(f"{1 << 4 - k} * (substr(bits, 5 * i + {k + 1}, 1) = '1')::INT" for k in range(5))
OP5_SQL = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages),
spelled AS (
  SELECT *, array_to_string([right(bin(16 + instr('0123456789abcdef', substr(sha, i + 1, 1)) - 1), 4) for i in range(40)], '') AS bits,
         min(page_id) OVER (PARTITION BY sha) AS first FROM payloads)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BIT}, 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM spelled
"""
