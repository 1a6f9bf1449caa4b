"""WARC archives: write, read, and resolve revisits into deduplicated archives.

Archives are WARC/1.1 files of gzip members, a record each, in the folder that all executors
share, reached through pyarrow's file systems (file, hdfs, s3, gs). A task writes under a name
of its own and returns each record's path, offset and length; only files that a finished
task has named are ever read, so a lost or repeated task leaves nothing wrong behind.

Revisits: headers are shuffled by payload digest, and the record with the largest key of each
digest is the original. The archives are then written anew, in ranges of records read by
offset: the original as it was, any other as a revisit without payload, all with fresh headers.
Payloads never go through a shuffle.

Defined results: a null payload counts as empty; equal payloads under one key: the last by
place is the original and the others revisit it; null keys come before all others and give a
null ``refers_to``; an empty table gives no archive and an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import NamedTuple
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import new_path, read_table, written

ARCHIVE_BYTES = 64 << 20  # a task begins another file then
FILES_IN_TASK = 8  # archives that a reading task goes through, where there are many
PIECE_BYTES = 4 << 20  # of an archive that are dealt together when it is written anew
READ_BYTES = 1 << 20
LEAST = 0  # bytes of a payload from which on equal ones are revisits
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLACES = "path string, offset long, length long"
HEADERS = f"{PLACES}, record_id string, record_type string, uri string, page_id long, payload_digest string, payload_bytes long, refers_to_id string, refers_to long"


class Record(NamedTuple):
    fields: dict[str, str]
    payload: bytes


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def _member(fields: dict[str, str | None], payload: bytes) -> bytes:
    """One record as a gzip member: WARC header, HTTP header, payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n", 1, mtime=0)


def _parsed(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return Record(fields, block.partition(b"\r\n\r\n")[2])


def _clean(uri: str | None) -> str | None:
    """A URI without blanks, control or non-ASCII characters."""
    return None if uri is None else quote(uri, safe="%/:=&?~#+!$,;'@()*[]")


def _system(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(folder)


class _Writer:
    """Appends members to files of this task."""

    def __init__(self, folder: str) -> None:
        self.folder, (self.system, self.root) = folder, _system(folder)
        self.system.create_dir(self.root, recursive=True)
        self.out = None

    def name(self) -> tuple[str, int]:
        """Where the next member goes."""
        if self.out is None or self.size >= ARCHIVE_BYTES:
            self.close()
            self.file, self.size = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.system.open_output_stream(f"{self.root}/{self.file}", compression=None)
        return f"{self.folder}/{self.file}", self.size

    def add(self, member: bytes) -> int:
        self.out.write(member)
        self.size += len(member)
        return len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", date: str | None = None) -> DataFrame:
    """A response record for each row; (path, offset, length) of each record, written already."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _Writer(folder)
        for b in batches:
            places = []
            for at, text, number, known in zip(b["uri"], b["payload"], b["key"], b["has_key"], strict=True):
                body = ("" if text is None else text).encode("utf-8", "surrogatepass")
                path, offset = out.name()
                fields = {
                    "WARC-Type": "response", "WARC-Record-ID": f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{offset}').urn}>", "WARC-Date": date,
                    "WARC-Target-URI": _clean(at), "WARC-Payload-Digest": f"sha1:{digest_of(body)}", "X-Page-Id": str(number) if known else None,
                }
                places.append((path, offset, out.add(_member(fields, body))))
            yield pd.DataFrame(places, columns=["path", "offset", "length"])
        out.close()

    rows = pages.select(F.coalesce(key, F.lit(0)).cast("long").alias("key"), F.col(key).isNotNull().alias("has_key"), F.col(uri).cast("string").alias("uri"), F.col(payload).alias("payload"))
    return written(rows.mapInPandas(write, PLACES), "warc-places")


def _members(system: arrow_fs.FileSystem, path: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of each gzip member of a file, read as a stream."""
    with system.open_input_stream(path, compression=None) as f:
        left, offset = f.read(READ_BYTES), 0
        while left:
            unpack, parts, length = zlib.decompressobj(31), [], 0
            while not unpack.eof:
                if not left:
                    raise EOFError(f"{path}: cut off at {offset + length}")
                parts.append(unpack.decompress(left))
                length += len(left) - len(unpack.unused_data)
                left = unpack.unused_data or f.read(READ_BYTES)
            yield offset, length, b"".join(parts)
            offset += length


def _header(path: str, offset: int, length: int, record: Record) -> tuple:
    f, revisit = record.fields, record.fields["WARC-Type"] == "revisit"
    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and digest_of(record.payload) != digest:
        raise ValueError(f"{path}: payload at {offset} does not have its digest")
    number = lambda name: int(f[name]) if name in f else None
    return (path, offset, length, f["WARC-Record-ID"].strip("<>"), f["WARC-Type"], f.get("WARC-Target-URI"), number("X-Page-Id"), digest, None if revisit else len(record.payload), f["WARC-Refers-To"].strip("<>") if revisit else None, number("X-Refers-To-Page-Id"))


def read_archives(paths: DataFrame) -> DataFrame:
    """Headers of all records of the archives (column path), digests checked against payloads; written already."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in HEADERS.split(", ")]
        for b in batches:
            for path in b["path"]:
                system, own = _system(path)
                rows = []
                for offset, length, data in _members(system, own):
                    rows.append(_header(path, offset, length, _parsed(data)))
                    if len(rows) == 10_000:
                        yield _framed(rows, names)
                        rows = []
                yield _framed(rows, names)

    files = written(paths.select("path").distinct(), "warc-files")
    n = files.count()
    tasks = max(1, min(n, max(_partitions(files), -(-n // FILES_IN_TASK))))
    return written(files.repartitionByRange(tasks, "path").mapInPandas(read, HEADERS), "warc-headers")  # a row per archive


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _framed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {x: () for x in names}
    return pd.DataFrame({k: pd.array(v, dtype="Int64") if k in ("page_id", "payload_bytes", "refers_to") else pd.Series(v, dtype=None if rows and k in ("offset", "length") else object) for k, v in columns.items()})


def deduplicate(headers: DataFrame, folder: str, least: int = LEAST, date: str | None = None) -> DataFrame:
    """Write the archives anew, each repeated payload of ``least`` bytes or more once; the new places, written already."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    place = F.struct("page_id", "path", "offset", "record_id", "uri")
    originals = headers.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max(place).alias("o"), F.count("*").alias("n")).where("n > 1")
    originals = written(originals.select("payload_digest", F.struct("o.*").alias("o")), "warc-originals")
    joined = headers.join(originals, "payload_digest", "left")
    revisit = F.col("o").isNotNull() & (F.col("payload_bytes") >= least) & ~((F.col("o.path") == F.col("path")) & (F.col("o.offset") == F.col("offset")))
    fate = joined.select("path", "offset", "length", revisit.alias("revisit"), F.col("o.record_id").alias("to_id"), F.col("o.uri").alias("to_uri"), F.coalesce("o.page_id", F.lit(0)).alias("to_page"), F.col("o.page_id").isNotNull().alias("to_known"))
    fate = written(fate, "warc-fates")

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, opened, source = _Writer(folder), None, None
        for b in batches:
            places = []
            for row in b.itertuples(index=False):
                if row.path != opened:
                    if source is not None:
                        source.close()
                    system, own = _system(row.path)
                    opened, source = row.path, system.open_input_file(own)
                record = _parsed(gzip.decompress(source.read_at(row.length, row.offset)))
                path, offset = out.name()
                fields = record.fields | {"WARC-Record-ID": f"<{_fresh(record.fields['WARC-Record-ID'].strip('<>'))}>", "WARC-Date": date}
                del fields["Content-Type"], fields["Content-Length"]
                if row.revisit:
                    fields |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": f"<{_fresh(row.to_id)}>", "WARC-Refers-To-Target-URI": row.to_uri, "X-Refers-To-Page-Id": str(row.to_page) if row.to_known else None}
                places.append((path, offset, out.add(_member(fields, b"" if row.revisit else record.payload))))
            yield pd.DataFrame(places, columns=["path", "offset", "length"])
        out.close()
        if source is not None:
            source.close()

    held = headers.agg(F.sum("length")).first()[0] or 0
    parts = max(_partitions(headers), -(-held // (FILES_IN_TASK * ARCHIVE_BYTES)))
    dealt = fate.repartition(parts, "path", F.floor(F.col("offset") / PIECE_BYTES)).sortWithinPartitions("path", "offset")  # pieces of bounded size
    return written(dealt.mapInPandas(rewrite, PLACES), "warc-new-places")


def _fresh(record_id: str) -> str:
    """The record's id in the new archives."""
    return uuid.uuid5(uuid.NAMESPACE_URL, record_id).urn


def resolved(headers: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits joined to their responses."""
    responses = headers.where("record_type = 'response'")
    originals = responses.select(F.col("record_id").alias("refers_to_id"), F.col("payload_bytes").alias("full"))
    revisits = headers.where("record_type <> 'response'").join(originals, "refers_to_id", "left")  # one original may have a third of all rows: AQE splits it
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).unionByName(revisits.withColumn("payload_bytes", F.col("full")).select(*columns))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    raw = read_archives(write_archives(pages, new_path(spark, "warc")))
    return resolved(read_archives(deduplicate(raw, new_path(spark, "warc-dedup"))))


_SQL = """
    WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    d AS (SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS n, max(page_id) OVER (PARTITION BY payload_digest) AS o FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN o END AS refers_to FROM r"""

QUERIES = {"op2_warc": op2_warc}
ORACLES = {"op2_warc": _SQL}
