"""WARC records in ZIP packages: written once, found by index, read back by range.

A package is a ZIP archive that stores, uncompressed, a member of WARC records (each
its own gzip member) and an index of their ranges.  Reading parses the package's
directories and fetches the ranges that the index names; nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrays import trimmed
from loomgraph.llm import zip_archive
from loomgraph.llm.session import prepare, table_path, with_common, written

#: A package is closed once its records exceed this, and ranges are fetched together up to this.
PACKAGE_BYTES = 64 << 20
FETCH_BYTES = 4 << 20
#: So many repeated digests are broadcast at most (of 28 bytes each and what a hash table adds).
BROADCAST_DIGESTS = 500_000
#: Names of the members, and the profile of revisits.
RECORDS, INDEX = "archive/records.warc.gz", "indexes/records.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path inside."""
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def make_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record that names the full payload's size and digest."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        # a line break in a URL would end its header
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """page, payload size, digest, type, refers_to and payload of a record. ValueError if its digest doesn't fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")

    def page(name: str) -> int | None:
        return int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None

    if fields["WARC-Type"] == "response":
        if len(payload) != size or digest_of(payload) != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not hold its payload")
        return page("WARC-Record-ID"), size, digest, "response", None, payload
    return page("WARC-Record-ID"), size, digest, "revisit", page("WARC-Refers-To"), None


class Package:
    """A ZIP package that is being written to a stream."""

    def __init__(self, folder: str):
        # a name of its own for each attempt: a repeated task never touches another's file
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.zip"
        fs, inner = filesystem(self.path)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        self.stream = fs.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, record: bytes) -> None:
        packed = gzip.compress(record, 1, mtime=0)
        self.index.append(json.dumps({"offset": self.size, "length": len(packed)}))
        self.member.write(packed)
        self.size += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{x}\n" for x in self.index))
        self.zip.close()
        self.stream.close()
        return self.path, len(self.index)


def records_of(path: str, fetch: int = FETCH_BYTES) -> Iterator[bytes]:
    """The records of a package, by the ranges of its index; neighbours are fetched together."""
    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as f:

        def read_at(offset: int, length: int) -> bytes:
            f.seek(offset)
            return f.read(length)

        found = {m.name: m for m in zip_archive.members(read_at, f.size())}
        index = found[INDEX]
        start = zip_archive.data_offset(read_at, found[RECORDS])
        lines = read_at(zip_archive.data_offset(read_at, index), index.size).decode().splitlines()
        ranges = [(x["offset"], x["length"]) for x in map(json.loads, lines)]
        i = 0
        while i < len(ranges):
            j = i + 1
            while j < len(ranges) and ranges[j][0] == sum(ranges[j - 1]) and sum(ranges[j]) - ranges[i][0] <= fetch:
                j += 1
            data = read_at(start + ranges[i][0], sum(ranges[j - 1]) - ranges[i][0])
            for offset, length in ranges[i:j]:
                at = offset - ranges[i][0]
                yield zlib.decompress(data[at : at + length], 31)
            i = j


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes a record per row into packages under folder; (path, n_records) of each.

    Of equal payloads of at least least bytes the smallest id is the response and the
    others revisit it. Rows that repeat that smallest id are responses too, as are
    payloads whose ids are all null; other rows with a null id revisit. A null html
    counts as empty.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    sha = F.sha1(F.col("html").cast("binary"))
    # counts of digests are pre-aggregated; html meets only what its digest's bound allows
    firsts = rows.where(F.octet_length("html") >= least).groupBy(sha.alias("sha")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.where((F.col("n") > 1) & F.col("first").isNotNull()), "warc-repeated")
    told = with_common(rows.withColumn("sha", sha), firsts, "sha", BROADCAST_DIGESTS)
    told = told.select("id", "url", "html", F.when(F.coalesce(F.col("id") != F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        for b in batches:
            closed = []
            for page, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("id", "url", "html", "refers_to")), strict=True):
                package = package or Package(folder)
                package.add(make_record(page, url, html.encode(), refers))
                if package.size >= PACKAGE_BYTES:
                    closed.append(package.close())
                    package = None
            if closed:
                yield pa.RecordBatch.from_pydict({"path": pa.array([x for x, _ in closed], pa.string()), "n_records": pa.array([n for _, n in closed], pa.int64())})
        if package:
            path, n = package.close()
            yield pa.RecordBatch.from_pydict({"path": pa.array([path], pa.string()), "n_records": pa.array([n], pa.int64())})

    return told.mapInArrow(trimmed(run), "path string, n_records long")


def read_packages(packages: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record in (path)."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *[("payload", pa.binary())] * payloads])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                for raw in records_of(path):
                    rows.append(parse_record(raw)[: len(schema)])
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    prepare(packages.sparkSession)
    # a package is a unit of work of bounded size, so each gets a task; a given number keeps small rows apart
    return packages.select("path").repartition(max(1, packages.count())).mapInArrow(trimmed(run), out)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """The record of every page, read back from the packages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    packages = written(write_packages(pages, table_path(spark, "warc")), "warc-packages")
    return read_packages(packages)


SQL = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM payloads
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(sha, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""
