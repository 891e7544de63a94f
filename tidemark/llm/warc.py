"""WARC records in ZIP packages: writing, and range-reading without extraction.

A package holds ``archive/data.warc.gz`` (a gzip member for each record),
``indexes/index.cdxj`` (a line for each record: key, time, JSON with offset and length) and
``datapackage.json``, all stored. The reader takes the central directory, finds the index
and reads records by their ranges.

A page gives one record, its payload the html in UTF-8. Of records with equal payloads of
at least ``REVISIT_FROM`` bytes the one with the largest page_id is a response, the others
are revisits, which carry the digest and the length but no payload. Equal payloads are
found by SHA-1 and length with a maximum per digest, so no group is gathered.

Cases. Null html is an empty payload. Null url is an empty target. A null page_id is a
response if it has no equal with an id, else a revisit; it reads back as null. Of rows with
equal page_id and payload all that have the largest id are responses. An empty table gives
no package and no rows. Extra columns are ignored. Packages past 4 GiB use ZIP64.

A task writes under a name of its own, and its manifest row names that package, so a
repeated task leaves only an unread file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batch, only, slices, utf8
from tidemark.llm.zipranges import ZipRanges
from tidemark.session import materialise, new_dir

REVISIT_FROM = 1000
DATE = "2024-01-01T00:00:00Z"
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes fetched at a time when records lie side by side.
READ = 4 << 20
MANIFEST = "part int, path string, n_records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    own = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{own}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}"]
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of a record's gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    web = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return {"fields": fields, "http": web, "payload": payload}


class PackageWriter:
    """Streams records into one package."""

    def __init__(self, uri: str):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.raw = self.fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.raw, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id, url, payload, sha1, refers_to, revisit) -> None:
        r = record(page_id, url, payload, sha1, refers_to, revisit)
        self.data.write(r)
        entry = {"url": url or "", "digest": f"sha1:{sha1}", "mime": "warc/revisit" if revisit else "text/html", "offset": str(self.at), "length": str(len(r)), "filename": "data.warc.gz"}
        self.lines.append(f"{self._key(url)} {DATE[:19].replace('-', '').replace(':', '').replace('T', '')} {json.dumps(entry)}\n")
        self.at += len(r)

    @staticmethod
    def _key(url: str | None) -> str:
        """Host labels reversed, then the path: the order of CDX indexes."""
        rest = (url or "").partition("://")[2] or (url or "")
        host, slash, path = rest.partition("/")
        return "".join(",".join(reversed(host.lower().split("."))) + ")" + slash + path).replace(" ", "%20").replace("\n", "%0A") or ")"

    def close(self) -> None:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            for line in sorted(self.lines):
                f.write(line.encode())
        self.zip.writestr(zipfile.ZipInfo(PACKAGE), json.dumps({"profile": "data-package", "resources": [{"path": DATA, "bytes": self.at}, {"path": INDEX}]}))
        self.zip.close()
        self.raw.close()


def read_package(uri: str) -> Iterator[dict]:
    """All records of a package, by the ranges of its index, in the order of the data."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        z = ZipRanges(lambda n, at: f.read_at(n, at), f.size())
        entries = []
        for name in z.members:
            if name.startswith("indexes/") and name.endswith(".cdxj"):
                for line in z.read(name, z.members[name].size).decode().splitlines():
                    e = json.loads(line[line.index("{") :])
                    entries.append((f"archive/{e['filename']}", int(e["offset"]), int(e["length"])))
        entries.sort()
        k = 0
        while k < len(entries):
            name, first, _ = entries[k]
            stop = k + 1
            while stop < len(entries) and entries[stop][0] == name and entries[stop][1] + entries[stop][2] - first <= READ:
                stop += 1
            span = z.read(name, entries[stop - 1][1] + entries[stop - 1][2] - first, first)
            for _, at, n in entries[k:stop]:
                yield parse(span[at - first : at - first + n])
            k = stop


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None


def with_revisits(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, html, sha1, refers_to and revisit."""
    rows = only(pages, "page_id", "url", "html").withColumn("sha1", F.sha1(F.coalesce("html", F.lit("")))).withColumn("n", F.coalesce(F.octet_length("html"), F.lit(0)))
    last = rows.where(F.col("n") >= revisit_from).groupBy("sha1", "n").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).select(F.col("sha1").alias("s"), F.col("n").alias("m"), "last")
    joined = rows.join(last, (F.col("sha1") == F.col("s")) & (F.col("n") == F.col("m")), "left")
    revisit = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    return joined.select("page_id", "url", "html", "sha1", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))


def write_packages(pages: DataFrame, out_dir: str | None = None, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Writes a package for each partition; returns the manifest."""
    out_dir = out_dir or new_dir(pages.sparkSession, "packages")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_records", pa.int64())])

    def write(batches):
        part, writer, n = TaskContext.get().partitionId(), None, 0
        uri = f"{out_dir}/part-{part:06d}-{uuid.uuid4().hex[:8]}.wacz"
        for b in slices(batches):
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)
            for row in rows:
                writer = writer or PackageWriter(uri)
                writer.add(*row)
                n += 1
        if writer:
            writer.close()
            yield batch(schema, part=[part], path=[uri], n_records=[n])

    return materialise(arrow_map(with_revisits(pages, revisit_from), write, MANIFEST), "package-manifest")


def read_packages(manifest: DataFrame) -> DataFrame:
    """Every record of the packages: page, target, payload length and digest, type, and what it refers to."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                for r in read_package(uri):
                    fields, kind = r["fields"], r["fields"]["warc-type"]
                    stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    digest = stated if kind == "revisit" else hashlib.sha1(r["payload"]).hexdigest()
                    if digest != stated:
                        raise ValueError(f"payload of {fields['warc-record-id']} in {uri} doesn't match its digest")
                    size = int(r["http"]["content-length"]) if kind == "revisit" else len(r["payload"])
                    rows.append((_page(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, kind, _page(fields.get("warc-refers-to"))))
                    if len(rows) == 5000:
                        yield batch(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))
                        rows = []
                if rows:
                    yield batch(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    spread = manifest.select("path").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2), "path")
    return arrow_map(spread, read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    return read_packages(write_packages(pages))
