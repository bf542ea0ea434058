"""WARC archives of pages: monolithic gzip files, their normaliser, and reading by a sidecar index.

write() deals pages out to archives, each one gzip stream as a crawler would pipe it. normalise() inflates each such stream
once, from end to end and a piece at a time, and writes every record as a gzip member of its own, with a sidecar `.cdxj` beside the
archive: a JSON line a record with its offset, length, type, id and digest. read() opens archives at those offsets alone, so that ranges of one
archive are many tasks.

Of records with equal payloads of at least `least` bytes the row with the largest page_id is a response, the others are
revisits that name its record and keep the HTTP headers only. Equal means equal SHA-256; archives carry bare SHA-1.

Files are written under a name of their own for each attempt of a task, and only those that a successful attempt reports
are read, so a lost executor costs its tasks alone. Memory is bounded by a piece of a stream and, in write(), by a batch of pages.

Cases: null html is an empty payload; null url gives a record without target; null page_id comes after all numbers and is null again when
read; rows that repeat page_id and html are records of their own, and the first of them is the response; an empty table gives no archive and no row; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
import zlib
from typing import NamedTuple

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, small_batches, small_side, table

#: Bytes of a stream that are held at a time.
PIECE = 1 << 20
SIDECAR = "filename string, offset long, length long, type string, id string, digest string"
CRLF = b"\r\n"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI, and its path there."""
    return pafs.FileSystem.from_uri(uri)


# --- records -----------------------------------------------------------------------------------------------------------
def header(fields: list[tuple[str, str]]) -> bytes:
    return CRLF.join([b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields), b"", b""])


def one_line(text: str) -> str:
    """text for a header: what would end or blur a line (control characters, white space, %) and all beyond ASCII is percent-encoded."""
    return "".join(chr(b) if 0x20 < b < 0x7F and b != 0x25 else f"%{b:02X}" for b in text.encode("utf-8", "surrogatepass"))


def record_id(page_id, row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{row}'.encode()).hexdigest())}>"


def page_record(page_id, row: int, url: str | None, payload: bytes, digest: str, first, date: str) -> tuple[bytes, bytes]:
    """(header and HTTP headers, what follows them): a response, or a revisit of first (page_id, row)."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    body = payload if first is None else b""
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page_id, row)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", one_line(url)))
    fields.append(("WARC-Payload-Digest", digest))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if first is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(*first))]
        if first[0] is not None:
            fields.append(("X-Refers-To-Page-Id", str(first[0])))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(body)))]
    return header(fields) + http, body + CRLF + CRLF


def info_record(date: str) -> bytes:
    body = b"software: scanlake\r\nformat: WARC File Format 1.1\r\n"
    return header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", 0)), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]) + body + CRLF + CRLF


def parsed(head: bytes) -> dict[str, str]:
    """Fields of a header, by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Stream:
    """Bytes of a gzip file of any number of members, inflated once and a piece at a time."""

    def __init__(self, file, size: int = PIECE):
        self.file, self.size, self.held, self.inflate, self.more = file, size, bytearray(), zlib.decompressobj(31), b""

    def fill(self) -> bool:
        """Whether more came."""
        while True:
            if self.inflate.eof:  # another member may follow
                self.more, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            raw = self.inflate.unconsumed_tail or self.more or self.file.read(self.size)
            self.more = b""
            if not raw:
                return False
            out = self.inflate.decompress(raw, self.size)
            if out:
                self.held += out
                return True

    def head(self) -> bytes | None:
        """The bytes up to an empty line, which goes too; None at the end."""
        seen = 0
        while (at := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.held)
            if not self.fill():
                if self.held.strip():
                    raise ValueError("the archive ends within a header")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + 4]
        return out

    def pieces(self, n: int):
        """The next n bytes, a piece at a time."""
        while n:
            if not self.held and not self.fill():
                raise ValueError("the archive ends within a record")
            out = bytes(self.held[:n])
            del self.held[: len(out)]
            n -= len(out)
            yield out


class Normal(NamedTuple):
    offset: int
    length: int
    fields: dict[str, str]


def members(stream: Stream, put, level: int):
    """Writes every record of stream by put() as a gzip member of its own; yields where each went."""
    at = 0
    while (head := stream.head()) is not None:
        fields = parsed(head)
        deflate, began = zlib.compressobj(level, zlib.DEFLATED, 31), at

        def send(x: bytes) -> None:
            nonlocal at
            if x:
                put(x)
                at += len(x)

        send(deflate.compress(head + CRLF + CRLF))
        for piece in stream.pieces(int(fields["content-length"]) + 4):
            send(deflate.compress(piece))
        send(deflate.flush())
        yield Normal(began, at - began, fields)


# --- the operators -------------------------------------------------------------------------------------------------------
def revisited(rows: DataFrame, least: int) -> DataFrame:
    """(_hash, _first: page_id and row of the response): payloads of at least `least` bytes that several rows have."""
    big = rows.where(F.octet_length("html") >= least)
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("some"), "page_id", (-F.col("_row")).alias("row")))
    g = big.groupBy(F.sha2("html", 256).alias("_hash")).agg(F.count(F.lit(1)).alias("n"), best.alias("b")).where("n > 1")
    return materialize(g.select("_hash", "n", F.col("b.page_id").alias("_first"), (-F.col("b.row")).alias("_first_row")), "warc-revisited")


def with_first(rows: DataFrame, groups: DataFrame, hot: int = 1 << 12) -> DataFrame:
    """rows with the response of their payload. Where groups are too many to be broadcast, those of over `hot` rows still are,
    of which there are few, and only the others' rows are shuffled."""
    rows = rows.withColumn("_hash", F.sha2("html", 256))
    given = groups.drop("n")
    side = small_side(given)
    if side is not given:
        return rows.join(side, "_hash", "left")
    many = materialize(groups.where(F.col("n") > hot).drop("n"), "warc-hot").withColumnsRenamed({"_first": "_f", "_first_row": "_r"})
    rows = rows.join(small_side(many), "_hash", "left")
    # rows of hot payloads get keys of their own, and find nothing
    rows = rows.withColumn("_key", F.when(F.col("_r").isNull(), F.col("_hash")).otherwise(F.col("_row").cast("string")))
    rare = groups.where(F.col("n") <= hot).select(F.col("_hash").alias("_key"), "_first", "_first_row")
    rows = rows.join(rare, "_key", "left")
    return rows.withColumn("_first", F.when(F.col("_r").isNull(), F.col("_first")).otherwise(F.col("_f"))).withColumn("_first_row", F.coalesce("_r", "_first_row"))


def write(pages: DataFrame, folder: str, least: int = 1000, archive_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """(archive, records, bytes) of the monolithic archives that pages (page_id, url, html; read twice, in the same order) were written to, in folder,
    a URI that all executors reach. An archive holds about archive_bytes of records."""
    small_batches(pages.sparkSession, 256)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_row", F.monotonically_increasing_id())
    rows = with_first(rows, revisited(rows, least)).select("page_id", "_row", "url", F.encode("html", "utf-8").alias("payload"), F.sha1("html").alias("digest"), "_first", "_first_row")

    def archives(batches):
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        file = None

        def done():
            file.write(deflate.flush())
            file.close()
            return pd.DataFrame({"archive": [name], "records": [records], "bytes": [size]})

        for b in batches:
            for page_id, row, url, payload, digest, first, first_row in zip(*(b[c].tolist() for c in ("page_id", "_row", "url", "payload", "digest", "_first", "_first_row"))):
                if file is not None and size >= archive_bytes:
                    yield done()
                    file = None
                if file is None:
                    name = f"whole-{uuid.uuid4().hex}.warc.gz"
                    file, deflate = store.open_output_stream(posixpath.join(base, name), compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                    file.write(deflate.compress(info_record(date)))
                    records = size = 0
                number = lambda x: None if pd.isna(x) else int(x)
                page_id, first_row = number(page_id), number(first_row)
                first = None if first_row is None or first_row == row else (number(first), first_row)
                for x in page_record(page_id, row, url, payload, digest, first, date):
                    file.write(deflate.compress(x))
                    size += len(x)
                records += 1
        if file is not None:
            yield done()

    # numbers that may be null reach pandas as text: floats do not hold all of them
    sent = rows.select(*[F.col(c).cast("string").alias(c) if c in ("page_id", "_first", "_first_row") else F.col(c) for c in rows.columns])
    return materialize(sent.mapInPandas(archives, "archive string, records long, bytes long"), "warc-whole")


def normalise(whole: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """(archive, sidecar, records) of the archives written for those of whole (archive, ..), each a task: a gzip stream has no other beginning."""

    def rewrite(batches):
        store, base = opened(folder)
        for b in batches:
            for name in b["archive"]:
                out = f"records-{uuid.uuid4().hex}.warc.gz"
                records = 0
                with store.open_input_stream(posixpath.join(base, name), compression=None) as raw, store.open_output_stream(posixpath.join(base, out), compression=None) as file:
                    with store.open_output_stream(posixpath.join(base, out + ".cdxj"), compression=None) as index:
                        for r in members(Stream(raw), file.write, level):
                            line = {"filename": out, "offset": r.offset, "length": r.length, "type": r.fields["warc-type"], "id": r.fields["warc-record-id"], "digest": r.fields.get("warc-payload-digest")}
                            index.write(json.dumps(line).encode() + b"\n")
                            records += 1
                yield pd.DataFrame({"archive": [out], "sidecar": [out + ".cdxj"], "records": [records]})

    n = max(1, whole.count())
    return materialize(whole.select("archive").repartition(n, "archive").mapInPandas(rewrite, "archive string, sidecar string, records long"), "warc-records")


def index(archives: DataFrame, folder: str) -> DataFrame:
    """The lines of the sidecars of archives (archive, sidecar, ..)."""
    spark = archives.sparkSession
    paths = [f"{folder}/{r['sidecar']}" for r in archives.select("sidecar").toLocalIterator()]  # names of files, as a listing has them
    return spark.read.schema(SIDECAR).json(paths) if paths else spark.createDataFrame([], SIDECAR)


def read(entries: DataFrame, folder: str, payloads: bool = False, range_bytes: int = 16 << 20) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id) of the pages' records at entries (of index()), opened at
    their offsets. A response's digest is of the bytes read, and must be the header's. payloads: adds payload (binary, null for revisits)."""
    parts = max(1, -(-(entries.agg(F.sum("length")).first()[0] or 0) // range_bytes), entries.sparkSession.sparkContext.defaultParallelism)
    at = entries.where("type IN ('response', 'revisit')").select("filename", "offset", "length")
    at = at.repartition(parts, "filename", F.floor(F.col("offset") / range_bytes)).sortWithinPartitions("filename", "offset")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"] + ["payload"] * payloads

    def fetch(batches):
        store, base = opened(folder)
        name, file = None, None
        for b in batches:
            rows = []
            for f, offset, length in zip(b["filename"], b["offset"], b["length"]):
                if f != name:
                    if file is not None:
                        file.close()
                    name, file = f, store.open_input_file(posixpath.join(base, f))
                file.seek(int(offset))
                rows.append(page_row(zlib.decompress(file.read(int(length)), 31))[: len(names)])
            whole = {"page_id": "Int64", "refers_to": "Int64"}  # from the start: floats do not hold all numbers
            yield pd.DataFrame({c: pd.array([r[i] for r in rows], whole.get(c, object)) for i, c in enumerate(names)})
        if file is not None:
            file.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string" + ", payload binary" * payloads
    return at.mapInPandas(fetch, schema)


def page_row(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = parsed(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:"))
    digest, kind = fields["warc-payload-digest"], fields["warc-type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    number = lambda x: None if x is None else int(x)
    return number(fields.get("x-page-id")), length, digest, kind, number(fields.get("x-refers-to-page-id")), fields["warc-record-id"], payload if kind == "response" else None


def remove(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def op12_warc(spark, sf_dir):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = normalise(write(table(spark, sf_dir, "pages"), folder), folder)
    found = materialize(read(index(archives, folder), folder), "warc-read")
    remove(spark, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
