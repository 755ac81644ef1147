"""WARC writing, the monolithic gzip normaliser, and reading by index (operator 8).

A crawl dump often arrives as one gzip stream a file, which can't be entered in the middle.  The
normaliser inflates such a stream once, rewrites every record as a gzip member of its own, and writes a
sidecar index of offsets, after which any record is read by one seek.

Archives go to the folder all executors share.  Names are unique to each attempt and the next step reads
only what the committed manifest lists, so a task that is lost and run again does no harm.

Defined results: a null html is an empty payload; null ids are written without an id and come back null;
of equal payloads of at least ``min_revisit`` bytes the smallest id is the response (repeated rows of that
id are responses too; where no copy has an id all are); an empty table gives an empty table; payloads of
any length are streamed whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark

#: Raw bytes after which a task begins its next archive, and rows up to which repeated digests are broadcast.
ARCHIVE_BYTES, BROADCAST_ROWS, INFLATED = 48 << 20, 100_000, 1 << 20
_END = b"\r\n\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = "page_id {id}, payload_bytes long, payload_digest string, record_type string, refers_to {id}"


def _clean(value: object) -> str:
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in str(value))


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit (``refers_to`` given) has no payload."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url or 'urn:unknown')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Bytes: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {_written(page_id)}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, f'{refers_to} {digest}')}>", f"X-Refers-To-Page-ID: {_written(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _END + block + _END


def _written(value: object) -> str:
    """An id as a header's value: everything but letters, digits and -_.~ as %XX, so that spaces and line ends survive."""
    return quote(str(value), safe="")


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or many members."""
    own = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            if own.eof:
                own = zlib.decompressobj(31)
            # a bound on what comes out at once: a megabyte may hold a gigabyte
            out = own.decompress(chunk, INFLATED)
            if out:
                yield out
            chunk = own.unused_data if own.eof else own.unconsumed_tail
    if not own.eof:
        raise ValueError("the gzip stream ends early")


def split_records(stream: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records, cut by their own Content-Length."""
    have, it, ended = bytearray(), iter(stream), False
    while True:
        while (at := have.find(_END)) < 0 and not ended:
            more = next(it, None)
            ended = more is None
            have += more or b""
        if at < 0:
            if have.strip():
                raise ValueError("bytes after the last record")
            return
        size = at + 4 + int(headers(bytes(have[:at]))["content-length"]) + 4
        parts, n = [], len(have)
        while n < size:
            more = next(it, None)
            if more is None:
                raise ValueError("a record ends early")
            parts.append(more)
            n += len(more)
        have += b"".join(parts)
        yield bytes(have[:size])
        del have[:size]


def _blocks(f, size: int = 1 << 20) -> Iterator[bytes]:
    while block := f.read(size):
        yield block


def normalise(source: str, target: str, level: int = 6) -> int:
    """Rewrites a monolithic archive record by record, with ``target + '.idx'`` beside it; returns the records."""
    fs, path = pafs.FileSystem.from_uri(source)
    _, out_path = pafs.FileSystem.from_uri(target)
    at, index = 0, []
    with fs.open_input_stream(path, compression=None) as f, fs.open_output_stream(out_path, compression=None) as out:
        for one in split_records(inflated(_blocks(f))):
            own = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = own.compress(one) + own.flush()
            out.write(member)
            index.append(f"{at} {len(member)}\n")
            at += len(member)
    with fs.open_output_stream(out_path + ".idx", compression=None) as out:
        out.write("".join(index).encode())
    return len(index)


def read_record(f, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at an index entry."""
    f.seek(offset)
    one = zlib.decompress(f.read(length), 31)
    at = one.index(_END)
    head = headers(one[:at])
    return head, one[at + 4 : at + 4 + int(head["content-length"])]


def payload(block: bytes) -> bytes:
    return block[block.index(_END) + 4 :]


def read_archive(archive: str) -> Iterator[tuple]:
    """Rows of an archive by way of its index; every payload is held against its digest."""
    fs, path = pafs.FileSystem.from_uri(archive)
    with fs.open_input_stream(path + ".idx", compression=None) as f:
        index = [tuple(map(int, line.split())) for line in f.read().decode().splitlines()]
    with fs.open_input_file(path) as f:
        for offset, length in index:
            head, block = read_record(f, offset, length)
            digest, kind = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
            size = int(head["x-payload-bytes"])
            if kind == "response":
                body = payload(block)
                if len(body) != size or hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError(f"{archive} at {offset}: the payload doesn't have its digest")
            page, refers = (head.get(k) for k in ("x-page-id", "x-refers-to-page-id"))
            yield page if page is None else unquote(page), size, digest, kind, refers if refers is None else unquote(refers)


def decided(pages: DataFrame, min_revisit: int = 100, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Pages with digest and, for revisits, the id of the response.  Payloads move only if repeats are many."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    same = (
        base.filter(F.col("size") >= min_revisit)
        .groupBy(F.col("digest").alias("d"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null")
        .drop("n")
    )
    same = _spark.stored(same, "repeats")
    if same.count() <= BROADCAST_ROWS:
        same = F.broadcast(same)
    joined = base.join(same, F.col("digest") == F.col("d"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """Writes :func:`decided` rows as whole-file gzip streams; one row an archive."""

    def run(parts):
        fs = path = out = gz = None
        raw = count = 0

        def close():
            out.write(gz.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{path.rsplit('/', 1)[1]}"], "records": [count]})

        for part in parts:
            columns = [part.column(k) for k in range(5)]
            for k in range(part.num_rows):
                page_id, url, html, digest, refers = (c[k].as_py() for c in columns)
                if out is None:
                    fs, base = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, gz, raw, count = fs.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                one = record(page_id, url, html.encode(), digest, refers)
                out.write(gz.compress(one))
                raw, count = raw + len(one), count + 1
                if raw >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return rows.select("page_id", "url", "html", "digest", "refers_to").transform(_spark.in_arrow, run, "archive string, records long")


def normalise_all(manifest: DataFrame, folder: str) -> DataFrame:
    """Normalises every archive of a manifest; one row an archive."""

    def run(parts):
        for part in parts:
            for archive in part.column(0).to_pylist():
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                fs, base = pafs.FileSystem.from_uri(folder)
                fs.create_dir(base, recursive=True)
                n = normalise(archive, target)
                yield pa.RecordBatch.from_pydict({"archive": [target], "records": [n]})

    return manifest.select("archive").transform(_spark.in_arrow, run, "archive string, records long")


def read_all(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Every record of the archives of a manifest."""

    def run(parts):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for part in parts:
            for archive in part.column(0).to_pylist():
                rows = list(read_archive(archive))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    flat = manifest.select("archive").transform(_spark.in_arrow, run, _SCHEMA.format(id="string"))
    return flat.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def round_trip(pages: DataFrame, min_revisit: int = 100, files: int | None = None) -> DataFrame:
    """Writes pages as monolithic archives, normalises them, and reads them back by index."""
    spark = pages.sparkSession
    _spark.ship(spark)
    mono, final = _spark.scratch(spark, "warc-mono"), _spark.scratch(spark, "warc")
    width = files or spark.sparkContext.defaultParallelism
    written = _spark.stored(write_monolithic(decided(pages, min_revisit), mono), "warc-written")
    done = _spark.stored(normalise_all(written.repartition(max(width, 1)), final), "warc-done")
    _spark.discard(spark, mono)
    return read_all(done.repartition(max(width, 1)), pages.schema["page_id"].dataType.simpleString())
