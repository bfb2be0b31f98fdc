"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

``write_archives`` puts records into archive files that are one gzip stream each, as careless writers do.  Such a file
can't be read from its middle.  ``normalise`` inflates each file once, as a stream, and writes every record again as a gzip
member of its own, with a sidecar index of member offsets beside it.  ``read_records`` reads the normalised archives
member by member through the index.

Files are written by tasks under a name of the attempt and renamed when complete, and the names of the complete ones are
the jobs' results; what a lost executor leaves half-written is never named.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landspark.llm.common import materialise, shared_dir, small_keys

#: Payloads of fewer bytes are never replaced by a reference to an equal one.
LEAST = 100
#: Repeated digests, of about a hundred bytes a row, that may be broadcast.
REPEATED = 200_000
#: Bytes of records after which a task begins the next archive file.
ROLL = 16 << 20
CRLF = b"\r\n"


def record_types(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Of each page: page_id, _url, _payload, _digest, record_type and refers_to.

    Of equal payloads of at least ``least`` bytes the smallest page_id is a response and the others revisit it; null html
    is empty.  Rows that repeat the smallest page_id are responses all.  Payloads are not shuffled: the repeated digests are
    counted and, as long as they are few, broadcast.  A table may do without the column url.
    """
    base = pages.select("page_id", (F.col("url") if "url" in pages.columns else F.lit(None)).cast("string").alias("_url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("_payload")).withColumn("_digest", F.sha2("_payload", 256))
    first = base.filter(F.octet_length("_payload") >= least).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    first = materialise(first, "repeated-payloads")
    other = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id")) & (F.octet_length("_payload") >= least)
    return base.join(small_keys(first, REPEATED), "_digest", "left").select(
        "page_id", "_url", "_payload", "_digest", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("_first")).alias("refers_to")
    )


def _uri(page, url: str | None) -> bytes:
    """The target URI of a page: its url, with what may not stand in a header or a URI escaped; its id where it has none."""
    return quote(url.strip(), safe="!#$%&'()*+,/:;=?@[]~-._").encode() if url and url.strip() else b"urn:page:%s" % _name(page)


def _name(page) -> bytes:
    return b"" if page is None else str(page).encode()


def _record(page, url: str | None, payload: bytes, digest: str, kind: str, refers, date: str) -> bytes:
    """One WARC/1.1 record.  Its block is an HTTP response; of a revisit, the response's head alone, as the profile says."""
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%s>" % _name(page), b"WARC-Date: " + date.encode(), b"WARC-Target-URI: " + _uri(page, url)]
    head += [b"Content-Type: application/http;msgtype=response", b"WARC-Payload-Digest: sha256:" + digest.encode()]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%s>" % _name(refers)]
    else:
        block += payload
    return CRLF.join([*head, b"Content-Length: %d" % len(block), b"", b""]) + block + CRLF + CRLF


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, data: bytes) -> str:
    store, at = _store(uri)
    part = f"{at}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{at}/{name}")
    return name


def write_archives(records: DataFrame, uri: str, roll: int = ROLL, level: int = 3, date: str | None = None) -> DataFrame:
    """Write the rows of ``record_types`` as monolithic ``.warc.gz`` files under ``uri``; a table of their names (file, n_records).

    ``date``: the records' WARC-Date, in UTC (the time of the call, if none is given).
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts, n, press):
            name = _put(uri, f"{uuid.uuid4().hex}.warc.gz", b"".join(parts) + press.flush())
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([n], pa.int64())})

        parts, n, size, press = [], 0, 0, zlib.compressobj(level, zlib.DEFLATED, 31)
        for b in batches:
            for i in range(b.num_rows):
                row = [b.column(k)[i].as_py() for k in range(6)]
                record = _record(*row, date)
                parts.append(press.compress(record))
                n, size = n + 1, size + len(record)
                if size >= roll:
                    yield done(parts, n, press)
                    parts, n, size, press = [], 0, 0, zlib.compressobj(level, zlib.DEFLATED, 31)
        if n:
            yield done(parts, n, press)

    store, at = _store(uri)
    store.create_dir(at, recursive=True)
    return materialise(records.select("page_id", "_url", "_payload", "_digest", "record_type", "refers_to").mapInArrow(write, "file string, n_records long"), "warc-files")


class Inflated:
    """The records of one gzip stream, cut by their Content-Length as the inflated bytes arrive."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.flow = pieces, bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        for piece in self.pieces:
            while piece:
                self.held += self.flow.decompress(piece)
                piece = self.flow.unused_data
                if self.flow.eof:  # several members are read as one stream
                    self.flow = zlib.decompressobj(31)
            return True
        return False

    def __iter__(self) -> Iterator[bytes]:
        while True:
            while (head := self.held.find(CRLF + CRLF)) < 0:
                if not self.more():
                    if self.held.strip():
                        raise ValueError("the archive ends inside a record's header")
                    return
            fields = headers(bytes(self.held[:head]))
            end = head + 4 + int(fields["content-length"]) + 4
            while len(self.held) < end:
                if not self.more():
                    raise ValueError("the archive ends inside a record")
            yield bytes(self.held[:end])
            del self.held[:end]


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    return {"version": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def normalise(files: DataFrame, source: str, target: str, level: int = 3, piece: int = 1 << 18) -> DataFrame:
    """Rewrite each archive named in ``files`` with a gzip member for each record and a sidecar ``.idx``; a table (file, n_records).

    An archive that isn't a whole gzip stream of WARC records fails the job; nothing is skipped.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(source)
        for b in batches:
            for name in b.column(0).to_pylist():
                out, index, place = [], [], 0
                with store.open_input_stream(f"{at}/{name}", compression=None) as flow:
                    for record in Inflated(iter(lambda: flow.read(piece), b"")):
                        press = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = press.compress(record) + press.flush()
                        fields = headers(record[: record.index(CRLF + CRLF)])
                        index.append(json.dumps({"id": fields["warc-record-id"], "type": fields["warc-type"], "offset": place, "length": len(member)}))
                        out.append(member)
                        place += len(member)
                _put(target, name, b"".join(out))
                _put(target, f"{name}.idx", "".join(x + "\n" for x in index).encode())
                yield pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([len(index)], pa.int64())})

    store, at = _store(target)
    store.create_dir(at, recursive=True)
    return materialise(_spread(files).mapInArrow(rewrite, "file string, n_records long"), "warc-normal")


def _spread(files: DataFrame) -> DataFrame:
    """File names over as many tasks as there are files, within reason: a task's work is a file, not a row's bytes."""
    return files.select("file").repartition(max(1, min(files.count(), 20_000)), "file")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(files: DataFrame, uri: str, with_payload: bool = True) -> DataFrame:
    """The records of normalised archives, each from its own member by the index: ``RECORDS``.

    Length and digest of a response are measured on what was read; a revisit's are those that its headers say.
    """

    def page(mark: str) -> int | None:
        text = mark.removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(uri)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{at}/{name}.idx", compression=None) as flow:
                    index = [json.loads(x) for x in flow.read().splitlines()]
                rows = []
                with store.open_input_file(f"{at}/{name}") as flow:
                    for x in index:
                        flow.seek(x["offset"])
                        record = zlib.decompress(flow.read(x["length"]), 31)
                        cut = record.index(CRLF + CRLF)
                        fields, block = headers(record[:cut]), record[cut + 4 : -4]
                        cut = block.index(CRLF + CRLF)
                        response, payload = headers(block[:cut]), block[cut + 4 :]
                        of = page(fields["warc-record-id"]), fields["warc-target-uri"]
                        if fields["warc-type"] == "revisit":
                            rows.append((*of, int(response["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:"), "revisit", page(fields["warc-refers-to"]), None))
                        else:
                            rows.append((*of, len(payload), hashlib.sha256(payload).hexdigest(), "response", None, payload if with_payload else None))
                        if len(rows) >= 512:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return _spread(files).mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages to archives, normalised and read back, in folders of their own in the shared folder; a row for each page.

    Null html is an empty payload, a null url gives way to the page's id; null and repeated ids are records of their own.
    """
    top = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    top = top if "://" in top else f"file://{top}"
    written = write_archives(record_types(pages), f"{top}/monolithic")
    normal = normalise(written, f"{top}/monolithic", f"{top}/normal")
    return read_records(normal, f"{top}/normal", with_payload=False)
