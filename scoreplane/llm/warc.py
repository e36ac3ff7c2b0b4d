"""WARC records as a chunked record table.

An archive is a table of chunk rows: record id, chunk number, the bytes, and
after each chunk the payload bytes and SHA-1 so far. The chunks of a record
in order are one WARC 1.1 record: header block, HTTP header and payload, end
mark. Rows of one record lie together in their file, so a file's bytes one
after another are a WARC file. Payloads are cut in the JVM into pieces of
``CHUNK`` bytes; no Python process holds more than a batch of pieces.

Writing: the pages are written once with their record ids, which the input's
file splits decide. The digests of all payloads (streamed over the chunks) decide which
record is the response of its payload and which ones revisit it, and the
decision is joined back to the pages by row. Reading: every task streams its
chunks through a parser that checks numbers, lengths, and the running and
final digests. A record that the split of a file cuts in two is passed on as
its chunks, and only those are shuffled by record.

Defined results: a null payload is empty, a null url becomes urn:none and
control characters in a url become %20; payloads of fewer than ``min_bytes``
bytes are responses; of equal payloads the smallest page_id is the response
(a null page_id after all others), of repeated rows with one page_id the
first; an empty table gives an empty archive; extra columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreplane.llm.common import numbered, written
from scoreplane.session import scratch_path

CHUNK = 16 << 10
DATE = "2026-01-01T00:00:00Z"
END = b"\r\n\r\n"
ARCHIVE = "record_id long, chunk_no int, data binary, payload_bytes long, payload_sha1 binary, last boolean"
RECORD = ("record_id long, page_id string, url string, record_type string, payload_bytes long, payload_digest string, "
          "refers_to string, fault string")


def _payloads(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("urn:none")), r"[\x00-\x20]", "%20")
    return numbered(pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"),
                                 F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")),
                    "warc-pages", "record_id")


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """A row per piece of payload; an empty payload has one empty piece."""
    pieces = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk)).cast("int")
    rows = rows.withColumn("pieces", pieces).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return rows.withColumns({"data": F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)),
                             "last": F.col("chunk_no") + 1 == F.col("pieces")}).drop("payload", "pieces")


def digests(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(record_id, page_id, payload_bytes, sha1) of every payload, streamed over its chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = hashlib.sha1(), 0
        for b in batches:
            out: dict[str, list] = {"record_id": [], "page_id": [], "payload_bytes": [], "sha1": []}
            for rec, page, data, last in zip(b.column("record_id"), b.column("page_id"), b.column("data"), b.column("last")):
                data = data.as_buffer()
                h.update(data)
                n += data.size
                if last.as_py():
                    for k, v in zip(out, (rec.as_py(), page.as_py(), n, h.digest())):
                        out[k].append(v)
                    h, n = hashlib.sha1(), 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[k], t) for k, t in (("record_id", pa.int64()), ("page_id", pa.int64()),
                                                  ("payload_bytes", pa.int64()), ("sha1", pa.binary()))], list(out))

    chunks = _chunks(rows, chunk).select("record_id", "page_id", "data", "last")
    return chunks.mapInArrow(run, "record_id long, page_id long, payload_bytes long, sha1 binary")


def _urn(record: F.Column) -> F.Column:
    return F.concat(F.lit("<urn:x-record:"), record.cast("string"), F.lit(">"))


def _headers(decided: DataFrame) -> DataFrame:
    """decided with ``head``: header block and HTTP header of its record."""
    crlf = F.lit("\r\n")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("full_bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("full_bytes"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, crlf)
    optional = lambda name, value: F.coalesce(line(name, value.cast("string")), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _urn(F.col("record_id"))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", F.col("url")), optional("X-Page-ID", F.col("page_id")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("full_bytes").cast("string")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _urn(F.col("first_record"))), optional("X-Refers-To-Page", F.col("first_page"))))
        .otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", length.cast("string")), crlf, http)
    return decided.withColumn("head", head.cast("binary"))


def _base32(sha1: F.Column) -> F.Column:
    """Twenty bytes in base 32: eight groups of twenty bits, four letters each."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = []
    for g in range(8):
        five = F.conv(F.substring(F.hex(sha1), 5 * g + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            digits.append(F.substring(F.lit(alphabet), F.shiftright(five, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*digits)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = 0, chunk: int = CHUNK) -> None:
    """Write a WARC record per row of pages below path."""
    rows = _payloads(pages, id_col, url_col, payload_col)
    found = written(digests(rows, chunk), "warc-digests")
    first = found.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(
        F.min(F.struct(F.col("page_id").isNull(), "page_id", "record_id")).alias("w")).select(
        F.col("sha1"), F.col("w.page_id").alias("first_page"), F.col("w.record_id").alias("first_record"))
    decided = found.join(written(first, "warc-first"), "sha1", "left")
    decided = decided.withColumns({
        "record_type": F.when(F.col("first_record") != F.col("record_id"), "revisit").otherwise("response"),
        "digest": _base32(F.col("sha1")), "full_bytes": F.col("payload_bytes")})
    decided = decided.select("record_id", "record_type", "digest", "full_bytes", "first_page", "first_record")
    joined = rows.join(decided, "record_id")
    joined = joined.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")))
    pieces = _headers(_chunks(joined, chunk)).select(
        "record_id", "chunk_no", F.when(F.col("chunk_no") == 0, F.col("head")).otherwise(F.lit(b"")).alias("head"), "data", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = hashlib.sha1(), 0
        for b in batches:
            data, counts, sums = [], [], []
            for no, head, piece, last in zip(b.column("chunk_no"), b.column("head"), b.column("data"), b.column("last")):
                if no.as_py() == 0:
                    h, n = hashlib.sha1(), 0
                piece = piece.as_py()
                h.update(piece)
                n += len(piece)
                data.append(head.as_py() + piece + (END if last.as_py() else b""))
                counts.append(n)
                sums.append(h.digest())
            yield pa.RecordBatch.from_arrays(
                [b.column("record_id"), b.column("chunk_no"), pa.array(data, pa.binary()), pa.array(counts, pa.int64()),
                 pa.array(sums, pa.binary()), b.column("last")],
                ["record_id", "chunk_no", "data", "payload_bytes", "payload_sha1", "last"])

    pieces.mapInArrow(run, ARCHIVE).write.option("compression", "zstd").parquet(path)


class Parser:
    """Streams the chunks of records; holds headers and a running digest only."""

    def __init__(self) -> None:
        self.record = None
        self.next = 0

    def feed(self, record: int, no: int, data: bytes, so_far: int, sha1: bytes, last: bool):
        """None: more to come; False: the chunk does not follow; a tuple: the record read."""
        if no == 0:
            self.record, self.next, self.fault = record, 0, ""
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            http, _, data = rest.partition(b"\r\n\r\n")
            self.left = int(self.fields["Content-Length"]) - len(http) - 4
            self.n, self.sum = 0, hashlib.sha1()
            if lines[0] != "WARC/1.1":
                self.fault = "version"
        elif record != self.record or no != self.next:
            return False
        self.next = no + 1
        if last:
            if not data.endswith(END):
                self.fault = self.fault or "end"
            data = data[:-len(END)]
        self.sum.update(data)
        self.n += len(data)
        if self.n != so_far or self.sum.digest() != sha1:
            self.fault = self.fault or f"chunk {no}"
        if not last:
            return None
        f, revisit = self.fields, self.fields["WARC-Type"] == "revisit"
        if self.n != self.left:
            self.fault = self.fault or "length"
        digest = f["WARC-Payload-Digest"].partition(":")[2]
        own = base64.b32encode(self.sum.digest()).decode()
        if not revisit and (own != digest or self.n != int(f["X-Payload-Length"])):
            self.fault = self.fault or "digest"
        self.record = None
        return (record, f.get("X-Page-ID"), f["WARC-Target-URI"], f["WARC-Type"],
                int(f["X-Payload-Length"]) if revisit else self.n, digest if revisit else own, f.get("X-Refers-To-Page"), self.fault)


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
_NAMES = [x.split(" ")[0] for x in RECORD.split(", ")]
_COLS = [x.split(" ")[0] for x in ARCHIVE.split(", ")]
_KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.bool_()]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records read whole, and the chunks of those that began or ended in another task."""
    parser, held = Parser(), []

    def out(done, loose):
        rows = [(*r, *[None] * len(_COLS)) for r in done] + [(*[None] * len(_NAMES), *c) for c in loose]
        cols = list(zip(*rows)) if rows else [[]] * (len(_NAMES) + len(_COLS))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES + _KINDS)],
                                          _NAMES + [f"c_{c}" for c in _COLS])

    for b in batches:
        done, loose = [], []
        for i in range(b.num_rows):
            row = tuple(b.column(c)[i].as_py() for c in range(len(_COLS)))
            if row[1] == 0 and held:  # the record before it was cut
                loose += held
                held = []
            got = parser.feed(*row)
            if got is False:
                loose += [*held, row]
                held = []
            elif got is None:
                held.append(row)
                if len(held) > 64:  # so long a record is handed on, not held
                    loose += held
                    held, parser.record = [], None
            else:
                done.append(got)
                held = []
        yield out(done, loose)
    if held:
        yield out([], held)


def read_archive(archive: DataFrame) -> DataFrame:
    """A row per record of an archive table: RECORD; ``fault`` is empty if all checks held.

    A record of which a chunk is missing, the last one too, is a row of its id
    and the fault alone.
    """
    schema = RECORD + ", " + ", ".join(f"c_{x}" for x in ARCHIVE.split(", "))
    read = written(archive.select(*_COLS).mapInArrow(_parse, schema), "warc-read")
    whole_ = read.where("record_id IS NOT NULL").select(*_NAMES)
    loose = read.where("record_id IS NULL").select(*[F.col(f"c_{c}").alias(c) for c in _COLS])
    n = int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, record, whole_so_far, finished = Parser(), None, True, True

        def table(done):
            cols = list(zip(*done)) if done else [[]] * len(_NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _NAMES)

        def lost():
            return (record, None, None, None, None, None, None, "chunk missing")

        for b in batches:
            done = []
            for i in range(b.num_rows):
                row = tuple(b.column(c)[i].as_py() for c in range(len(_COLS)))
                if row[0] != record:
                    if not finished:
                        done.append(lost())
                    record, whole_so_far, finished = row[0], True, False
                got = parser.feed(*row) if whole_so_far and not finished else None
                if got is False:
                    whole_so_far = False
                elif got is not None:
                    done.append(got)
                    finished = True
            yield table(done)
        if not finished:
            yield table([lost()])

    joined = loose.repartition(n, "record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(rest, RECORD)
    return whole_.unionByName(joined).withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archive_and_read(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    path = scratch_path(spark, "warc-archive")
    write_archive(pages, path, min_bytes=min_bytes)
    return read_archive(spark.read.schema(ARCHIVE).parquet(path))
