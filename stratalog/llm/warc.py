"""WARC archives: writing, normalising monolithic gzip, indexed reading (operator 3).

``write_archives`` makes one gzip stream of many records, as careless tools do.
``normalise`` inflates such a stream once, front to back, writes every record
again as a gzip member of its own and, beside the archive, an offset index with
a line for each record.  ``read_archives`` seeks by that index, so any record
can be had without inflating what is before it.

Files go to a folder that all executors share, through pyarrow's file systems,
under names of their own for each attempt; only names that a finished task has
reported are read on, so retried and speculative tasks leave no half archives.
Streams are worked off in pieces of ``PIECE`` bytes, compressed and inflated,
records one at a time; a stream that is cut, or has lost records, raises.

Which record holds a payload: of equal payloads of at least ``least`` bytes the
one with the greatest page_id is the response, the others revisit it.  The
greatest is found by a pre-aggregated group on digest and length, so a payload
that a third of the pages share costs a row for each task.

Defined results: null html is an empty payload, always a response; null page_id
counts as less than any other; rows with equal payload and the greatest page_id
are all responses; a null url has no target line; an empty table makes no
archives; further columns, whatever their names, are left out.  A record is held
whole, however long.  Payloads are equal if SHA-256 and length are.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PIECE = 1 << 20
GZIP = 31  # zlib's window bits for a gzip wrapper
NEWLINE = b"\r\n"
#: Fixed values of the WARC format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; with ``refers_to`` a revisit, whose block is the HTTP head alone."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{NAME}{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{NAME}{refers_to}>")]
    else:
        block += payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + NEWLINE + b"".join(f"{k}: {v}".encode() + NEWLINE for k, v in fields) + NEWLINE
    return head + block + NEWLINE + NEWLINE


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.split(NEWLINE)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.decode().partition(":") for line in lines[1:] if line)}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) for each record of an uncompressed stream."""
    held = bytearray()
    more = iter(pieces)

    def fill(n: int) -> bool:
        while len(held) < n:
            if (piece := next(more, None)) is None:
                return False
            held.extend(piece)
        return True

    while True:
        at, looked = -1, 0
        while at < 0:
            at = held.find(b"\r\n\r\n", max(0, looked - 3))
            looked = len(held)
            if at < 0 and not fill(looked + 1):
                if held.strip():
                    raise ValueError("the stream ends within a record's head")
                return
        fields = parse_head(bytes(held[:at]))
        end = at + 4 + int(fields["content-length"]) + 4
        if not fill(end):
            raise ValueError("the stream ends within a record")
        yield fields, bytes(held[:end])
        del held[:end]


def inflate(stream) -> Iterator[bytes]:
    """A gzip file's content in pieces of at most ``PIECE`` bytes, whether one member or many.

    A stream that ends within a member raises, also where that is between two
    records: a member's end and checksum must be there.
    """
    engine, begun = zlib.decompressobj(GZIP), False
    while piece := stream.read(PIECE):
        while piece:
            begun = True
            out = engine.decompress(piece, PIECE)
            if out:
                yield out
            piece = engine.unconsumed_tail or engine.unused_data
            while not engine.eof and not piece and len(out) == PIECE:  # what the engine still holds
                if out := engine.decompress(b"", PIECE):
                    yield out
            if engine.eof:
                piece = engine.unused_data or piece
                engine, begun = zlib.decompressobj(GZIP), False
    if begun:
        raise ValueError("the stream ends within a gzip member")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return store, path


def _names(rows: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["archive", "records"])


def decide(pages: DataFrame, least: int = 1000, broadcast_rows: int = 100_000) -> DataFrame:
    """page_id, url, html and refers_to (null: the record is a response).

    Pages stay where they are while the payloads that occur repeatedly are few
    (``broadcast_rows`` digests at most, counted first); beyond that both sides
    are shuffled by digest.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("bigint"), "url", "html", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    copies = keyed.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = common.materialise(copies, "copies")
    copies = F.broadcast(copies) if copies.count() <= broadcast_rows else copies.hint("merge")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return keyed.join(copies, ["digest", "size"], "left").select("page_id", "url", "html", refers_to.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 4, most: int = 1 << 28) -> DataFrame:
    """Writes page_id, url, html, refers_to rows to archives of one gzip stream each; returns archive, records.

    An archive holds at most ``most`` bytes before compression, and one record more.
    """
    common.ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        out = engine = name = None
        size = count = 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, engine, size, count = store.open_output_stream(name, compression=None), zlib.compressobj(level, wbits=GZIP), 0, 0
                data = record(page_id, url.as_py(), (html.as_py() or "").encode(), refers_to, date)
                out.write(engine.compress(data))
                size, count = size + len(data), count + 1
                if size >= most:
                    out.write(engine.flush())
                    out.close()
                    yield _names([(name, count)])
                    out = None
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield _names([(name, count)])

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, records bigint")


def normalise(archives: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Rewrites each archive with one gzip member for each record and an index beside it; returns archive, records.

    An archive must have as many records as ``records`` says (null: any number).
    """
    common.ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            done = []
            for source, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                offset = count = 0
                with store.open_input_stream(source, compression=None) as stream, store.open_output_stream(name, compression=None) as out, store.open_output_stream(f"{name}.idx", compression=None) as index:
                    for fields, data in split_records(inflate(stream)):
                        engine = zlib.compressobj(level, wbits=GZIP)
                        member = engine.compress(data) + engine.flush()
                        out.write(member)
                        index.write(json.dumps({"offset": offset, "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"]}).encode() + b"\n")
                        offset, count = offset + len(member), count + 1
                if expected is not None and count != expected:
                    raise ValueError(f"{source} has {count} records, not {expected}")
                done.append((name, count))
            yield _names(done)

    spread = archives.repartition(common.parallelism(archives.sparkSession))
    return spread.select("archive", "records").mapInArrow(run, "archive string, records bigint")


def read_archives(archives: DataFrame, folder: str, with_html: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type, refers_to[, url, html] of every record, sought by the index.

    A response's digest is computed anew and must be the recorded one.
    """
    common.ship(archives.sparkSession)
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", url string, html string" * with_html

    def number(name: str | None) -> int | None:
        digits = (name or "").strip("<>").removeprefix(NAME)
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()][: 7 if with_html else 5]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split(" ")[0] for x in schema.split(", ")])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(f"{name}.idx", compression=None) as f:
                    index = f.read().splitlines()
                with store.open_input_file(name) as archive:
                    for line in index:
                        entry = json.loads(line)
                        archive.seek(entry["offset"])
                        data = zlib.decompress(archive.read(entry["length"]), GZIP)
                        cut = data.index(b"\r\n\r\n") + 4
                        fields = parse_head(data[:cut])
                        block = data[cut : cut + int(fields["content-length"])]
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in head.split(NEWLINE) if x.lower().startswith(b"content-length:")).split(b":")[1])
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
                        if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
                            raise ValueError(f"{name} at {entry['offset']}: the payload does not match its record")
                        row = (number(fields["warc-record-id"]), size, digest.hex(), fields["warc-type"], number(fields.get("warc-refers-to")))
                        rows.append((*row, fields.get("warc-target-uri"), payload.decode() if fields["warc-type"] == "response" else None)[: len(kinds)])
                        if len(rows) >= (500 if with_html else 10_000):
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    spread = archives.repartition(common.parallelism(archives.sparkSession))
    return spread.select("archive").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes, normalises and reads back: the rows of ``read_archives``."""
    spark = pages.sparkSession
    folder = common.scratch(spark, "warc")
    raw = common.materialise(write_archives(decide(pages, least), f"{folder}/raw"), "archives")
    done = common.materialise(normalise(raw, f"{folder}/members"), "archives")
    return read_archives(done, folder)
