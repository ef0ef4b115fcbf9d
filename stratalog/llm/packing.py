"""Best-fit packing of token sequences with a bounded number of open bins (operator 6).

Documents longer than a sequence are cut into full pieces; what is left over
(one item of at most ``capacity`` tokens for each document) is packed online:
an item goes into the open bin with the least free space that holds it.  The
open bins are kept in one integer used as a bitset whose bit f says that some
open bin has f free tokens, so the best fit is the lowest set bit at or above
the item's length.  No more than ``open_bins`` bins are ever open: when another
one is needed, the fullest closes first.

Items are dealt to lanes by a hash of their document and arrive there by doc_id
and piece.  The next ``ahead`` of them are looked at together and placed from
long to short: long ones open bins, the short ones behind them fill these.  So
memory is bounded by the two parameters, a retried task makes the same sequences
again, and no task sees more than its lane.  What a lane leaves open at its end
is all that lanes cost.

Defined results: a null or empty text is a document of just the separator; rows
with equal doc_id are packed as separate documents, and ties in length are
placed in order of arrival; an empty table gives no rows; further columns are
left out.  A very long text is held whole once, as its packed ids.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import bpe, common

SEPARATOR = 0


class Ids:
    """Texts to the tokenizer's ids, packed.

    Text is cut into the tokenizer's pieces here, and each piece goes to the
    tokenizer's model; pieces met lately are remembered.  A text with special
    tokens or very new code points goes through the whole tokenizer.  A test
    holds all of this against the tokenizer alone.
    """

    def __init__(self, path: str, limit: int = 250_000):
        with open(path, encoding="utf-8") as f:
            special = bpe.supported(json.load(f))
        self.special, self.mark = bool(special), os.path.commonprefix(special)
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = common.Remembered(self._piece, limit)

    def _piece(self, piece: str) -> bytes:
        return bpe.pack([t.id for t in self.tokenizer.model.tokenize("".join([bpe.SYMBOLS[b] for b in piece.encode()]))])

    def encode(self, text: str) -> bytes:
        pieces = None if self.special and self.mark in text else bpe.pieces_of(text)
        if pieces is None:
            return bpe.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, pieces))


_tables: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _tables:
        _tables[path] = Ids(path)
    return _tables[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with ``with_ids``, ids."""
    common.ship(docs.sparkSession)
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ids_of(tokenizer)
        tail = SEPARATOR.to_bytes(4, "little")
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packed = memoryview(table.encode(text.as_py() or "") + tail)
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(common.released(run), schema)


class Packer:
    """Online best-fit over at most ``open_bins`` open bins."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f: some open bin has f free tokens
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free tokens
        self.open = self.made = self.closed = 0  # closed: for want of room for another bin

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of an item."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            if self.open == self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
                self.open -= 1
                self.closed += 1
            number, room = self.made, self.capacity
            self.made += 1
            self.open += 1
        left = room - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
        else:
            self.open -= 1
        return number, self.capacity - room

    def _take(self, room: int) -> int:
        number = self.bins[room].pop()
        if not self.bins[room]:
            self.free &= ~(1 << room)
        return number


def pack(items: DataFrame, capacity: int, lanes: int, open_bins: int = 256, ahead: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (at most ``capacity``)."""
    common.ship(items.sparkSession)
    kept = items.columns
    # salted with the piece: the full pieces of one very long document spread over the lanes
    dealt = items.withColumn("__h", F.xxhash64("doc_id", "piece", "length")).withColumn("__lane", F.pmod("__h", F.lit(lanes)).cast("int"))
    dealt = dealt.repartition(lanes, "__lane").sortWithinPartitions("__lane", "doc_id", "piece", "length", "ids_crc32")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, packer, held = None, None, None

        def placed(some: pa.RecordBatch, at: int) -> pa.RecordBatch:
            nonlocal lane, packer
            if at != lane:
                lane, packer = at, Packer(capacity, open_bins)
            length = some.column(some.schema.names.index("length")).to_numpy()
            seq, off = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            for i in np.argsort(-length, kind="stable").tolist():
                number, off[i] = packer.put(int(length[i]))
                seq[i] = (lane << 40) | number
            return pa.RecordBatch.from_arrays([some.column(some.schema.names.index(c)) for c in kept] + [pa.array(seq), pa.array(off)], names=[*kept, "sequence_id", "offset"])

        for batch in batches:
            held = pa.concat_batches([held, batch]) if held is not None else batch
            of = held.column(held.schema.names.index("__lane")).to_numpy()
            begin = 0
            while begin < len(of):
                end = int(np.searchsorted(of, of[begin], side="right"))
                if end == len(of) and end - begin < ahead:
                    break  # more of this lane may come
                end = min(end, begin + ahead)
                yield placed(held.slice(begin, end - begin), int(of[begin]))
                begin = end
            held = held.slice(begin)
        if held is not None and held.num_rows:
            yield placed(held, int(held.column(held.schema.names.index("__lane"))[0].as_py()))

    return dealt.mapInArrow(common.released(run), schema)


def lanes_for(docs: DataFrame, rows_per_lane: int = 2048) -> int:
    """How many lanes: each packs about ``rows_per_lane`` documents."""
    return max(1, -(-docs.count() // rows_per_lane))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, open_bins: int = 256, with_ids: bool = False, rows_per_lane: int = 2048) -> DataFrame:
    """Tokens of every document, cut and packed: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return pack(pieces(docs, tokenizer, capacity, with_ids), capacity, lanes_for(docs, rows_per_lane), open_bins)
