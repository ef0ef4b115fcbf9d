"""Removal of repeated passages by super-k-mer partitioning (operator 2).

A window is ``k`` consecutive words of one document.  Its minimiser is the
least hash among the runs of ``m`` words in it; neighbouring windows mostly
share theirs.  Such a stretch of windows (a super-k-mer) travels as one packed
string of words to the bucket that its minimiser names, so a word is sent
about three times rather than ``k`` times, and equal windows meet in one
bucket.  There the windows are sorted by a hash and those that meet are
compared word by word, so counts are exact.  All but the earliest of equal
windows are repeats; a word under a repeat is removed.

Scale.  A task sends a stretch that it meets repeatedly once and settles the
others itself, so thousands of copies of a passage cost one row for each task.
Strings to one bucket are compressed together.  Buckets are sized by the input.
A bucket that is larger than ``limit`` windows all the same is worked off in
parts of that size; what stays undecided in it is dealt anew by the windows' own
hashes, round by round, so no task holds more than a part.

Defined results: a null or empty text has no words; a null doc_id comes before
all others; rows that share doc_id and text are one document (neither is
earlier, so neither loses words to the other); rows that share doc_id only are
separate documents, ordered by a checksum of the text; of windows that start
alike none is a tie, as start and document order them; an empty table gives no
rows; further columns, whatever their names, are kept, or left out with
``digest``.  A very long text is hashed in chunks and cut into stretches.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Stands for a null doc_id.
NO_ID = -(1 << 63)
#: Odd constants of the rolling hash and of its finisher.
MULTIPLIER = 0x9E3779B97F4A7C15
FINISHER = 0xD6E8FEB86659FD93
#: Stretches that a task gathers before it sends them.
GATHER = 150_000


#: Bytes that are hashed at once, and the powers of the hash's base for them; the base is odd, so it has an inverse modulo 2**64.
CHUNK = 1 << 17
BASE = 0x5851F42D4C957F2D


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + 1, base, dtype=np.uint64)
    out[0] = 1
    return out.cumprod(dtype=np.uint64)


POWERS, INVERSES = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def hash_words(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words joined by one space: a 64-bit hash, begin and end of each.

    A word's hash is the polynomial of its bytes, a difference of running sums;
    so all words of a chunk are hashed by a few operations on its bytes.
    """
    a = np.frombuffer(joined, dtype=np.uint8)
    space = np.flatnonzero(a == 32)
    begin, end = np.concatenate([[0], space + 1]), np.concatenate([space, [len(a)]])
    out = np.empty(len(begin), dtype=np.uint64)
    i = 0
    while i < len(begin):
        base = begin[i]
        j = int(np.searchsorted(end, base + CHUNK, side="right"))
        if j == i:  # one word of more than a chunk
            out[i] = xxhash.xxh64_intdigest(joined[base : end[i]])
            i += 1
            continue
        part = a[base : end[j - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= POWERS[: len(part)]
        sums = np.concatenate([[np.uint64(0)], part.cumsum(dtype=np.uint64)])
        x, y = begin[i:j] - base, end[i:j] - base
        out[i:j] = (sums[y] - sums[x]) * INVERSES[x]
        i = j
    return out, begin, end


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of each run of k values, by doubling."""
    n = len(h) - k + 1
    out, done, power, size, step = None, 0, h, 1, MULTIPLIER
    while k:
        if k & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(step) + part
            done += size
        k >>= 1
        if k:
            power = power[:-size] * np.uint64(step) + power[size:]
            size *= 2
            step = step * step % (1 << 64)
    out ^= out >> np.uint64(32)
    out *= np.uint64(FINISHER)
    out ^= out >> np.uint64(32)
    return out


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbouring values."""
    size, least = 1, h
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(h) - w + 1], least[w - size :][: len(h) - w + 1]) if size < w else least


def stretches(hashes: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each stretch of a document of at least k words."""
    least = sliding_min(rolling(hashes, m), k - m + 1)
    begin = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[begin], begin, np.diff(np.concatenate([begin, [len(least)]]))


# A blob holds stretches for one bucket: the number of windows, then compressed: counts, (doc, text checksum) table, then for each stretch the place of its document in that table, first window and windows, then all words joined by a space.
def pack_blob(rows: list[tuple[int, int, int, int, bytes]], compressor: zstandard.ZstdCompressor) -> bytes:
    docs: dict[tuple[int, int], int] = {}
    place = [docs.setdefault((r[0], r[1]), len(docs)) for r in rows]
    head = struct.pack("<II", len(rows), len(docs))
    arrays = [np.array([d[0] for d in docs], "<i8"), np.array([d[1] for d in docs], "<u4"), np.array(place, "<u4"), np.array([r[2] for r in rows], "<u4"), np.array([r[3] for r in rows], "<u4")]
    windows = sum(r[3] for r in rows)
    return struct.pack("<I", windows) + compressor.compress(head + b"".join(a.tobytes() for a in arrays) + b" ".join([r[4] for r in rows]))


def unpack_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """doc_id, checksum, first window, windows of each stretch; all words joined by a space."""
    raw = zstandard.ZstdDecompressor().decompress(memoryview(blob)[4:])
    n, d = struct.unpack_from("<II", raw)
    at = 8
    out = []
    for kind, count in (("<i8", d), ("<u4", d), ("<u4", n), ("<u4", n), ("<u4", n)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    place = out[2]
    return out[0][place], out[1][place].astype(np.int64), out[3].astype(np.int64), out[4].astype(np.int64), raw[at:]


@dataclass
class Windows:
    """The windows of some stretches, in order: the stretch, the place in it, bytes from and to, hash."""

    row: np.ndarray
    inner: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    key: np.ndarray
    joined: bytes

    @classmethod
    def of(cls, count: np.ndarray, joined: bytes, k: int) -> "Windows":
        first = np.cumsum(count + k - 1) - (count + k - 1)
        row = np.repeat(np.arange(len(count)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        place = first[row] + inner
        hashes, begin, end = hash_words(joined)
        return cls(row, inner, begin[place], end[place + k - 1], rolling(hashes, k)[place], joined)

    def text(self, i: int) -> bytes:
        return self.joined[self.begin[i] : self.end[i]]


def find_repeats(doc: np.ndarray, check: np.ndarray, start: np.ndarray, w: Windows) -> np.ndarray:
    """For every window: does it start earlier as well?"""
    order = np.argsort(w.key, kind="stable")
    same = w.key[order][1:] == w.key[order][:-1]
    met = np.zeros(len(order), dtype=bool)
    met[1:] |= same
    met[:-1] |= same
    repeat = np.zeros(len(order), dtype=bool)
    some = order[met]
    if not len(some):
        return repeat
    r = w.row[some]
    at = start[r] + w.inner[some]
    by = np.lexsort((at, check[r], doc[r], w.key[some]))
    some, r, at = some[by], r[by], at[by]
    new = np.concatenate([[True], w.key[some][1:] != w.key[some][:-1]])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))
    repeat[some] = (doc[r] != doc[r[lead]]) | (check[r] != check[r[lead]]) | (at != at[lead])
    # equal hashes: the words decide
    odd: dict[int, list[int]] = {}
    head, first = b"", -1
    for i, f in zip(np.flatnonzero(~new).tolist(), lead[~new].tolist()):
        if f != first:
            head, first = w.text(some[f]), f
        if w.text(some[i]) != head:
            odd.setdefault(f, []).append(i)
    for members in odd.values():
        firsts: dict[bytes, int] = {}
        for i in members:
            f = firsts.setdefault(w.text(some[i]), i)
            repeat[some[i]] = (doc[r[i]], check[r[i]], at[i]) != (doc[r[f]], check[r[f]], at[f])
    return repeat


#: Rows on their way: repeats that are settled (blob is null), or a blob for a bucket.  Every row has a bucket, by which it is dealt.
ROW = "doc bigint, `check` bigint, start bigint, windows bigint, bucket int, blob binary"
NAMES = ["doc", "check", "start", "windows", "bucket", "blob"]


def settled_batch(doc, check, start, windows, buckets: int) -> pa.RecordBatch:
    doc, check, start, windows = (np.asarray(x, dtype=np.int64) for x in (doc, check, start, windows))
    bucket = ((doc * 31 + check) % buckets).astype(np.int32)
    return pa.RecordBatch.from_arrays([*map(pa.array, (doc, check, start, windows, bucket)), pa.nulls(len(doc), pa.binary())], names=NAMES)


def send(rows: Iterable[tuple[int, tuple[int, int, int, int, bytes]]]) -> Iterator[pa.RecordBatch]:
    """Blobs of (bucket, stretch) rows, some megabytes at a time."""
    by: dict[int, list] = {}
    for bucket, row in rows:
        by.setdefault(bucket, []).append(row)
    compressor = zstandard.ZstdCompressor(level=3)
    blobs: list[bytes] = []
    to: list[int] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(to), pa.int64())] * 4 + [pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], names=NAMES)

    for bucket in sorted(by):
        to.append(bucket)
        blobs.append(pack_blob(by.pop(bucket), compressor))
        if sum(map(len, blobs)) > 4_000_000:
            yield batch()
            blobs, to = [], []
    if to:
        yield batch()


def merge(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Joins touching stretches of windows of one document."""
    out: list[list[int]] = []
    for doc, check, a, n in sorted(found):
        if out and out[-1][:2] == [doc, check] and a <= out[-1][2] + out[-1][3]:
            out[-1][3] = max(out[-1][3], a + n - out[-1][2])
        else:
            out.append([doc, check, a, n])
    return [tuple(x) for x in out]


def cut(docs: DataFrame, k: int, m: int, buckets: int) -> DataFrame:
    """Blobs for the buckets, and the stretches that a task settles itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int, int, int, int]] = {}
        repeated: list[tuple[int, int, int, int]] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode()
                words = data.split()
                if len(words) < k:
                    continue
                check = zlib.crc32(data)
                joined = b" ".join(words)
                hashes, from_byte, to_byte = hash_words(joined)
                least, begin, count = stretches(hashes, k, m)
                left, right = from_byte[begin].tolist(), to_byte[begin + count + k - 2].tolist()
                for bucket, a, n, x, y in zip((least % np.uint64(buckets)).tolist(), begin.tolist(), count.tolist(), left, right):
                    packed = joined[x:y]
                    known = seen.get(packed)
                    if known is None:
                        seen[packed] = (doc, check, a, n, bucket)
                    elif known[:3] < (doc, check, a):
                        repeated.append((doc, check, a, n))
                    elif known[:3] > (doc, check, a):
                        repeated.append(known[:4])
                        seen[packed] = (doc, check, a, n, bucket)
                if len(seen) >= GATHER:
                    yield from send((v[4], (*v[:4], s)) for s, v in seen.items())
                    seen = {}
                if len(repeated) >= 50_000:
                    yield settled_batch(*zip(*merge(repeated)), buckets)
                    repeated = []
        yield from send((v[4], (*v[:4], s)) for s, v in seen.items())
        if repeated:
            yield settled_batch(*zip(*merge(repeated)), buckets)

    return docs.mapInArrow(common.released(run), ROW)


def settle(rows: DataFrame, k: int, limit: int, buckets: int, next_buckets: int) -> DataFrame:
    """The repeats of each bucket; blobs for another round where a bucket passes ``limit`` windows."""

    def part(held: list[bytes], whole: bool) -> Iterator[pa.RecordBatch]:
        parts = [unpack_blob(b) for b in held]
        doc, check, start, count = (np.concatenate([p[i] for p in parts]) for i in range(4))
        w = Windows.of(count, b" ".join([p[4] for p in parts]), k)
        repeat = find_repeats(doc, check, start, w)
        hit = np.flatnonzero(repeat)
        if len(hit):
            new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(w.row[hit]) != 0)]))
            first = hit[new]
            r = w.row[first]
            yield settled_batch(doc[r], check[r], start[r] + w.inner[first], np.diff(np.concatenate([new, [len(hit)]])), buckets)
        if not whole:  # the earliest of each kind in this part goes on alone, to a bucket by its own hash
            yield from send(
                (int(w.key[i]) % next_buckets, (int(doc[r]), int(check[r]), int(start[r] + w.inner[i]), 1, w.text(i)))
                for i, r in ((i, w.row[i]) for i in np.flatnonzero(~repeat).tolist())
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, windows, whole = None, [], 0, True
        for batch in batches:
            blobs = batch.column(5)
            if blobs.null_count:
                yield batch.filter(blobs.is_null())
            for at, blob in zip(batch.column(4).to_pylist(), blobs):
                if at != bucket:
                    if held:
                        yield from part(held, whole)
                    bucket, held, windows, whole = at, [], 0, True
                if not blob.is_valid:
                    continue
                blob = blob.as_py()
                here = struct.unpack_from("<I", blob)[0]
                if held and windows + here > limit:
                    whole = False
                    yield from part(held, whole)
                    held, windows = [], 0
                held.append(blob)
                windows += here
        if held:
            yield from part(held, whole)

    dealt = rows.repartition(common.parallelism(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(common.released(run), ROW)


def repeats(docs: DataFrame, k: int = 20, m: int = 4, limit: int = 1_000_000, bucket_bytes: int = 200_000) -> DataFrame:
    """doc, check, start, windows: stretches of windows that also start earlier.

    ``docs`` has doc_id and text.  There is one bucket for each ``bucket_bytes``
    of input as Spark estimates it; a wrong estimate costs a round, not results.
    """
    common.ship(docs.sparkSession)
    buckets = max(64, min(common.size_of(docs) // bucket_bytes, 1 << 24))
    slim = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), "text")
    rows, out = cut(slim, k, m, buckets), None
    while True:
        more = min(buckets * 16, 1 << 24)
        found = common.materialise(settle(rows, k, limit, buckets, more).coalesce(common.tasks(docs)), "repeats")
        settled = found.where("blob is null").drop("bucket", "blob")
        out = settled if out is None else out.unionByName(settled)
        rows, buckets = found.where("blob is not null"), more
        if rows.isEmpty():
            return out


def remove_repeats(docs: DataFrame, k: int = 20, m: int = 4, digest: bool = False, **parameters) -> DataFrame:
    """``docs`` with the words under repeats removed from text.

    A text that keeps all its words stays as it is; of others the kept words
    are joined by one space.  All columns stay.  With ``digest`` the result is
    doc_id, n_words, n_removed, kept_sha256 instead (joined words in any case).
    """
    common.ship(docs.sparkSession)
    found = repeats(docs.select("doc_id", "text"), k, m, **parameters)
    by_doc = found.groupBy("doc", "check").agg(F.collect_list(F.struct("start", "windows")).alias("__runs"))
    rows = docs.select("doc_id", "text") if digest else docs
    # all columns travel as one, so that no name clashes
    keyed = rows.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("__doc"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("__check"))
    # shuffled at any size: what small tables take of disk tells what large ones do
    by_doc = by_doc.withColumnsRenamed({"doc": "__doc", "check": "__check"}).hint("merge")
    joined = keyed.join(by_doc, ["__doc", "__check"], "left").drop("__doc", "__check")

    def kept(text: str | None, runs) -> tuple[int, list[bytes]]:
        words = (text or "").encode().split()
        if not runs:
            return len(words), words
        change = np.zeros(len(words) + 1, dtype=np.int32)
        for r in runs:
            change[r["start"]] += 1
            change[r["start"] + r["windows"] + k - 1] -= 1
        keep = np.cumsum(change[:-1]) == 0
        return len(words), [words[i] for i in np.flatnonzero(keep).tolist()]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, sha = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2)):
                total, words = kept(text.as_py(), runs.as_py())
                n.append(total)
                removed.append(total - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.names.index("text")
            out = []
            for text, runs in zip(batch.column(place), batch.column(batch.num_columns - 1)):
                out.append(b" ".join(kept(text.as_py(), runs.as_py())[1]).decode() if runs.is_valid else text.as_py())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    if digest:
        return joined.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").alias("text"), "__runs").mapInArrow(common.released(digests), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    runs = "__runs" + "_" * max(map(len, docs.columns))  # a name that no column has
    return joined.select(*common.unpacked(docs.columns), F.col("__runs").alias(runs)).mapInArrow(common.released(texts), docs.schema).coalesce(common.tasks(docs))


#: ``remove_repeats(digest=True)`` over ``documents`` for DuckDB.
ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as k from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as i from d)),
rep as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as n from win) where n > 1),
cov as (select distinct doc_id, unnest(generate_series(i, i + 19)) as j from rep),
word as (select doc_id, unnest(w) as x, unnest(generate_series(1, len(w))) as j from d),
kept as (select word.doc_id, count(cov.j) as gone, string_agg(x, ' ' order by word.j) filter (where cov.j is null) as rest from word left join cov on cov.doc_id = word.doc_id and cov.j = word.j group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(rest, '')) as kept_sha256 from d left join kept on kept.doc_id = d.doc_id
"""
