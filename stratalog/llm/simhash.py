"""SimHash near-duplicates by pigeonhole blocks (operator 10).

A 64-bit fingerprint is cut into ``blocks`` blocks.  Two fingerprints that
differ in at most ``distance`` bits agree on at least ``blocks - distance``
whole blocks, so each is filed under every choice of that many blocks: close
pairs meet under at least one key, and the more blocks, the longer the keys.
Under a key, candidates are verified by Hamming distance.

Only distinct fingerprints are filed, so copies of one text meet as one row,
and a key's group hands on links that span it rather than all of its pairs; a
group too large for pairwise comparison is cut again by the same principle,
over the bits in which its members still differ.  Components are found by
``graph.components`` over least doc_ids, so a component's least node is its name
and no large component has to be brought together to be named.

*By similarity* (``similar_texts``, ``keep_representatives``).  At a Jaccard
similarity of 0.8 of shingle sets, about 0.15 of a fingerprint's bits differ,
too many for whole blocks of 64 bits to agree.  So fingerprints are wider there:
``CHECK`` bits for verification and as many blocks behind them as make a pair at
the least similarity share one with probability ``recall``.  Blocks have about
as many bits as the table's size has (three fewer), so that a block's value is
shared by few unrelated texts at every size.  Texts that share a block and
differ in at most ``within`` check bits are linked if their whole shingle sets
are as similar as asked.

Links that this misses are found exactly (``_missed``).  Sets as similar as asked
have a shingle in common among the first n - ceil(similarity * n) + 1 of either,
in any one order of all shingles, so every set is filed under those.  The order
puts shingles that were met often last, which keeps groups small and changes no
result.  Under a shingle only sets of different components so far meet, and a
pair goes on unless its sizes, what follows the shingle in both, or the parities of its shingles in 256, then 2,048 slots,
rule the similarity out; whole sets decide.  So a component holds all links.

Defined results: a null or empty text, or one of white space only, has
fingerprint zero and is linked like any other (``similar_texts``: those are
linked with each other); a text of fewer words than a shingle is one shingle;
repeated rows are each returned; rows that share a doc_id are one document; a
null doc_id is never a component's name unless it is alone; an empty table gives
no rows; further columns are kept by ``keep_representatives`` and left out
elsewhere.  A very long text's shingles are counted in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components

BITS = 64
#: Shingles whose bits are counted at once.
SLICE = 1 << 16
#: Groups up to this size are compared pairwise.
PAIRWISE = 2048


def fingerprint(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> int:
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    if len(words) < words_per_shingle:
        hashes = np.array([digest(joined, seed)], dtype=np.uint64)
    else:
        hashes = np.fromiter([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[words_per_shingle - 1 :])], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a bigint)."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words_per_shingle, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(common.released(run), "doc_id bigint, fp bigint")


def masks(distance: int, blocks: int) -> list[int]:
    """One mask for each choice of the blocks that must agree."""
    if not distance < blocks <= BITS:
        raise ValueError("more blocks than differing bits are needed")
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(block[k] for k in chosen) for chosen in combinations(range(blocks), blocks - distance)]


class Forest:
    """Union-find over fingerprints; ``links`` has one link for each node but the first of each tree."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, pairs: np.ndarray) -> None:
        for a, b in pairs.tolist():
            ra, rb = self.root(a), self.root(b)
            if ra != rb:
                self.up[max(ra, rb)] = min(ra, rb)
                self.up.setdefault(min(ra, rb), min(ra, rb))

    def links(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.up if (r := self.root(x)) != x]


def link_sorted(key: np.ndarray, fp: np.ndarray, distance: int, forest: Forest) -> None:
    """Links pairs at most ``distance`` bits apart under equal keys; rows come sorted by key."""
    at = np.arange(len(key) - 1)
    d = 1
    while len(at):
        at = at[: np.searchsorted(at, len(key) - d)]
        at = at[key[at] == key[at + d]]
        x, y = fp[at], fp[at + d]
        close = np.bitwise_count(x ^ y) <= distance
        if close.any():
            forest.join(np.stack([x[close], y[close]], axis=1))
        d += 1


def link_group(fp: np.ndarray, distance: int, forest: Forest) -> None:
    """The same for one group of distinct fingerprints of any size."""
    if len(fp) <= PAIRWISE:
        link_sorted(np.zeros(len(fp), dtype=np.int8), fp, distance, forest)
        return
    differing = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [k for k in range(BITS) if differing >> k & 1]
    if len(bits) <= distance:
        forest.join(np.stack([fp, np.full_like(fp, fp[0])], axis=1))
        return
    for k in range(distance + 1):
        block = np.uint64(sum(1 << b for b in bits[k :: distance + 1]))
        order = np.argsort(fp & block, kind="stable")
        cut = np.flatnonzero(np.diff((fp & block)[order])) + 1
        for part in np.split(order, cut):
            if len(part) > 1:
                link_group(fp[part], distance, forest)


def links(nodes: DataFrame, distance: int = 4, blocks: int = 7) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that keep what is connected connected."""
    common.ship(nodes.sparkSession)
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks(distance, blocks))]
    filed = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    filed = filed.repartition(common.parallelism(nodes.sparkSession), "key").sortWithinPartitions("key", "fp")

    def flush(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        forest = Forest()
        cut = np.flatnonzero(np.diff(key)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        large = end - begin > PAIRWISE
        for a, b in zip(begin[large], end[large]):
            link_group(fp[a:b], distance, forest)
        small = np.repeat(~large & (end - begin > 1), end - begin)
        if small.any():
            link_sorted(key[small], fp[small], distance, forest)
        found = np.array(forest.links(), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            key, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            rest.append((key, fp))
            if key[0] == key[-1] or sum(len(k) for k, _ in rest) < 100_000:
                continue  # the last key's group goes on
            whole = int(np.searchsorted(key, key[-1]))
            rest[-1] = (key[:whole], fp[:whole])
            yield flush(*map(np.concatenate, zip(*rest)))
            rest = [(key[whole:], fp[whole:])]
        if rest:
            yield flush(*map(np.concatenate, zip(*rest)))

    return filed.select("key", "fp").mapInArrow(common.released(run), "a bigint, b bigint")


#: Names of nodes without a doc_id come after all doc_ids.
LAST = (1 << 63) - 1 - (1 << 32)


def _named(rows: DataFrame, edges: DataFrame, key: str, tasks: int = 1 << 20) -> DataFrame:
    """doc_id, ``key``, component_id of rows with doc_id and key; ``edges`` (a, b) link keys."""
    nodes = rows.groupBy(key).agg(F.coalesce(F.min("doc_id"), F.lit(LAST) + F.pmod(F.xxhash64(key), F.lit(1 << 32))).alias("name"))
    nodes = common.materialise(nodes.coalesce(tasks), "nodes")
    side = lambda c: nodes.select(F.col(key).alias(c), F.col("name").alias(f"n{c}"))
    found = components(edges.join(side("a"), "a").join(side("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")), tasks)
    rooted = nodes.join(found.withColumnRenamed("node", "name"), "name", "left").select(key, F.coalesce("root", "name").alias("component_id"))
    joined = rows.join(rooted, key)
    return joined.select("doc_id", key, F.when(F.col("component_id") < LAST, F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, distance: int = 4, blocks: int = 7, words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the least doc_id reachable over links of at most ``distance`` bits."""
    fps = common.materialise(fingerprints(docs, words_per_shingle, seed), "fingerprints")
    found = _named(fps, links(fps.select("fp").distinct(), distance, blocks), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- by similarity

#: Bits of a wide fingerprint that verify candidates.
CHECK = 128
#: Odd constants that make further hashes of a hash.
MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) for k in range(512)], dtype=np.uint64)
#: Numbers of check bits within which texts are linked, closest first.
LEVELS = (10, 20)
#: 64-bit words of the parities of a set: those that its rows under shingles carry, and those that pairs are sieved by again.
PARITY, WIDE = 4, 32
PARITIES = [f"p{k}" for k in range(PARITY)]
#: Slots of the table of frequent shingles, and the count from which one is frequent.
SLOTS, FREQUENT = 1 << 20, 4


def shingles(text: str | None, words_per_shingle: int, seed: int) -> np.ndarray:
    """Distinct hashes of the shingles, sorted."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space only
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)] if words else []
    else:
        ends = list(accumulate([len(w) + 1 for w in words]))
        hashes = [xxhash.xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[words_per_shingle - 1 :])]
    return np.unique(np.array(hashes, dtype=np.uint64))


def wide_fingerprint(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bits that are set in over half of the hashes, each widened to ``bits`` bits."""
    words = -(-bits // 64)
    ones = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 12):
        x = hashes[at : at + (1 << 12), None] * MIX[None, :words]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return (2 * ones > len(hashes))[:bits]


def block_plan(rows: int, similarity: float, recall: float) -> tuple[int, int, int]:
    """Bits of a block, number of blocks, and check bits in which pairs of the least similarity hardly ever differ more."""
    differ = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
    size = max(10, max(rows, 2).bit_length() - 3)
    blocks = ceil(log(1 - recall) / log(1 - (1 - differ) ** size))
    return size, blocks, round(CHECK * differ + 3.5 * (CHECK * differ * (1 - differ)) ** 0.5)


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 0)


def parities(hashes: np.ndarray, words: int) -> np.ndarray:
    """For each of 64 * words slots, whether an odd number of hashes falls there: sets differ in at least as many elements as their parities."""
    slot = (hashes * np.uint64(MIX[1])) >> np.uint64(64 - (64 * words - 1).bit_length())
    return np.packbits(np.bincount(slot.astype(np.int64), minlength=64 * words) & 1, bitorder="little").view("<i8")


def by_key(batches: Iterator[pa.RecordBatch], flush) -> Iterator[pa.RecordBatch]:
    """``flush`` of the columns of rows that come sorted by the first; rows of one key stay together."""
    rest: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        columns = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        key = columns[0]
        if not len(key):
            continue
        rest.append(columns)
        if key[0] == key[-1] or sum(len(c[0]) for c in rest) < 100_000:
            continue  # the last key's group goes on
        whole = int(np.searchsorted(key, key[-1]))
        rest[-1] = tuple(c[:whole] for c in columns)
        yield flush(*map(np.concatenate, zip(*rest)))
        rest = [tuple(c[whole:] for c in columns)]
    if rest:
        yield flush(*map(np.concatenate, zip(*rest)))


def _filed(docs: DataFrame, words_per_shingle: int, seed: int, size: int, blocks: int) -> DataFrame:
    """doc_id, node (a name of the shingle set), x and y (the check bits), keys, size and parities (p0 and on, wide) of the set."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(size, dtype=np.int64)
        for batch in batches:
            nodes, checks, keys, sizes, odd, wide = [], [], [], [], [], []
            for text in batch.column(1):
                hashes = shingles(text.as_py(), words_per_shingle, seed)
                bits = wide_fingerprint(hashes, CHECK + size * blocks)
                nodes.append(node_of(hashes))
                checks.append(np.packbits(bits[:CHECK], bitorder="little").view("<i8"))
                keys.append((bits[CHECK:].reshape(blocks, size) @ power) * blocks + np.arange(blocks))
                sizes.append(len(hashes))
                odd.append(parities(hashes, PARITY))
                wide.append(parities(hashes, WIDE))
            check = np.array(checks, dtype=np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * blocks), pa.array(np.array(keys, dtype=np.int64).reshape(-1)))
            odd = np.array(odd, dtype=np.int64).reshape(-1, PARITY)
            columns = [batch.column(0), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(check[:, 0]), pa.array(check[:, 1]), lists, pa.array(sizes, pa.int64()), *map(pa.array, odd.T.copy())]
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * WIDE), pa.array(np.array(wide, dtype=np.int64).reshape(-1))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "x", "y", "keys", "size", *PARITIES, "wide"])

    schema = "doc_id bigint, node bigint, x bigint, y bigint, keys array<bigint>, size bigint" + "".join(f", {p} bigint" for p in PARITIES) + ", wide array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(common.released(run), schema)


def span(node: np.ndarray, x: np.ndarray, y: np.ndarray, within: int) -> list[tuple[int, int]]:
    """Links that span the nodes of a group over pairs that differ in at most ``within`` bits.

    Nodes are reached from one another; each is compared with those that are
    not reached yet, so a group of close texts costs its size, not its square.
    """
    out: list[tuple[int, int]] = []
    left = np.arange(len(node))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(x[left] ^ x[i]) + np.bitwise_count(y[left] ^ y[i]) <= within
            if near.any():
                reached = left[near].tolist()
                out += [(int(node[i]), int(node[j])) for j in reached]
                queue += reached
                left = left[~near]
    return out


def _candidates(nodes: DataFrame, within: int) -> DataFrame:
    """a < b: pairs of nodes (node, x, y, keys) that share a block, spanning what is close at each level."""
    filed = nodes.select(F.explode("keys").alias("key"), "node", "x", "y")
    filed = filed.repartition(common.parallelism(nodes.sparkSession), "key").sortWithinPartitions("key", "node")

    def flush(key: np.ndarray, node: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        x, y = x.view(np.uint64), y.view(np.uint64)  # bits of signed numbers are counted in their absolute value
        # groups with a close pair, found by comparing each row with the next ones of its key; in large groups that is left to ``span``
        cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        size = np.diff(cut)
        of = np.repeat(np.arange(len(size)), size)
        close = size > 64
        at = np.flatnonzero(~close[of])
        for d in range(1, 64):
            at = at[at + d < len(key)]
            at = at[of[at] == of[at + d]]
            if not len(at):
                break
            near = np.bitwise_count(x[at] ^ x[at + d]) + np.bitwise_count(y[at] ^ y[at + d]) <= within
            close[of[at[near]]] = True
        found = {(min(p), max(p)) for g in np.flatnonzero(close).tolist() for k in {*LEVELS, within} for p in span(*(c[cut[g] : cut[g + 1]] for c in (node, x, y)), k)}
        pairs = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return filed.mapInArrow(common.released(lambda batches: by_key(batches, flush)), "a bigint, b bigint").distinct()


def _sets(docs: DataFrame, words_per_shingle: int, seed: int) -> DataFrame:
    """node, set: the hashes of each text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words_per_shingle, seed) for t in batch.column(0)]
            nodes = np.array([node_of(s) for s in found], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.view(np.int64) for s in found], type=pa.list_(pa.int64()))], names=["node", "set"])

    return docs.select("text").mapInArrow(common.released(run), "node bigint, set array<bigint>")


def _edges(docs: DataFrame, filed: DataFrame, pairs: DataFrame, similarity: float, words_per_shingle: int, seed: int, broadcast_rows: int = 0) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are as similar as asked."""
    # whole sets of the nodes that have candidates, once each
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = filed.join(met, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc")).select("doc").distinct()
    if broadcast_rows and 2 * pairs.count() <= broadcast_rows:
        one = F.broadcast(one)
    texts = docs.join(one, docs["doc_id"].cast("bigint").eqNullSafe(F.col("doc")), "left_semi")
    sets = common.materialise(_sets(texts, words_per_shingle, seed).dropDuplicates(["node"]).coalesce(common.tasks(docs)), "sets")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("n") >= similarity * (F.size("sa") + F.size("sb") - F.col("n"))).select("a", "b")


def _new_sets(batches: Iterator[pa.RecordBatch], words_per_shingle: int, seed: int) -> Iterator[np.ndarray]:
    """The shingles of each text; of equal ones near each other only the first's."""
    seen: set[int] = set()
    for batch in batches:
        for text in batch.column(0):
            hashes = shingles(text.as_py(), words_per_shingle, seed)
            node = node_of(hashes)
            if len(hashes) and node not in seen:
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(node)
                yield hashes


def _frequent(docs: DataFrame, words_per_shingle: int, seed: int) -> np.ndarray:
    """A level for each slot of hashes: the logarithm of how often the most frequent shingle there was met, 0 if all are rare.

    It only orders shingles: any table gives the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["key", "n"])

        held, total = [], 0
        for hashes in _new_sets(batches, words_per_shingle, seed):
            held.append(hashes)
            total += len(hashes)
            if total >= 1 << 21:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    often = docs.select("text").mapInArrow(common.released(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    slots = often.groupBy(F.col("key").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.max(F.floor(F.log2("n"))).alias("level")).toArrow()
    levels = np.zeros(SLOTS, dtype=np.uint8)
    levels[slots["slot"].to_numpy()] = slots["level"].to_numpy()
    return levels


def _prefixes(docs: DataFrame, levels: np.ndarray, similarity: float, words_per_shingle: int, seed: int) -> DataFrame:
    """key, node, place: each set under its first shingles and their places, where another set is under the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            key, size = np.concatenate(keys), [len(k) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(np.array(nodes, dtype=np.uint64).view(np.int64), size)), pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in size]))], names=["key", "node", "place"])

        keys, nodes, total = [], [], 0
        for hashes in _new_sets(batches, words_per_shingle, seed):
            order = np.argsort(levels[hashes & np.uint64(SLOTS - 1)], kind="stable")  # equal levels stay in the order of hashes
            keys.append(hashes[order[: len(hashes) - ceil(similarity * len(hashes) - 1e-6) + 1]])
            nodes.append(node_of(hashes))
            total += len(keys[-1])
            if total >= 100_000:
                yield flush()
                keys, nodes, total = [], [], 0
        if keys:
            yield flush()

    def shared(key: np.ndarray, node: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node, place = key[first], node[first], place[first]
        same = key[1:] == key[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep]), pa.array(place[keep])], names=["key", "node", "place"])

    filed = docs.select("text").mapInArrow(common.released(run), "key bigint, node bigint, place int")
    dealt = filed.repartition(common.parallelism(docs.sparkSession), "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(common.released(lambda batches: by_key(batches, shared)), "key bigint, node bigint, place int")


def _most(similarity: float) -> float:
    """Elements that similar sets differ in at most, as a share of their sizes."""
    return (1 - similarity) / (1 + similarity)


def crossing(key: np.ndarray, node: np.ndarray, place: np.ndarray, root: np.ndarray, size: np.ndarray, parity: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of nodes under one key, of different roots, that may be as similar as asked; rows come sorted by key.

    A similar pair goes on under its first common shingle at least: there, what follows in either set bounds what is common.
    """
    most, found = _most(similarity), [np.zeros((0, 2), dtype=np.int64)]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        some = root[i] != root[j]
        i, j = i[some], j[some]
        common_most = np.minimum(size[i] - place[i], size[j] - place[j])
        some = common_most >= similarity / (1 + similarity) * (size[i] + size[j]) - 1e-6
        i, j = i[some], j[some]
        differ = np.maximum(np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64), np.abs(size[i] - size[j]))
        some = differ <= (size[i] + size[j]) * most + 1e-6
        pair = np.stack([node[i[some]], node[j[some]]], axis=1)
        pair.sort(axis=1)
        found.append(np.unique(pair, axis=0))

    cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    count = np.diff(cut)
    of = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero((count <= 64)[of])
    for d in range(1, 64):
        at = at[at + d < len(key)]
        at = at[of[at] == of[at + d]]
        if not len(at):
            break
        add(at, at + d)
    for g in np.flatnonzero(count > 64).tolist():
        # rows of the largest component come last and are not compared with each other
        rows = np.arange(cut[g], cut[g + 1])
        _, inverse, n = np.unique(root[rows], return_inverse=True, return_counts=True)
        rows = rows[np.argsort(inverse == n.argmax(), kind="stable")]
        for k in range(len(rows) - int(n.max())):
            add(np.full(len(rows) - k - 1, rows[k]), rows[k + 1 :])
    return np.unique(np.concatenate(found), axis=0)


def _missed(docs: DataFrame, filed: DataFrame, rooted: DataFrame, similarity: float, words_per_shingle: int, seed: int, broadcast_rows: int) -> DataFrame:
    """a, b: all links between different components so far (node, root; nodes that are not in it are alone)."""
    levels = _frequent(docs, words_per_shingle, seed)
    shared = common.materialise(_prefixes(docs, levels, similarity, words_per_shingle, seed).coalesce(common.tasks(docs)), "shared")
    known = filed.select("node", "size", *PARITIES).dropDuplicates(["node"]).join(rooted, "node", "left")
    known = known.select("node", F.coalesce("root", "node").alias("root"), "size", *PARITIES)
    met = shared.join(known, "node").select("key", "node", "place", "root", "size", *PARITIES)
    met = met.repartition(common.parallelism(docs.sparkSession), "key").sortWithinPartitions("key", "node")

    def flush(key, node, place, root, size, *parity) -> pa.RecordBatch:
        pairs = crossing(key, node, place, root, size, np.stack(parity, axis=1).view(np.uint64), similarity)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    pairs = met.mapInArrow(common.released(lambda batches: by_key(batches, flush)), "a bigint, b bigint").distinct()
    side = lambda c: filed.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("wide").alias(f"w{c}")).dropDuplicates([c])
    differ = F.expr("aggregate(zip_with(wa, wb, (x, y) -> bit_count(x ^ y)), 0, (t, v) -> t + v)")
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(differ <= (F.col("na") + F.col("nb")) * _most(similarity) + 1e-6)
    pairs = common.materialise(pairs.select("a", "b").coalesce(common.tasks(docs)), "crossing")
    return _edges(docs, filed, pairs, similarity, words_per_shingle, seed, broadcast_rows)


def similar_texts(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5, recall: float = 0.99, seed: int = 42, broadcast_rows: int = 50_000) -> DataFrame:
    """doc_id, component_id: the least doc_id reachable over texts of at least ``similarity`` (Jaccard, of shingle sets).

    ``recall`` is of the links that blocks find; ``_missed`` finds the others.
    """
    tasks = common.tasks(docs)
    size, blocks, within = block_plan(docs.count(), similarity, recall)
    filed = common.materialise(_filed(docs, words_per_shingle, seed, size, blocks).coalesce(tasks), "prints")
    pairs = common.materialise(_candidates(filed.select("node", "x", "y", "keys").dropDuplicates(["node"]), within).coalesce(tasks), "candidates")
    rooted = common.materialise(components(_edges(docs, filed, pairs, similarity, words_per_shingle, seed), tasks).coalesce(tasks), "rooted")
    more = _missed(docs, filed, rooted, similarity, words_per_shingle, seed, broadcast_rows)
    edges = rooted.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return _named(filed.select("doc_id", "node"), edges, "node", tasks).select("doc_id", "component_id")


def keep_representatives(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component of ``similar_texts``: one document of each group stays."""
    stay = similar_texts(docs, **parameters).where("doc_id = component_id or component_id is null").select("doc_id").distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi").coalesce(common.tasks(docs))
