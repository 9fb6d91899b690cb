"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints of 64 bits that differ in at most three bits differ, outside one block of bits that holds
at least one of those, in at most two. So, for each of BLOCKS blocks, every distinct fingerprint emits all
variants of its bits outside the block within half of that radius (itself and every single flip); the two
meet in a variant. Variants are dealt out and sorted, fingerprints that collide are deduplicated and
verified, and each collision gives only the links that join what it holds (a spanning forest), not all
pairs. Components follow by alternating large-star and small-star rounds over distinct fingerprints.

Copies share a fingerprint and are reduced to it before any variant is made.

Defined results: null and empty texts have fingerprint zero and link like any other; a text of fewer words
than a shingle is one shingle; repeated rows and equal doc_ids share a component; a null doc_id never names
a component unless nothing else is in it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_spread, table

SHINGLE = 3
RADIUS = 3
BLOCKS = 4
BITS = 64
PAIRS_AT_ONCE = 512
HASHES_AT_ONCE = 1 << 16
ROWS_PER_PART = 500_000
_ONE = np.uint64(1)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = words[at : min(n, at + HASHES_AT_ONCE) + shingle - 1]
        grams = map(b" ".join, zip(*[part[i:] for i in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, as it was given, and fp (signed long) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([simhash(t.as_py(), shingle) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], ["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(hashed, f"doc_id {kind}, fp long")


def _masks(blocks: int) -> list[np.uint64]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [np.uint64(((1 << (hi - lo)) - 1) << lo) for lo, hi in zip(edges, edges[1:])]


def variants(fps: np.ndarray, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block number, variant and fingerprint: each row of the ball of radius one outside each block."""
    numbers, keys, owners = [], [], []
    for b, mask in enumerate(_masks(blocks)):
        outside = [np.uint64(0)] + [_ONE << np.uint64(i) for i in range(BITS) if not int(mask) >> i & 1]
        ball = (fps & ~mask)[:, None] ^ np.array(outside, np.uint64)[None, :]
        keys.append(ball.ravel())
        owners.append(np.repeat(fps, len(outside)))
        numbers.append(np.full(ball.size, b, np.int8))
    return np.concatenate(numbers), np.concatenate(keys), np.concatenate(owners)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component of each of n nodes under the links a-b, as its smallest node."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _close_pairs(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all pairs within the radius do. fps: distinct, ascending."""
    n = len(fps)
    if n <= PAIRS_AT_ONCE:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        a, b = np.nonzero(np.triu(near, 1))
        return a, b
    # Many: meet in the middle over the bits in which they differ at all, a few fingerprints at a time.
    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    single = np.array([1 << i for i in range(BITS) if differ >> i & 1], np.uint64)
    half = np.concatenate([[np.uint64(0)], single])
    order = np.argsort(np.concatenate([fps ^ s for s in half]), kind="stable")
    keys = np.concatenate([fps ^ s for s in half])[order]
    owner = np.tile(np.arange(n), len(half))[order]
    a_all, b_all = [], []
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    run = np.repeat(owner[heads], np.diff(np.concatenate([heads, [len(keys)]])))
    a_all.append(run[run != owner])  # both within one of the key, so within two of each other
    b_all.append(owner[run != owner])
    if radius >= 3:
        pairs = [x ^ y for i, x in enumerate(single) for y in single[:i]]
        for flip in pairs:
            at = np.searchsorted(keys, fps ^ flip)
            at[at == len(keys)] = 0
            hit = keys[at] == fps ^ flip
            a_all.append(np.flatnonzero(hit))  # within two and one of the key, so within three
            b_all.append(run[at[hit]])
    a, b = np.concatenate(a_all), np.concatenate(b_all)
    return a[a != b], b[a != b]


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For a collision of distinct fingerprints: (member, smallest member of its component) where they differ."""
    fps = np.sort(fps)
    a, b = _close_pairs(fps, radius)
    root = _roots(len(fps), a, b)
    moved = root != np.arange(len(fps))
    return np.stack([fps[moved], fps[root[moved]]])


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect what lies within the radius."""
    if radius > 3:
        raise ValueError("half of a radius over 3 is more than single flips")

    def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 2048):
                b, key, fp = variants(every[at : at + 2048], blocks)
                # The block number goes into bits of its own block, which are clear in the variant.
                first = np.array([BITS * i // blocks for i in range(blocks)], np.uint64)[b]
                yield pa.record_batch({"variant": (key | (b.astype(np.uint64) + _ONE) << first).view(np.int64), "fp": fp.view(np.int64)})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = owners = np.empty(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            owners = np.concatenate([owners, batch.column(1).to_numpy()])
            last = np.searchsorted(keys, keys[-1]) if len(keys) else 0
            yield _linked(keys[:last], owners[:last], radius)
            keys, owners = keys[last:], owners[last:]
        yield _linked(keys, owners, radius)

    emitted = distinct.select("fp").mapInArrow(ball, "variant long, fp long")
    dealt = emitted.repartition("variant").sortWithinPartitions("variant")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def _linked(keys: np.ndarray, owners: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links of all collisions in sorted keys."""
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.concatenate([heads, [len(keys)]]))
    found = []
    two = heads[sizes == 2]
    if len(two):
        x, y = owners[two].view(np.uint64), owners[two + 1].view(np.uint64)
        near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
        found.append(np.stack([np.maximum(x, y)[near], np.minimum(x, y)[near]]))
    for at, size in zip(heads[sizes > 2], sizes[sizes > 2]):
        found.append(spanning_links(np.unique(owners[at : at + size].view(np.uint64)), radius))
    a, b = np.unique(np.concatenate(found, axis=1), axis=1) if found else (np.empty(0, np.uint64), np.empty(0, np.uint64))
    return pa.record_batch({"a": a.view(np.int64), "b": b.view(np.int64)})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node it reaches.

    Large-star and small-star rounds: the number of rounds grows with the logarithm of the longest chain, and
    no node gathers its neighbours; each round is a minimum by node, then a join. Ends when nothing moves.
    Links never grow in number, so each round is written in parts of about ROWS_PER_PART links.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), narrow=True)
    mark = F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = edges.agg(*mark).first()
    while True:
        for large in (True, False):
            around = edges.select("a", "b") if not large else edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            joined = around.join(low, "a")
            if large:
                moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            else:
                moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
            edges = moved.filter("a <> b").distinct()
        edges = cut(edges.coalesce(1 + before[0] // ROWS_PER_PART))
        after = edges.agg(*mark).first()
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = after


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Copies of one fingerprint may be a third of all rows; ``join_spread`` keeps them out of one task.
    """
    hashed = cut(fingerprints(documents, shingle))
    least = cut(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = components(links(least, radius, blocks))
    named = member.join(least, member["node"] == least["fp"]).select("fp", "root", "least")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = named.join(lowest, "root").select("fp", "component_id")
    every = least.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return join_spread(hashed, every, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir):
    """op5: near-duplicate components of the whole of documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
