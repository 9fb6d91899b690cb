"""Substring dedup by fixed-block anchors: words in windows of WINDOW words that stand earlier in the corpus go.

A block is BLOCK words at a multiple of BLOCK of its document, so every window holds a whole block, and each window
belongs to the first one in it. The blocks are the index; every rolling window of BLOCK words probes it, and a block
that some other place holds too is an anchor. Around anchors only, windows are compared whole (128 bits), each place of
a corpus-wide repeat against its first one, and covered runs grow to the maximal exact repeats.

Documents lie in chunks of about CHUNK_WORDS words, written once and compressed; a document lies in one chunk. A chunk
sends each different hash once, packed with its neighbours of the hash range, so neither a text with thousands of
copies nor a passage that all documents share makes a hot group: a reducer gets at most one entry a chunk for it, and
it says which entries meet, never pairs. The number of hash ranges follows the number of words.

Defined results: null and empty texts have no words and lose none. Of rows with equal doc_id the one with the smaller
hash of its words is the earlier, of equal rows any one; null ids come last. Repeated rows give repeated rows, an empty
table gives an empty result. A document of any length is judged whole, by the task that holds its chunk. Only the id and
the text are read. Ids that are not whole numbers are put in order first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

WINDOW = 20
BLOCK = 10
CHUNK_WORDS = 1 << 20
#: Hashes that one reducer takes in.
PROBES, WINDOWS = 1 << 22, 1 << 21
MIX = np.uint64(0x9E3779B97F4A7C15)
SPIN = np.uint64(0xC2B2AE3D27D4EB4F)


def squeezed(values: np.ndarray) -> bytes:
    """An array as compressed bytes, its length and kind first."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes() if values.size else b""
    return values.dtype.str.encode() + b";" + str(values.size).encode() + b";" + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unsqueezed(data: bytes) -> np.ndarray:
    kind, size, rest = data.split(b";", 2)
    kind, size = np.dtype(kind.decode()), int(size)
    if not size:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(rest, size * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, size).T).view(kind).reshape(-1)


def scattered(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, well mixed, one to one; changes its argument."""
    for shift, factor in ((30, MIX), (27, SPIN)):
        x ^= x >> np.uint64(shift)
        x *= factor
    x ^= x >> np.uint64(31)
    return x


#: A number for each of two lanes, place in a word and byte; beyond SPAN places they are used again, times an odd number.
SPAN = 64
RANDOM = scattered(np.arange(1, 2 * SPAN * 256 + 1, dtype=np.uint64) * MIX).reshape(2, -1)


class Chunk:
    """The documents of a chunk: hashes of the words one after another, and where each document starts."""

    def __init__(self, texts: bytes, size: int):
        whole = pa.decompress(texts, size, codec="zstd", asbytes=True) if size else b""
        self.lines = whole.split(b"\n")
        raw = np.frombuffer(whole + b"\n", np.uint8)
        ends = np.flatnonzero((raw == 32) | (raw == 10)) + 1  # a word and the mark after it; the mark alone is an empty line
        begins = np.concatenate([[0], ends[:-1]])
        last = raw[ends - 1] == 10
        real = ends - begins > 1
        self.owner = (np.cumsum(last) - last)[real]
        self.lengths = np.bincount(self.owner, minlength=len(self.lines))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.place = np.arange(len(self.owner)) - self.starts[:-1][self.owner]
        # a word's hash: a random number for each byte at its place in the word, added up; two lanes of 64 bits
        if not real.any():
            self.words = np.zeros((2, 0), np.uint64)
            return
        place = np.arange(len(raw), dtype=np.int32) - np.repeat(begins.astype(np.int32), ends - begins)
        far = np.flatnonzero(place >= SPAN)
        cell = (place % SPAN << 8) + raw
        lanes = []
        for lane in range(2):
            value = RANDOM[lane][cell]
            value[far] *= (place[far] // SPAN * 2 + 1).astype(np.uint64)
            value[ends - 1] = 0
            lanes.append(scattered(np.add.reduceat(value, begins[real])))
        self.words = np.stack(lanes)

    def rolling(self, size: int, lane: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the ``size`` words from each place in ``at``, else from every place that many words from the end of all."""
        words = self.words[lane]
        n = max(0, len(words) - size + 1)
        out = np.full(n if at is None else len(at), size + lane, np.uint64)
        for k in range(size):
            out ^= words[k : k + n] if at is None else words[at + k]
            out *= MIX
            out ^= out >> np.uint64(29)
        out *= SPIN
        return out ^ (out >> np.uint64(32))

    def inside(self, size: int) -> np.ndarray:
        """Which places start ``size`` words of one document."""
        n = max(0, len(self.owner) - size + 1)
        return self.place[:n] + size <= self.lengths[self.owner[:n]]

    def names(self, bits: int, at: np.ndarray | None = None) -> np.ndarray:
        """Names of blocks for 2 ** ``bits`` hash ranges: the range, and 32 bits in it. Two blocks that share a name only make one more anchor to compare."""
        return self.rolling(BLOCK, 0, at) >> np.uint64(32 - bits)

    def probes(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different names of all rolling blocks in order, which of them stand twice, and which are blocks of the index."""
        held = self.inside(BLOCK)
        names, aligned = self.names(bits)[held], self.place[: len(held)][held] % BLOCK == 0
        order = np.argsort(names, kind="stable")
        sort = names[order]
        new = np.concatenate([[True], sort[1:] != sort[:-1]]) if len(sort) else np.zeros(0, bool)
        firsts = np.flatnonzero(new)
        counts = np.diff(np.append(firsts, len(sort)))
        return sort[firsts], counts > 1, np.logical_or.reduceat(aligned[order], firsts) if len(firsts) else np.zeros(0, bool)

    def windows(self, bits: int, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows whose first block is an anchor."""
        starts = np.flatnonzero(self.inside(WINDOW))
        blocks = np.flatnonzero(self.inside(BLOCK) & (self.place[: max(0, len(self.place) - BLOCK + 1)] % BLOCK == 0))
        hit = np.zeros(len(self.place), bool)
        hit[blocks] = np.isin(self.names(bits, blocks), anchors)
        return starts[hit[starts + (-self.place[starts]) % BLOCK]]


class Windows:
    """The compared windows of a chunk: different keys in order of hash, the first place of each, and the key of each window."""

    def __init__(self, row: dict, bits: int):
        self.chunk = chunk = Chunk(row["texts"], row["size"])
        anchors = [np.uint64(a["range"] << 32) + unsqueezed(a["anchors"]).astype(np.uint64) for a in row["anchors"] or []]
        starts = chunk.windows(bits, np.concatenate(anchors)) if anchors else np.zeros(0, np.int64)
        self.missing = np.array([r is None for r in row["ranks"]], bool)
        self.ranks = np.array([r or 0 for r in row["ranks"]], np.int64)
        self.digests = np.array(row["digests"], np.int64)
        turn = np.empty(len(self.ranks), np.int64)
        turn[np.lexsort((self.digests, self.ranks, self.missing))] = np.arange(len(turn))
        high, low = chunk.rolling(WINDOW, 0, starts), chunk.rolling(WINDOW, 1, starts)
        order = np.lexsort((chunk.place[starts], turn[chunk.owner[starts]], low, high))
        self.starts, high, low = starts[order], high[order], low[order]
        self.new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) if len(order) else np.zeros(0, bool)
        self.high, self.low, self.first = high[self.new], low[self.new], self.starts[self.new]

    def repeated(self, later: np.ndarray) -> np.ndarray:
        """Which words of the chunk lie in a window that stands earlier; ``later``: keys whose first place is elsewhere."""
        gone = self.starts[~self.new | later[np.cumsum(self.new) - 1]] if len(self.starts) else self.starts
        edge = np.zeros(len(self.chunk.owner) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WINDOW, -1)
        return np.cumsum(edge[:-1]) > 0


def ordered_ids(documents: DataFrame) -> DataFrame:
    """``__doc`` (the id), ``__rank`` (a long in its order, null for null) and ``__text``."""
    rows = documents.select(F.col("__doc"), F.col("__text"))
    if documents.schema["__doc"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return rows.withColumn("__rank", F.col("__doc").cast("long"))
    ranks = cut(rows.select("__doc").distinct().filter(F.col("__doc").isNotNull()).orderBy("__doc").withColumn("__rank", F.monotonically_increasing_id()))
    return rows.join(ranks, "__doc", "left")


def chunks_of(documents: DataFrame, chunk_words: int) -> DataFrame:
    """chunk, n_words, size, texts (compressed), ids, ranks and digests of the documents in it."""
    kind = documents.schema["__doc"].dataType.simpleString()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ranks, digests, lines, words, schema = [], [], [], [], 0, None

        def full() -> pa.RecordBatch:
            raw = b"\n".join(lines)
            columns = [[words], [len(raw)], [pa.compress(raw, codec="zstd", asbytes=True)], [ids], [ranks], [digests]]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(schema.field("__doc").type), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["n_words", "size", "texts", "ids", "ranks", "digests"])

        for batch in batches:
            schema = batch.schema
            for doc, rank, text in zip(*(batch.column(c).to_pylist() for c in ("__doc", "__rank", "__text"))):
                found = (text or b"").split()
                line = b" ".join(found)
                ids.append(doc)
                ranks.append(rank)
                digests.append(int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True))
                lines.append(line)
                words += len(found)
                if words >= chunk_words or len(lines) >= 1 << 16:
                    yield full()
                    ids, ranks, digests, lines, words = [], [], [], [], 0
        if lines:
            yield full()

    rows = ordered_ids(documents).withColumn("__text", F.col("__text").cast("binary"))
    shape = f"n_words long, size long, texts binary, ids array<{kind}>, ranks array<long>, digests array<long>"
    return cut(rows.mapInArrow(gathered, shape).withColumn("chunk", F.monotonically_increasing_id()))


def power(total: int, each: int) -> int:
    """How many bits number the hash ranges of ``total`` entries, about ``each`` in one; 20 at most, since a row a chunk and range is needed."""
    return min(20, max(0, -(-total // each) - 1).bit_length())


def by_range(numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal range numbers."""
    edges = np.flatnonzero(np.diff(numbers)) + 1
    for a, b in zip([0, *edges], [*edges, len(numbers)]):
        if a < b:
            yield int(numbers[a]), slice(int(a), int(b))


def batch_of(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def anchors_of(chunks: DataFrame, bits: int) -> DataFrame:
    """chunk, range, ``anchors`` (packed names of its blocks that stand elsewhere too) and their number, a row for each range that has some."""
    fields = [("range", pa.int32()), ("chunk", pa.int64()), ("gaps", pa.binary()), ("twice", pa.binary()), ("index", pa.binary())]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, twice, index = Chunk(row["texts"], row["size"]).probes(bits)
                low = names.astype(np.uint32)
                yield batch_of(
                    [(r, row["chunk"], squeezed(np.diff(low[p], prepend=np.uint32(0))), squeezed(np.packbits(twice[p])), squeezed(np.packbits(index[p]))) for r, p in by_range(names >> np.uint64(32))],
                    fields,
                )

    def met(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        lows = [np.cumsum(unsqueezed(x["gaps"]), dtype=np.uint32) for x in rows]
        names = np.concatenate(lows)
        twice, index = (np.concatenate([np.unpackbits(unsqueezed(x[f]), count=len(v)).astype(bool) for x, v in zip(rows, lows)]) for f in ("twice", "index"))
        order = np.argsort(names, kind="stable")
        equal = names[order][1:] == names[order][:-1]
        shared = twice
        shared[order[1:][equal]] = True
        shared[order[:-1][equal]] = True
        shared &= index
        parts = np.split(shared, np.cumsum([len(v) for v in lows])[:-1])
        out = [(x["chunk"], x["range"], squeezed(v[mine]), int(mine.sum())) for x, v, mine in zip(rows, lows, parts) if mine.any()]
        return pa.Table.from_batches([batch_of(out, [("chunk", pa.int64()), ("range", pa.int32()), ("anchors", pa.binary()), ("n", pa.int64())])])

    packed = chunks.filter(F.col("n_words") >= BLOCK).select("chunk", "texts", "size").mapInArrow(sent, "range int, chunk long, gaps binary, twice binary, index binary")
    return packed.groupBy("range").applyInArrow(met, "chunk long, range int, anchors binary, n long")


def later_windows(chunks: DataFrame, bits: int, spread: int) -> DataFrame:
    """chunk, range and ``later``: which of the keys that a chunk compares in a range stand earlier in another chunk."""
    kinds = [("range", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("missing", pa.binary()), ("ranks", pa.binary()), ("digests", pa.binary())]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w, out = Windows(row, bits), []
                for r, p in by_range(range_of(w.high, spread)):
                    used, docs = np.unique(w.chunk.owner[w.first[p]], return_inverse=True)
                    keys = np.stack([w.high[p], w.low[p]], axis=1).tobytes()
                    at = w.chunk.place[w.first[p]].astype(np.uint32)
                    out.append((r, row["chunk"], keys, squeezed(docs.astype(np.uint32)), squeezed(at), squeezed(np.packbits(w.missing[used])), squeezed(w.ranks[used]), squeezed(w.digests[used])))
                yield batch_of(out, kinds)

    def met(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [np.frombuffer(x["keys"], np.uint64).reshape(-1, 2) for x in rows]
        sizes = [len(k) for k in keys]
        high, low = np.concatenate(keys).T
        order = np.argsort(high, kind="stable")
        equal = high[order][1:] == high[order][:-1]
        some = np.zeros(len(high), bool)
        some[order[1:][equal]] = True
        some[order[:-1][equal]] = True
        columns = {c: [] for c in ("missing", "ranks", "digests")}
        for x in rows:
            docs, ranks = unsqueezed(x["docs"]), unsqueezed(x["ranks"])
            columns["missing"].append(np.unpackbits(unsqueezed(x["missing"]), count=len(ranks))[docs])
            columns["ranks"].append(ranks[docs])
            columns["digests"].append(unsqueezed(x["digests"])[docs])
        missing, ranks, digests = (np.concatenate(c)[some] for c in columns.values())
        places = np.concatenate([unsqueezed(x["places"]) for x in rows])[some]
        chunk = np.repeat([x["chunk"] for x in rows], sizes)[some]
        high, low = high[some], low[some]
        order = np.lexsort((places, chunk, digests, ranks, missing, low, high))
        loses = np.zeros(len(order), bool)
        loses[order[1:]] = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
        later = np.zeros(len(some), bool)
        later[some] = loses
        out = [(x["chunk"], x["range"], squeezed(np.packbits(mine))) for x, mine in zip(rows, np.split(later, np.cumsum(sizes)[:-1])) if mine.any()]
        return pa.Table.from_batches([batch_of(out, [("chunk", pa.int64()), ("range", pa.int32()), ("later", pa.binary())])])

    shape = "range int, chunk long, keys binary, docs binary, places binary, missing binary, ranks binary, digests binary"
    return chunks.select("chunk", "texts", "size", "ranks", "digests", "anchors").mapInArrow(sent, shape).groupBy("range").applyInArrow(met, "chunk long, range int, later binary")


def range_of(high: np.ndarray, spread: int) -> np.ndarray:
    return high >> np.uint64(64 - spread) if spread else np.zeros(len(high), np.uint64)


def without_repeats(documents: DataFrame, id: str = "doc_id", text: str = "text", chunk_words: int = CHUNK_WORDS, probes: int = PROBES, windows: int = WINDOWS) -> DataFrame:
    """id, n_words, n_removed, ``spans`` of removed words (start, end exclusive; numbered from 0) and ``kept``, the other words joined by one space."""
    kind = documents.schema[id].dataType.simpleString()
    chunks = chunks_of(documents.select(F.col(id).alias("__doc"), F.col(text).alias("__text")), chunk_words)
    bits = power(chunks.agg(F.sum("n_words")).first()[0] or 0, probes)
    anchors = cut(anchors_of(chunks, bits))
    spread = power((anchors.agg(F.sum("n")).first()[0] or 0) * BLOCK, windows)
    gathered = anchors.groupBy("chunk").agg(F.collect_list(F.struct("range", "anchors")).alias("anchors"))
    later = cut(later_windows(chunks.join(gathered, "chunk"), bits, spread))
    elsewhere = later.groupBy("chunk").agg(F.collect_list(F.struct("range", "later")).alias("later"))
    fields = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                w = Windows(row, bits)
                marks = {x["range"]: x["later"] for x in row["later"] or []}
                lost = np.zeros(len(w.high), bool)
                for r, p in by_range(range_of(w.high, spread)):
                    if r in marks:
                        lost[p] = np.unpackbits(unsqueezed(marks[r]), count=p.stop - p.start).astype(bool)
                gone, out = w.repeated(lost), []
                lost_by = np.bincount(w.chunk.owner[gone], minlength=len(w.chunk.lines)).tolist()
                for line, n_lost, a, b in zip(w.chunk.lines, lost_by, w.chunk.starts.tolist(), w.chunk.starts[1:].tolist()):
                    if not n_lost:
                        out.append((b - a, 0, [], line))
                        continue
                    edges = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    left = b" ".join(word for word, no in zip(line.split(b" "), gone[a:b].tolist()) if not no)
                    out.append((b - a, n_lost, [{"start": s, "end": e} for s, e in edges.tolist()], left))
                ids = batch.column("ids")[i].values
                yield pa.RecordBatch.from_arrays([ids, *batch_of(out, fields).columns], ["__doc", *(n for n, _ in fields)])

    whole = chunks.select("chunk", "texts", "size", "ids", "ranks", "digests").join(gathered, "chunk", "left").join(elsewhere, "chunk", "left")
    out = whole.mapInArrow(finished, f"__doc {kind}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return out.select(F.col("__doc").alias(id), "n_words", "n_removed", "spans", F.col("kept").cast("string").alias("kept"))


def query(spark, sf_dir):
    """op12: the whole of documents without its repeated passages."""
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
