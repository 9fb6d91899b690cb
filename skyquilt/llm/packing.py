"""Packing token streams into windows by the sum-of-squares rule.

A level array holds how many open windows there are at each fill. Each document, in order of arrival,
goes into the fill level whose use makes the sum of the squared counts smallest, or into a new window.
Documents longer than a window first fill whole windows. At the end of a task, and whenever too many
windows are open, the open ones are closed: the emptiest are cut up to fill the fullest, and what is
left over becomes windows whose fills are powers of two, which need no padding.

Each task packs the rows of its own partition, so nothing is shuffled and memory is bounded by the open
windows. Sequence ids carry the partition in their high bits.

Defined results: null and empty texts are one id long (the end mark); repeated rows are packed each by
itself; ids pass as they are, null ones too; an empty table gives no pieces; only doc_id and text are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "word_bpe_49k.json"
WINDOW = 2048
END = 1
OPEN_WINDOWS = 4096
MEMO_ENTRIES = 1_200_000
SCHEMA = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: White space as the tokenizer sees it; str.split() would also split at the four separators in ODD.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD = re.compile("[\x1c-\x1f]")
#: Up to here a character has one lower-case form and stands composed, so a text may be lowered before it is split.
BEYOND_LATIN = re.compile("[^\0-\u012f]")
#: Where no other symbol stands next to a full stop or comma, each of them is a token of its own.
CROWDED = re.compile(r"[.,](?:[^\w\s]|_)|(?:[^\w\s]|_)[.,]")
CHUNK_CHARS = 2_000_000


class Codes(dict):
    """Numbers words in order of first sight."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class WordEncoder:
    """Ids of whole texts from the ids of their words: no token of this vocabulary crosses white space.

    The ids of the words met so far lie one after the other in ``flat``; a text is a gather over it.
    The memo is emptied when it is full, which changes no result.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.code = Codes()
        self.flat = np.empty(0, "<u4")
        self.starts = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)

    def learn(self) -> None:
        """Encode the words that got a number since the last call."""
        new, self.code.new = self.code.new, []
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)] if new else []
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum()))])

    @staticmethod
    def words(text: str) -> list[str]:
        if ODD.search(text):
            return [w for w in SPACES.split(text) if w]
        if BEYOND_LATIN.search(text):
            return text.split()
        low = text.lower()
        return (low if CROWDED.search(low) else low.replace(".", " . ").replace(",", " , ")).split()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, with the end mark."""
        if len(self.code) > MEMO_ENTRIES:
            self.forget()
        number = self.code.__getitem__
        numbered = []
        for text in texts:
            words = self.words(text)
            numbered.append(np.fromiter(map(number, words), np.int64, len(words)))
        self.learn()
        for codes in numbered:
            sizes = self.sizes[codes]
            ends = np.cumsum(sizes)
            n = int(ends[-1]) if len(ends) else 0
            ids = np.empty(n + 1, "<u4")
            ids[:n] = self.flat[np.repeat(self.starts[codes] - ends + sizes, sizes) + np.arange(n)]
            ids[n] = END
            yield ids


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Packer:
    """Sum-of-squares packing of one task's rows."""

    def __init__(self, window: int, first_id: int, most_open: int = OPEN_WINDOWS):
        self.window, self.next_id, self.most_open = window, first_id, most_open
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        """A finished window; its pieces are (document, start, ids, document's length)."""
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, window = len(ids), self.window
        whole = total - total % window
        for start in range(0, whole, window):
            self.emit([(doc, start, ids[start : start + window], total)])
        if whole < total:
            self.place((doc, whole, ids[whole:], total))
            if self.levels.sum() > self.most_open:
                self.close()

    def place(self, piece: tuple) -> None:
        size, n = len(piece[2]), self.levels
        fits = n[: self.window - size + 1]
        # Change of the sum of squares: level h loses a window, h + size gains one; a full window is not counted.
        gain = 2 * (n[size:] - fits) + 2
        gain[-1] = 1 - 2 * fits[-1]
        gain = np.where(fits > 0, gain, np.iinfo(np.int64).max)
        gain[0] = 2 * n[size] + 1
        best = len(gain) - 1 - int(np.argmin(gain[::-1]))
        if best == 0:
            pieces = [piece]
        else:
            pieces = self.open[best].pop()
            n[best] -= 1
            pieces.append(piece)
        fill = best + size
        if fill == self.window:
            self.emit(pieces)
        else:
            self.open.setdefault(fill, []).append(pieces)
            n[fill] += 1

    def close(self) -> None:
        """Fill the fullest open windows with the pieces of the emptiest; cut the rest at powers of two."""
        waiting = [p for fill in sorted(self.open, reverse=True) for p in self.open[fill]]
        self.open, self.levels[:] = {}, 0
        loose: list[tuple] = []
        low, high = 0, len(waiting) - 1
        while low <= high:
            pieces, low = waiting[low], low + 1
            room = self.window - sum(len(p[2]) for p in pieces)
            while room and (loose or low <= high):
                if not loose:
                    loose, high = waiting[high], high - 1
                doc, start, ids, total = loose.pop()
                pieces.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    loose.append((doc, start + room, ids[room:], total))
                room = self.window - sum(len(p[2]) for p in pieces)
            if room == 0:
                self.emit(pieces)
            else:
                self.emit_powers(pieces)
        if loose:
            self.emit_powers(loose)

    def emit_powers(self, pieces: list[tuple]) -> None:
        left = sum(len(p[2]) for p in pieces)
        queue = pieces[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            taken = []
            while room:
                doc, start, ids, total = queue.pop()
                taken.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    queue.append((doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self.emit(taken)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(documents: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """One row per piece of a document. ``vocabulary``: a name for public_tokenizers.path, or a path."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.format(kind=kind)
    columns = [c.split()[0] for c in schema.split(", ")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = encoder(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)).encode
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        id_type = None

        def done() -> pa.RecordBatch:
            rows = packer.take()
            kinds = [id_type, *[pa.int64()] * (len(columns) - 1)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], columns)

        for batch in batches:
            id_type = batch.column("doc_id").type
            ids, lengths = batch.column("doc_id").to_pylist(), pc.utf8_length(batch.column("text")).to_numpy()
            chunks = np.cumsum(lengths, dtype=np.int64) // CHUNK_CHARS
            bounds = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(ids)]
            for at, end in zip(bounds, bounds[1:]):
                for doc, tokens in zip(ids[at:end], encode(batch.column("text").slice(at, end - at).to_pylist())):
                    packer.add(doc, tokens)
                yield done()
        packer.close()
        if id_type is not None:
            yield done()

    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(packed, schema)


def query(spark, sf_dir):
    """op3: the whole of documents packed into sequences of 2048."""
    return pack(table(spark, sf_dir, "documents"))
