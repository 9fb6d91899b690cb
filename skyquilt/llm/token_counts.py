"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a text form a doubly linked list; a heap holds the adjacent pairs that the vocabulary can
join, best rank first and leftmost among equals. Each pop joins one pair. The count is the number of
initial symbols less the merges; no identifiers are made.

No piece of the vocabulary crosses from another character into a space mark, and a character that no
piece contains joins nothing, so a text falls into independent chunks there. Counts of short chunks are
kept in a bounded memo per worker; this changes no result.

Defined results: null and empty texts have no bytes and no tokens; repeated rows give repeated rows; ids
pass as they are, null ones too; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
MEMO_ENTRIES = 800_000
MEMO_CHARS = 48


class PairMerger:
    """Counts the tokens that a ranked vocabulary makes of a text."""

    def __init__(self, ranks: dict[str, float]):
        self.ranks = ranks
        self.apart = not any(MARK in piece.lstrip(MARK) for piece in ranks)
        self.known = set().union(*ranks) if ranks else set()
        self.memo: dict[str, int] = {}

    def merge_count(self, chunk: str) -> int:
        """Tokens of one chunk: initial symbols, a foreign character counting its bytes, less the merges."""
        rank = self.ranks.get
        symbols = list(chunk)
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank(symbols[i] + symbols[i + 1])
            if r is not None:
                heap.append((r, i, symbols[i] + symbols[i + 1]))
        heapify(heap)
        while heap:
            _, i, joined = heappop(heap)
            j = after[i] if symbols[i] else n
            if j >= n or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank(joined + symbols[k])
                if r is not None:
                    heappush(heap, (r, i, joined + symbols[k]))
            h = before[i]
            if h >= 0:
                r = rank(symbols[h] + joined)
                if r is not None:
                    heappush(heap, (r, h, symbols[h] + joined))
        return sum(1 if s in self.ranks else len(s.encode("utf-8", "surrogatepass")) for s in symbols if s)

    def chunk_count(self, chunk: str) -> int:
        got = self.memo.get(chunk)
        if got is None:
            got = self.merge_count(chunk)
            if len(chunk) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[chunk] = got
        return got

    def chunks(self, marked: str) -> list[str]:
        if not self.apart:
            return [marked]
        if "\n" in self.known:
            return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)
        return re.findall(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n", marked)

    def count(self, text: str) -> int:
        """Tokens of a whole text, with the mark that stands before its first word."""
        if not text:
            return 0
        memo, known = self.memo, self.chunk_count
        total = 0
        for chunk in self.chunks(MARK + text.replace(" ", MARK)):
            got = memo.get(chunk)
            total += known(chunk) if got is None else got
        return total


@lru_cache(maxsize=4)
def merger(path: str) -> PairMerger:
    """The merger of a vocabulary file, read once per worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    return PairMerger({model.id_to_piece(i): -model.get_score(i) for i in range(model.vocab_size()) if not special(i)})


def count_tokens(documents: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document. ``model``: a name for public_tokenizers.path, or a path."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        count = merger(model if "/" in model else public_tokenizers.path(model)).count
        for batch in batches:
            tokens = pa.array([count(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), tokens], ["doc_id", "n_bytes", "n_tokens"])

    whole = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir):
    """op2: token counts of the whole of documents."""
    return count_tokens(table(spark, sf_dir, "documents"))
