"""Conversation structure repair with Four-Russians block tables.

The roles of a repaired conversation read ``(s?(ua)+)?``. Each row is one of nine symbols (must go, or initial and
truncation), and the least costs from a place to the end, one for each of four automaton states, form a cost vector.
Less their least entry only a few vectors occur, so a table holds, for each vector and each block of BLOCK symbols,
the vector before the block and the cost gained. A conversation is read block by block from its end by lookup; then
each block is expanded backward from the vector at its right edge, and the edits are read off from the start, the
ASCII-least one among the cheapest at each place, which gives the ASCII-least audit.

Rows of a conversation meet sorted in one task, a stream of one conversation at a time, up to LONG_BYTES of text.
A longer one is cut into ranges of its order: texts, faults and repeats stay in the ranges, and only symbols, one byte
a row, meet for the audit, which is one value with a letter a row anyway. Both ways give the same result.

Defined results: null roles and texts are one space, null turns come first and count in no gap, a null conversation
id is one conversation; rows of equal turn stand by role, then text. A role that begins with none of s, u and a can
only be rerolled or deleted. Repeated rows are repeats like any; a conversation without rows has zeros and empty
texts; an empty table gives an empty result. Only the four columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

BLOCK = 4
LONG_BYTES = 64 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a rerole or an insertion leads to, and what it costs.
TURN, RENAME, ADD, REMOVE = (USER, USER, ASSISTANT, USER), 2, 2, 3
KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
END = (0, 4, 2, 0)
LEGAL = ("su", "ua", "au")
CLOSE = ("", "II", "I", "")
NAMES = ("", "system", "user", "assistant")
GONE, SYMBOLS = 0, 9
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def symbol(initial: str, truncated: bool) -> int:
    """The symbol of a row that may stay."""
    return 1 + 2 * {"s": 0, "u": 1, "a": 2}.get(initial, 3) + truncated


def costs_before(sym: int, after: tuple[int, ...]) -> list[int]:
    """The cost vector before a symbol, from the one after it."""
    out = [REMOVE + c for c in after]
    if sym != GONE:
        initial, extra = divmod(sym - 1, 2)
        for q in range(4):
            out[q] = min(out[q], RENAME + extra + after[TURN[q]])
            if (q, initial) in KEEP:
                out[q] = min(out[q], extra + after[KEEP[q, initial]])
    for _ in range(2):  # insertions lead on to user and assistant in turn
        out = [min(out[q], ADD + out[TURN[q]]) for q in range(4)]
    return out


class BlockTables:
    """Cost vectors, their transitions by symbol and by block, and the edits of a symbol by vector and state."""

    def __init__(self, length: int = BLOCK):
        self.length, self.vectors, ids, steps = length, [END], {END: 0}, []
        for vector in self.vectors:  # grows while it is read
            row = []
            for sym in range(SYMBOLS):
                before = costs_before(sym, vector)
                plain = tuple(c - min(before) for c in before)
                if plain not in ids:
                    ids[plain] = len(self.vectors)
                    self.vectors.append(plain)
                row.append((ids[plain], min(before)))
            steps.append(row)
        self.step = steps
        to, gain = np.array([[s[0] for s in r] for r in steps]), np.array([[s[1] for s in r] for r in steps])
        block, cost = np.arange(len(steps))[:, None], np.zeros((len(steps), 1), dtype=int)
        for _ in range(length):  # one more symbol on the left
            cost = (cost[:, :, None] + gain[block]).transpose(0, 2, 1).reshape(len(steps), -1)
            block = to[block].transpose(0, 2, 1).reshape(len(steps), -1)
        self.block, self.gain = block, cost
        self.edit = [[[self._edit(v, s, q) for q in range(4)] for s in range(SYMBOLS)] for v in range(len(steps))]

    def _edit(self, after: int, sym: int, state: int) -> tuple[str, int]:
        """The ASCII-least of the cheapest letters up to the one that takes the symbol, and the state then."""
        right, left, letters = self.vectors[after], costs_before(sym, self.vectors[after]), ""
        initial, extra = divmod(sym - 1, 2)
        while True:
            if REMOVE + right[state] == left[state]:
                return letters + "D", state
            if ADD + left[TURN[state]] == left[state]:
                letters, state = letters + "I", TURN[state]
            elif sym != GONE and (state, initial) in KEEP and extra + right[KEEP[state, initial]] == left[state]:
                return letters + "K", KEEP[state, initial]
            else:
                return letters + "R", TURN[state]

    def solve(self, symbols: bytes) -> tuple[int, list[str], str]:
        """The least cost, the letters up to each symbol and those after the last."""
        n, cost, at = self.length, 0, 0
        whole = len(symbols) // n
        for sym in reversed(symbols[whole * n :]):
            at, more = self.step[at][sym]
            cost += more
        tail = 0
        codes = np.frombuffer(symbols, np.uint8, whole * n).reshape(whole, n).astype(np.int64) @ (SYMBOLS ** np.arange(n - 1, -1, -1)) if whole else []
        edges = np.zeros(whole + 1, dtype=np.int16)  # the vector at the right edge of each block
        for b in range(whole - 1, -1, -1):
            edges[b] = at
            cost += int(self.gain[at, codes[b]])
            at = int(self.block[at, codes[b]])
        cost += self.vectors[at][START]
        letters, state = [], START
        for b in range(whole + 1):
            part = symbols[b * n : b * n + n]
            rights = [int(edges[b]) if b < whole else tail]
            for sym in reversed(part[1:]):
                rights.append(self.step[rights[-1]][sym][0])
            for sym, right in zip(part, reversed(rights)):
                more, state = self.edit[right][sym][state]
                letters.append(more)
        return cost, letters, CLOSE[state]


@lru_cache(maxsize=4)
def tables(length: int = BLOCK) -> BlockTables:
    """The block tables, built once per worker."""
    return BlockTables(length)


class Piece:
    """Rows of one conversation in order: symbols and what the counts need."""

    def __init__(self):
        self.symbols, self.lines = bytearray(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.least = self.most = None

    def add(self, turn, role: str, text: str, copies: int, seen: set) -> None:
        """A row that stands ``copies`` times; ``seen`` holds the (role, text) of earlier rows."""
        initial = role[:1]
        if not copies:
            return
        self.illegal += copies - 1 + (self.last is not None and self.last + initial not in LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.distinct += self.most is None or turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        bare = text.strip(" \t\n\v\f\r")
        for again in range(copies):
            self.lines.append((role, text))
            if not bare:
                self.blank += 1
                self.symbols.append(GONE)
            elif again or (role, text) in seen:
                self.duplicate += 1
                self.symbols.append(GONE)
                if again:  # the rest are duplicates too
                    more = copies - again - 1
                    self.duplicate += more
                    self.symbols.extend(bytes(more))
                    self.lines.extend([(role, text)] * more)
                    break
            else:
                cut_short = bare[-1] not in ".!?"
                self.truncated += cut_short
                self.symbols.append(symbol(initial, cut_short))
            seen.add((role, text))


def written(lines: list[tuple[str, str]], letters: list[str], close: str, state: int = START) -> tuple[str, int]:
    """The repaired lines, and the state after them."""
    out = []

    def put(how: str, row: tuple[str, str] | None) -> None:
        nonlocal state
        if how in "RI":
            state = TURN[state]
            out.append(f"{NAMES[state]}:{row[1] if how == 'R' else ''}")
        elif how == "K":
            state = KEEP[state, "sua".index(row[0][0])]
            out.append(f"{row[0]}:{row[1]}")

    for row, edits in zip(lines, letters):
        for how in edits:
            put(how, row)
    for how in close:
        put(how, None)
    return "\n".join(out), state


def gap_count(least, most, distinct: int) -> int:
    return 0 if least is None else min(most - least + 1 - distinct, (1 << 63) - 1)


def whole_conversations(rows: DataFrame, conv: str, kind: str) -> DataFrame:
    """Repairs conversations whose rows come sorted, one at a time."""
    names = ["__key", "__conv", "part", "parts", *COUNTS, "audit", "repaired"]
    types = [pa.string(), None, pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.string()]

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, out, held = None, [], 0

        def rows_of() -> Iterator[tuple]:
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field("__conv").type
                yield from zip(*(batch.column(c).to_pylist() for c in ("__key", "__conv", "turn", "role", "text", "copies")))

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t or conv_type) for c, t in zip(zip(*out), types)], names)

        for key, group in groupby(rows_of(), key=lambda r: r[0]):
            piece, seen = Piece(), set()
            for _, conv_id, turn, role, text, copies in group:
                piece.add(turn, role, text, copies, seen)
            cost, letters, close = tables().solve(bytes(piece.symbols))
            text, _ = written(piece.lines, letters, close)
            counts = (gap_count(piece.least, piece.most, piece.distinct), piece.blank, piece.duplicate, piece.truncated, piece.illegal, cost)
            out.append((key, conv_id, 0, 1, *counts, "".join(letters) + close, text))
            held += len(text)
            if len(out) >= 5000 or held > 1 << 24:
                yield flushed()
                out, held = [], 0
        if out:
            yield flushed()

    counts = ", ".join(f"{c} long" for c in COUNTS)
    near = rows.repartition("__key").sortWithinPartitions("__key", "turn", "role", "text")
    return near.mapInArrow(repaired, f"__key string, __conv {kind}, part int, parts int, {counts}, audit string, repaired string")


ORDER = [("turn", "ascending"), ("role", "ascending"), ("text", "ascending")]


def sorted_rows(group: pa.Table) -> Iterator[tuple]:
    order = pc.sort_indices(group, sort_keys=ORDER, null_placement="at_start")
    group = group.take(order)
    return zip(*(group.column(c).to_pylist() for c in ("turn", "role", "text", "copies")))


def long_conversations(rows: DataFrame, conv: str, kind: str, ranges: int) -> DataFrame:
    """Repairs conversations that are too long for one task, a range of their order at a time."""
    once = rows.groupBy("__key", "turn", "role", "text").agg(F.sum("copies").alias("copies"), F.first("__conv").alias("__conv"))
    dealt = once.repartitionByRange(ranges, "__key", "turn", "role", F.substring("text", 1, 256))
    mark = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    pieces = cut(dealt.withColumn("part", F.spark_partition_id()).withColumn("mark", mark))
    there = pieces.filter(F.col("copies") > 0)
    first = there.groupBy("__key", "mark").agg(F.min("part").alias("first"))
    earlier = there.select("__key", "part", "mark").distinct().join(first, ["__key", "mark"]).filter(F.col("first") < F.col("part")).select("__key", "part", "mark").toDF("__key", "part", "mark")

    def coded(key: tuple, group: pa.Table, marks: pa.Table) -> pa.Table:
        gone = set(marks.column("mark").to_pylist())
        known = {(r, t) for r, t, m in zip(*(group.column(c).to_pylist() for c in ("role", "text", "mark"))) if m in gone}
        piece = Piece()
        for row in sorted_rows(group):
            piece.add(*row, known)
        fields = {
            "__key": [group.column("__key")[0].as_py()], "part": [group.column("part")[0].as_py()], "symbols": [bytes(piece.symbols)],
            **{c: [getattr(piece, c)] for c in ("blank", "duplicate", "truncated", "illegal", "distinct", "least", "most", "first", "last")},
        }
        return pa.table(fields, schema=pa.schema(list(zip(fields, [pa.string(), pa.int32(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.string()]))))

    stats = "__key string, part int, symbols binary, blank long, duplicate long, truncated long, illegal long, distinct long, least long, most long, first string, last string"
    codes = pieces.groupBy("__key", "part").cogroup(earlier.groupBy("__key", "part")).applyInArrow(coded, stats)

    def audited(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        cost, letters, close = tables().solve(b"".join(r["symbols"] for r in rows))
        total = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
        last = most = least = None
        distinct = 0
        for r in rows:
            if r["first"] is not None:
                total["illegal"] += last is not None and last + r["first"] not in LEGAL
                last = r["last"]
            if r["most"] is not None:
                distinct += r["distinct"] - (r["least"] == most)
                least, most = r["least"] if least is None else least, r["most"]
        total |= {"gaps": gap_count(least, most, distinct), "cost": cost}
        out, at, state = [], 0, START
        for i, r in enumerate(rows):
            mine = letters[at : at + len(r["symbols"])]
            at += len(mine)
            end = close if i == len(rows) - 1 else ""
            out.append({"__key": r["__key"], "part": r["part"], "edits": mine, "close": end, "state": state, "place": i, "parts": len(rows), **total})
            initials = [s - 1 >> 1 for s in r["symbols"]]
            for initial, edits in zip(initials, mine):
                for how in edits:
                    state = state if how == "D" else KEEP[state, initial] if how == "K" else TURN[state]
        return pa.Table.from_pylist(out, plans_schema)

    plans_schema = pa.schema(
        [("__key", pa.string()), ("part", pa.int32()), ("edits", pa.list_(pa.string())), ("close", pa.string()), ("state", pa.int32()), ("place", pa.int32()), ("parts", pa.int32())]
        + [(c, pa.int64()) for c in COUNTS]
    )
    counts = ", ".join(f"{c} long" for c in COUNTS)
    plans = codes.groupBy("__key").applyInArrow(audited, f"__key string, part int, edits array<string>, close string, state int, place int, parts int, {counts}")

    def finished(group: pa.Table, plan: pa.Table) -> pa.Table:
        p, lines = plan.to_pylist()[0], []
        for _, role, text, copies in sorted_rows(group):
            lines.extend([(role, text)] * copies)
        text, _ = written(lines, p["edits"], p["close"], p["state"])
        out = {"__key": p["__key"], "__conv": group.column("__conv")[0].as_py(), "part": p["place"], "parts": p["parts"], **{c: p[c] for c in COUNTS}, "audit": "".join(p["edits"]) + p["close"], "repaired": text}
        types = [pa.string(), group.schema.field("__conv").type, pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.Table.from_pylist([out], pa.schema(list(zip(out, types))))

    return pieces.groupBy("__key", "part").cogroup(plans.groupBy("__key", "part")).applyInArrow(finished, f"__key string, __conv {kind}, part int, parts int, {counts}, audit string, repaired string")


def repaired_parts(rows: DataFrame, conv: str = "conv_id", long_bytes: int = LONG_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """Repaired conversations in one part, and the parts of longer ones, if there are any; see ``repair``."""
    kind = rows.schema[conv].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    key = F.when(F.col(conv).isNull(), "").otherwise(F.concat(F.lit("="), F.col(conv).cast("string"))).alias("__key")
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    plain = rows.select(key, F.col(conv).alias("__conv"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), copies.alias("copies"))
    size = F.sum(F.col("copies") * (64 + F.octet_length("role") + F.octet_length("text")))
    long = cut(plain.groupBy("__key").agg(size.alias("size")).filter(F.col("size") > long_bytes), narrow=True)
    total = long.agg(F.sum("size")).first()[0]
    named = lambda df: df.select(F.col("__conv").alias(conv), "part", "parts", *COUNTS, "audit", "repaired", "__key")
    if total is None:
        return named(whole_conversations(plain, conv, kind)), None
    apart = long.select("__key")
    near = whole_conversations(plain.join(apart, "__key", "left_anti"), conv, kind)
    far = long_conversations(plain.join(apart, "__key", "left_semi"), conv, kind, int(2 * total // long_bytes) + 1)
    return named(near), named(far)


def repair(rows: DataFrame, conv: str = "conv_id", long_bytes: int = LONG_BYTES) -> DataFrame:
    """Conversations (conv, turn, role, text and, if there, ``copies``: how often a row stands, 0 for a row that is gone) with counts, audit and repaired text.

    One row a conversation; one for each of its ``parts``, in order of ``part``, where it is longer than ``long_bytes``:
    its audit and its text are those of the parts in order, texts that are not empty joined by a newline.
    """
    near, far = repaired_parts(rows, conv, long_bytes)
    return near if far is None else near.unionByName(far)


def digests(near: DataFrame, far: DataFrame | None = None, conv: str = "conv_id") -> DataFrame:
    """One row a conversation with the hash of its repaired text; the parts of a long one stream through one task in order."""
    single = near.select(conv, *COUNTS, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))
    if far is None:
        return single
    kind = near.schema[conv].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((batch.schema, r) for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
        for _, group in groupby(rows, key=lambda x: x[1]["__key"]):
            digest, begun, audit = hashlib.sha256(), False, []
            for schema, r in group:
                if r["repaired"]:
                    digest.update((b"\n" if begun else b"") + r["repaired"].encode("utf-8", "surrogatepass"))
                    begun = True
                audit.append(r["audit"])
            out = {conv: r[conv], **{c: r[c] for c in COUNTS}, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            fields = [schema.field(conv), *[pa.field(c, pa.int64()) for c in COUNTS], pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())]
            yield pa.RecordBatch.from_pylist([out], pa.schema(fields))

    counts = ", ".join(f"{c} long" for c in COUNTS)
    parted = far.repartition("__key").sortWithinPartitions("__key", "part")
    return single.unionByName(parted.mapInArrow(hashed, f"{conv} {kind}, {counts}, audit string, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults of crc32(conv_id:turn) % 20; ``copies`` is 0 where a row is dropped and 2 where it is repeated."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(fault == 4, "user").otherwise(space("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def query(spark, sf_dir):
    """op13: all conversations, damaged and repaired."""
    return digests(*repaired_parts(damaged(table(spark, sf_dir, "conversations"))))
