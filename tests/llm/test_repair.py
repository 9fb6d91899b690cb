"""Repair against a search over all edits; long conversations by ranges against whole ones."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from skyquilt.llm import repair

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, lines) by keeping the least (cost, audit) of each state, with every edit tried; rows: (role, text, must go, truncated)."""
    best = [{} for _ in range(len(rows) + 1)]
    best[0][""] = (0, "", ())

    def offer(i, state, value):
        if state not in best[i] or value < best[i][state]:
            best[i][state] = value
            return True
        return False

    for i in range(len(rows) + 1):
        again = True
        while again:  # insertions within a place
            again = False
            for state, (cost, audit, lines) in list(best[i].items()):
                for new in "ua":
                    if (state, new) in NEXT:
                        again |= offer(i, new, (cost + 2, audit + "I", (*lines, FULL[new] + ":")))
        if i < len(rows):
            role, text, must, cut = rows[i]
            for state, (cost, audit, lines) in best[i].items():
                offer(i + 1, state, (cost + 3, audit + "D", lines))
                if not must:
                    if (state, role[:1]) in NEXT:
                        offer(i + 1, role[:1], (cost + cut, audit + "K", (*lines, f"{role}:{text}")))
                    for new in "ua":
                        if (state, new) in NEXT:
                            offer(i + 1, new, (cost + 2 + cut, audit + "R", (*lines, f"{FULL[new]}:{text}")))
    return min(best[-1][s] for s in ("", "a") if s in best[-1])


def brute(table):
    """conv_id -> the row that the contract asks for; table: (conv_id, turn, role, text)."""
    found = {}
    for conv, turn, role, text in table:
        rows = found.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in rows if r[0] is not None]
        seen, kinds = set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        judged = []
        for _, role, text in rows:
            bare = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if kind:
                kinds[kind] += 1
            judged.append((role, text, kind in ("blank", "duplicate"), int(kind == "truncated")))
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = cheapest(judged)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *kinds.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(repair.query(spark, sf)) == brute(given)


def odd_rows(seed, n=400):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \t\n", "Is it?", "x" * 5000 + "!", "...", "wait ", "done. \x0b"]
    roles = ["user", "assistant", "system", "tool", "", None, "s", "Übung"]
    rows = []
    for conv in [*range(n // 10), None]:
        for turn in range(rng.randrange(1, 18)):
            turn = None if rng.random() < 0.1 else turn - rng.randrange(3)
            rows.append((conv, turn, rng.choices(roles, [9, 9, 3, 1, 1, 1, 1, 1])[0], rng.choice([None, *texts])))
    rows += [(7, 3, "user", "again and again")] * 300  # copies that one conversation is full of
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "long_bytes"), [(1, 1 << 26), (2, 1500), (3, 4000)])
def test_odd_rows_whole_and_by_ranges(spark, seed, long_bytes):
    rows = odd_rows(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    df = df.withColumn("part", F.lit(1)).withColumn("copies", F.lit(9)).withColumn("__key", F.lit("k"))
    parts = repair.repaired_parts(repair.damaged(df), long_bytes=long_bytes)
    assert result(repair.digests(*parts)) == brute(rows)
    if long_bytes == 1500:  # the conversation of copies is long, most others too
        assert parts[0].count() > 1 and parts[1].filter("parts > 1").count() > 1


def test_every_short_sequence_and_block_lengths():
    rng = random.Random(4)
    names = {1: "system", 3: "user", 5: "assistant", 7: "tool"}
    cases = [[rng.randrange(9) for _ in range(rng.randrange(0, 14))] for _ in range(1500)] + [[a, b, c] for a in range(9) for b in range(9) for c in range(9)]
    for case in cases:
        rows = [("user", "x", True, 0) if s == 0 else (names[s - 1 + s % 2], "x", False, (s - 1) % 2) for s in case]
        want = cheapest(rows)
        for length in (1, 3, 4):
            cost, letters, close = repair.tables(length).solve(bytes(case))
            lines, _ = repair.written([r[:2] for r in rows], letters, close)
            assert (cost, "".join(letters) + close, lines) == (want[0], want[1], "\n".join(want[2])), case


def test_long_rows_of_one_conversation_and_empty_tables(spark):
    text = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}." * (400 if i % 50 == 0 else 1)) for i in range(3000)]
    df = spark.createDataFrame(text, "conv_id long, turn long, role string, text string")
    assert result(repair.digests(*repair.repaired_parts(repair.damaged(df), long_bytes=20_000))) == brute(text)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.digests(*repair.repaired_parts(repair.damaged(empty))).count() == 0
    named = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Hello.")], "conv_id string, turn long, role string, text string")
    assert [r.audit for r in repair.repair(named).collect()] == ["KK"]
