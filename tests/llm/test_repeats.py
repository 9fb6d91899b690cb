"""Substring dedup against a brute-force search over all windows, whole tables and planted texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from skyquilt.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(id, n_words, n_removed, kept) for rows (id, text); equal rows in any order."""
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    digest = lambda w: int.from_bytes(hashlib.blake2b(" ".join(w).encode(), digest_size=8).digest(), "little", signed=True)
    docs.sort(key=lambda d: (d[0] is None, d[0] if d[0] is not None else 0, digest(d[1])))
    seen, out = set(), []
    for i, words in docs:
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def key(row):
    return (row[0] is None, str(row[0]), row[1:])


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, m, hashlib.sha256(kept.encode()).hexdigest()) for i, n, m, kept in brute(given)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.query(spark, sf).collect()}
    assert got == want and sum(m for _, m, _ in want.values()) > 1000


def planted(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "ö", "x.", "wort", "17"]) + str(rng.randrange(400))
    passages = [[word() for _ in range(n)] for n in (9, 10, 19, 20, 21, 25, 47, 60)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(0, 40))]
        rows.append((i * 3 % 157, rng.choice([" ", "\t", "\n  ", "\x0b"]).join(words)))
    rows += [(500 + i, "x " * 70) for i in range(4)] + [(600, "la " * 19), (601, "la " * 20), (602, "y z " * 3000)]
    rows += [(700 + i, rows[3][1]) for i in range(30)]  # exact copies
    rows += [(800, None), (801, ""), (802, " \t\n"), (None, rows[5][1]), (None, "one two"), rows[7], rows[7], (rows[9][0], "other words " * 15)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "partitions", "chunk_words", "each"), [(1, 1, 1 << 20, 1 << 22), (1, 7, 300, 256), (2, 23, 50, 64), (3, 3, 5000, 1 << 12)])
def test_planted_passages_at_any_partitioning(spark, seed, partitions, chunk_words, each):
    rows = planted(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    df = df.withColumn("chunk", F.lit(1)).withColumn("__doc", F.lit("x")).withColumn("n_words", F.lit(2))
    out = repeats.without_repeats(df, chunk_words=chunk_words, probes=each, windows=each).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in out], key=key) == sorted(brute(rows), key=key)
    for r in out:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(s.end - s.start >= 20 for s in r.spans)


def test_text_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [("b", text), ("a", text + " end"), ("c", "start " + text), (None, text)]
    got = {r.doc_id: r.n_removed for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": 0, "b": 30, "c": 30, None: 30}
    empty = repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_words", "n_removed", "spans", "kept"]


def test_packing_of_arrays():
    import numpy as np

    for values in (np.arange(0, 90, 7, dtype=np.uint32), np.zeros(0, np.uint8), np.array([-5, 1 << 50], np.int64)):
        assert repeats.unsqueezed(repeats.squeezed(values)).tolist() == values.tolist()
