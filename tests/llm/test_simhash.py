"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import xxhash

from skyquilt.llm import simhash


def brute_hash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    label = {f: f for f in fps}
    distinct = sorted(set(fps))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                label[root(a)] = root(b)
    least = {}
    for d, f in zip(ids, fps):
        least[root(f)] = min(least.get(root(f), d), d)
    return {d: least[root(f)] for d, f in zip(ids, fps)}


def test_whole_table_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    fps = [brute_hash(r.text) for r in table]
    want = brute_components([r.doc_id for r in table], fps)
    got = simhash.query(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {r.doc_id: f"{f:016x}" for r, f in zip(table, fps)}


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "A b", "x"), (4, "a B", "x"), (4, "a B", "x"), (9, "é " * 200_000, "x"), (8, "É " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got[1] == got[2] == ("0" * 16, 1) and got[3] == got[4] and got[3][1] == 3
    assert got[9][0] == f"{brute_hash('é ' * 9):016x}" and got[8][1] == 8
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_connect_planted_clusters(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        seed = rng.getrandbits(64)
        fps.add(seed)
        for _ in range(60):
            seed ^= 1 << rng.randrange(64)
            for b in rng.sample(range(64), rng.randrange(3)):
                seed ^= 1 << b
            fps.add(seed)
    fps = sorted(fps)
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)]
    distinct = spark.createDataFrame(rows, "i long, fp long").repartition(3)
    roots = {r.node: r.root for r in simhash.components(simhash.links(distinct)).collect()}
    got = {}
    for i, fp in rows:
        got.setdefault(roots.get(fp, fp), []).append(i)
    want = {}
    for d, c in brute_components(range(len(fps)), fps).items():
        want.setdefault(c, []).append(d)
    assert sorted(map(tuple, got.values())) == sorted(map(tuple, want.values()))


def test_large_collisions_join_like_all_pairs():
    rng = np.random.default_rng(2)
    for spread in (14, 40):
        fps = np.unique(rng.integers(0, 2**spread, 1500 if spread == 14 else 900, dtype=np.uint64) & np.uint64(0x0F0F0F0FFF))
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
        a, b = np.nonzero(np.triu(near, 1))
        want = simhash._roots(len(fps), a, b)
        x, y = simhash._close_pairs(fps, 3)
        assert (np.bitwise_count(fps[x] ^ fps[y]) <= 3).all()
        assert (simhash._roots(len(fps), x, y) == want).all()


def test_ids_pass_unchanged_beside_a_null(spark):
    docs = spark.createDataFrame([((1 << 53) + 1, "a b c d"), (None, "e f g"), ((1 << 53) + 3, "a b c d")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1 << 53) + 1: (1 << 53) + 1, (1 << 53) + 3: (1 << 53) + 1, None: None}
