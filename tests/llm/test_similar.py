"""Near-duplicates by similarity against brute force."""

import random

import numpy as np

from skyquilt.llm import similar


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_groups(texts):
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(texts):
        for j in range(i):
            if jaccard(x, texts[j]) >= 0.8:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def edited(words, changes, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def test_pairs_at_and_above_the_similarity_are_found(spark):
    """Recall by similarity of isolated pairs, and no pair below it."""
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(600):
        words = [f"v{rng.randrange(5000)}" for _ in range(200)]
        other = edited(words, 1 + k % 9, rng)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, other)]
        want[k] = jaccard(" ".join(words), other)
    kept = {r.doc_id for r in similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * k for k in want} <= kept
    found = {k: 2 * k + 1 not in kept for k in want}
    assert not any(found[k] for k in want if want[k] < 0.8)
    share = lambda low, high: np.mean([found[k] for k in want if low <= want[k] < high])
    assert share(0.8, 0.83) >= 0.9 and share(0.8, 0.85) >= 0.9 and share(0.85, 0.9) >= 0.95 and share(0.9, 1.01) >= 0.98


def test_blocks_grow_with_the_rows():
    assert similar.shape(0)[0] == similar.LEAST_BITS
    for rows in (0, 10**7, 10**9, 10**10, 10**12):
        bits, number = similar.shape(rows)
        assert 2**bits > rows and 64 + bits * number <= 64 * len(similar._SEEDS)


def test_links_of_one_text_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(similar, "HOT", 4)
    monkeypatch.setattr(similar, "SALTS", 3)
    rng = random.Random(6)
    base = [f"v{k}" for k in range(80)]
    texts = [" ".join(base)] + [edited(base, k % 3, rng) for k in range(1, 40)]
    links = spark.createDataFrame([(k, 0) for k in range(1, 40)] + [(2, 1), (39, 38)], "a long, b long")
    df = spark.createDataFrame(list(enumerate(texts)), "text_hash long, text string")
    want = sorted((r.a, r.b) for r in links.collect() if jaccard(texts[r.a], texts[r.b]) >= 0.8)
    assert len(want) > 20 and sorted(tuple(r) for r in similar.verified(links, df).collect()) == want


def test_whole_table_against_brute_force(spark):
    table = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    roots = brute_groups([r.text for r in table])
    kept = {r.doc_id for r in similar.one_of_each(spark.createDataFrame(table)).collect()}
    groups = {}
    for r, g in zip(table, roots):
        groups.setdefault(g, []).append(r.doc_id)
    least = {min(g) for g in groups.values()}
    assert least <= kept
    texts = {r.doc_id: r.text for r in table}
    for d in kept - least:  # only near the limit may a pair have no block in common
        assert max(jaccard(texts[d], t) for i, t in texts.items() if i != d) < 0.85


def test_each_group_keeps_one_row_whatever_its_doc_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (7, text(2)), (7, text(3)), (7, text(3)), (8, text(3)), (9, text(0)), ((1 << 60) + 1, text(4)), (5, "A b"), (5, "a B"), (1, None), (2, ""), (3, " \n"), (11, "é " * 200_000), (12, "é " * 150_000)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, least string")
    kept = similar.one_of_each(docs)
    got = sorted((str(r.doc_id), (r.text or "").lower()) for r in kept.collect())
    assert got == sorted([("9", text(0)), ("None", text(1)), ("7", text(2)), ("7", text(3)), (str((1 << 60) + 1), text(4)), ("5", "a b"), ("1", ""), ("11", "é " * 200_000)])
    assert kept.columns == docs.columns and similar.one_of_each(docs.limit(0)).count() == 0


def test_forest_spans_and_takes_the_least_differences():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for b in base]))
    a, b = similar.forest(fps)
    assert len(a) == len(fps) - 5 and (np.bitwise_count(fps[a] ^ fps[b]) <= 2).all()


def test_large_buckets_stay_joined(monkeypatch):
    rng = np.random.default_rng(4)
    fps = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)))
    monkeypatch.setattr(similar, "CHUNK", 7)
    a, b = similar.bucket_links(fps)
    assert len(a) == len(fps) - 1 and len(set(a.tolist()) | set(b.tolist())) == len(fps)


def kept_of(spark, texts):
    return {r.doc_id for r in similar.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def least_of_groups(texts):
    least = {}
    for k, g in enumerate(brute_groups(texts)):
        least.setdefault(g, k)
    return set(least.values())


def lone_pairs(rng):
    for k in range(250):
        words = [f"v{rng.randrange(5000)}" for _ in range(100 + k)]
        yield from (" ".join(words), edited(words, 1 + k % 5 * (100 + k) // 200, rng))


def test_no_lone_pair_is_left_out(spark):
    texts = list(lone_pairs(random.Random(11)))
    want = least_of_groups(texts)
    near = [jaccard(*texts[k : k + 2]) for k in range(0, len(texts), 2)]
    assert sum(0.8 <= j < 0.83 for j in near) >= 15 and sum(0.77 < j < 0.8 for j in near) >= 10
    assert kept_of(spark, texts) == want


def family(words, size, changes, rng):
    """Edits of one text, of which some pairs are above the limit and others just below."""
    base = [f"b{rng.random()}" for _ in range(words)]
    return [edited(base, changes(k), rng) for k in range(size)]


def test_no_link_of_a_family_is_left_out(spark):
    """Links that are in no spanning forest of fingerprints count too."""
    rng = random.Random(12)
    texts = [t for f in range(20) for t in family(90 + 5 * f, 24, lambda k: k % 5, rng)]
    texts += ["a b c", "A b C", "a b", "a b c d e f", "a b c d e f g", "", "  ", *family(5, 8, lambda k: k % 2, rng), *family(30, 40, lambda k: k % 2, rng)]
    want = least_of_groups(texts)
    assert len(want) > 80 and kept_of(spark, texts) == want


def test_all_pairs_of_large_buckets_and_frequent_shingles(spark, monkeypatch):
    """Small limits: forests, parts of buckets and shingles too frequent to be counted."""
    for name, value in (("SMALL", 3), ("BLOCK", 5), ("MANY", 8), ("FEW", 0)):
        monkeypatch.setattr(similar, name, value)
    rng = random.Random(13)
    shared = " ".join(f"common{k}" for k in range(60))
    texts = [t for f in range(5) for t in family(100, 40, lambda k: 1 + k % 4, rng)] + [f"{shared} own{k} {shared[: 9 * k]} end{k}" for k in range(60)]
    want = least_of_groups(texts)
    assert 3 < len(want) < 200 and kept_of(spark, texts) == want


def test_the_second_round_compares_what_is_not_joined(spark, monkeypatch):
    """Without any first link all pairs that may be similar enough are found, each group by its own links."""
    monkeypatch.setattr(similar, "SMALL", 2)
    monkeypatch.setattr(similar, "CENTRES", 0)
    monkeypatch.setattr(similar, "bucket_links", lambda fps: (fps[:0], fps[:0]))
    texts = family(100, 60, lambda k: 1 + k % 4, random.Random(14))
    assert kept_of(spark, texts) == least_of_groups(texts)
