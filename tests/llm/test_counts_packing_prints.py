"""Operators 1 to 4 against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyquilt.llm import fingerprints, mixing, packing, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fingerprint string"
TEXTS = [
    "a b c d e f g h",
    None,
    "",
    "   \n\t ",
    "one",
    "the quick brown fox jumps over the lazy dog " * 30,
    "the quick brown fox jumps over the lazy dog " * 30,
    "x" * 5000,
    "a  b\tc\n<s> ﬁ é  <|endoftext|> İstanbul ΣΑΣ \x1c\x1d q r ▁▁ 😀 é 　z don't I'LL 12345",
    "日本語のテキスト naïve café " * 400,
    "word " * 3000,
    "the quick brown fox jumps over the lazy cat " * 31,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", None if i % 5 == 4 else f"s{i % 3}", 0, "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_token_counts_match_the_library(docs, spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    got = {r.doc_id: r for r in token_counts.count_tokens(docs).collect()}
    for i, text in enumerate(TEXTS):
        row = got[i * 3]
        assert row.n_tokens == len(model.encode(text or "")), text
        assert row.n_bytes == len((text or "").encode())
        assert row.over_limit == (row.n_tokens > 4096)
    whole = {r.doc_id: r.n_tokens for r in token_counts.query(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert whole[r.doc_id] == len(model.encode(r.text))
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def check_packing(rows, ids_of):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return padding


def test_packing_keeps_every_id_once(docs, spark):
    vocabulary = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = {i * 3: vocabulary.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(TEXTS)}
    assert check_packing(packing.pack(docs).collect(), ids) == 0
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    ids = {r.doc_id: vocabulary.encode(r.text, add_special_tokens=False).ids + [1] for r in table}
    assert check_packing(packing.query(spark, "/root/testdata/sf0.001").collect(), ids) == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_packer_minimises_the_sum_of_squares():
    packer = packing.Packer(16, 0)
    rng = np.random.default_rng(3)
    for k in range(400):
        size = int(rng.integers(1, 16))
        counts = packer.levels.copy()

        def after(h):
            n = counts.copy()
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] += 1
            return int((n[1:16] ** 2).sum())

        best = min(after(h) for h in range(0, 16 - size + 1) if h == 0 or counts[h] > 0)
        packer.add(k, np.ones(size, "<u4"))
        assert int((packer.levels[1:16] ** 2).sum()) == best
    packer.close()
    assert sum(r[2] for r in packer.take()) > 0


def test_mixing_against_brute_force(docs):
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    size = {i * 3: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(TEXTS)}
    source = {i * 3: None if i % 5 == 4 else f"s{i % 3}" for i in range(len(TEXTS))}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    total = {s: sum(size[d] for d in size if source[d] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        level = left / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and level * weight[s] > 3 * total[s] + 1e-9}
        if not more:
            break
        capped |= more
    for d, r in got.items():
        want = 3 * total[source[d]] if source[d] in capped else level * weight[source[d]]
        assert abs(r.target - want) < 1e-6 and r.size == size[d] and r.source_size == total[source[d]]
        assert 0 <= r.taken <= 3 * r.size
    for s in names:
        taken = sum(r.taken for d, r in got.items() if source[d] == s)
        assert abs(taken - next(r.target for d, r in got.items() if source[d] == s)) <= 0.5 + 1e-6
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {d: r.taken for d, r in got.items()}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_documents_hold_what_the_mix_takes(docs):
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    held = defaultdict(int)
    for r in out.collect():
        held[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text) and r.size == "clash"
    assert dict(held) == {d: n for d, n in taken.items() if n}


def test_fingerprints(docs, spark):
    got = {r.doc_id: r for r in fingerprints.fingerprint(docs).collect()}
    for i, text in enumerate(TEXTS):
        text, following = text or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[i * 3]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert got[15].fingerprint == got[18].fingerprint and got[15].near_next == 1.0
    assert got[3].fingerprint == "" and got[3].near_next == 1.0
    assert fingerprints.fingerprint(docs.limit(0)).count() == 0
    assert fingerprints.fingerprint(docs.limit(1)).count() == 1


def test_next_document_across_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 7)
    monkeypatch.setattr(fingerprints.id_ranges, "__defaults__", (7,))
    rows = [(i * i, f"text {i}") for i in range(100)] + [(None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.text: r.next_text for r in fingerprints.with_next(docs, {"text": docs["text"]}).collect()}
    order = ["none"] + [f"text {i}" for i in range(100)]
    assert got == {a: b for a, b in zip(order, order[1:] + order[:1])}


def test_likeness_estimates_the_resemblance(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    df = spark.createDataFrame([(a, b)], "a string, b string")
    near, inside = df.select(fingerprints.likeness(fingerprints.sketch(df.a), fingerprints.sketch(df.b)), fingerprints.containment(fingerprints.sketch(df.a), fingerprints.sketch(df.b))).first()
    assert abs(near - 1 / 3) < 0.06 and abs(inside - 0.5) < 0.08


def test_short_texts_inside_long_ones(spark):
    """A contained text is contained by 1, or not judged; null only where no hash is below the fraction."""
    rng = np.random.default_rng(2)
    rows = []
    for n in (1, 2, 3, 4, 8, 30):
        for _ in range(40):
            words = [f"w{k}" for k in rng.integers(0, 10**6, 400)]
            rows.append((n, " ".join(words[90 : 90 + n + 4]), " ".join(words), " ".join(f"x{w}" for w in words)))
    df = spark.createDataFrame(rows, "n int, a string, b string, c string")
    sk = fingerprints.sketch
    got = df.select("n", fingerprints.containment(sk(df.a), sk(df.b)).alias("inside"), fingerprints.containment(sk(df.a), sk(df.c)).alias("apart"), fingerprints.containment(sk(df.b), sk(df.a)).alias("back")).collect()
    assert {r.inside for r in got} == {1.0, None} and {r.apart for r in got} == {0.0, None}
    assert all(r.inside is not None for r in got if r.n == 30) and sum(r.inside is not None for r in got if r.n == 8) > 30
    assert all(abs(r.back - r.n / 396) < 0.08 for r in got)


def brute_sketch(text):
    """The kept hashes, from the definition; xxhash of longs as Spark has it comes from the session in the test."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def test_sketches_against_their_definition(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    texts = [r.text for r in table] + TEXTS
    grams = sorted({g for t in texts for g in brute_sketch(t)})
    fives = spark.createDataFrame([(i, *g) for i, g in enumerate(grams) if len(g) == 5], "i long, a string, b string, c string, d string, e string")
    hashed = {grams[r.i]: r.h for r in fives.selectExpr("i", "xxhash64(xxhash64(a), xxhash64(b), xxhash64(c), xxhash64(d), xxhash64(e)) h").collect()}
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in docs.select("i", fingerprints.sketch(docs.text).alias("sk")).collect():
        mine = brute_sketch(texts[r.i])
        if mine and len(mine[0]) < 5:
            assert len(r.sk) == 1
            continue
        every = sorted({hashed[g] % 2**64 for g in mine})
        want = [h for h in every if h < 2**62] or every[:1]
        assert [h % 2**64 for h in r.sk] == want


def test_sketches_merge(spark):
    parts = ["a b c d e f g", "h i j", "k " * 50, "", None, " ".join(f"w{i}" for i in range(900))]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(parts)], "k int, text string").withColumn("sk", fingerprints.sketch(F.col("text")))
    rows = df.collect()
    for k, sk in fingerprints.merged_sketches(df, "k", "sk").collect():
        every = sorted({h % 2**64 for r in rows if r.k == k for h in r.sk})
        assert [h % 2**64 for h in sk] == ([h for h in every if h < 2**62] or every[:1])
    with pytest.raises(TypeError):
        fingerprints.fingerprint(df.select(F.lit("x").alias("doc_id"), "text"))


def test_ids_pass_unchanged_beside_a_null(spark):
    docs = spark.createDataFrame([((1 << 53) + 1, "a b", "x"), (None, "c", "x"), (-5, None, "x")], "doc_id long, text string, n_tokens string")
    assert {r.doc_id for r in token_counts.count_tokens(docs).collect()} == {(1 << 53) + 1, None, -5}
    assert {r.doc_id for r in packing.pack(docs).collect()} == {(1 << 53) + 1, None, -5}
    assert packing.pack(docs.limit(0)).count() == 0 and token_counts.count_tokens(docs.limit(0)).count() == 0
