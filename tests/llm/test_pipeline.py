"""The pipeline against its stages on the driver."""

import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline

from skyquilt.llm import mixing, packing, personal, quality, similar

DIR = "/root/testdata/sf0.001"


def test_pipeline_whole(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = quality.kept_documents(docs).collect()
    single = similar.one_of_each(spark.createDataFrame(kept, docs.schema)).collect()  # held to brute force in test_similar.py
    masked = personal.masked_documents(spark.createDataFrame(single, docs.schema))
    mixed = mixing.mixed_documents(masked).collect()
    vocabulary = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = Counter((r.doc_id, len(vocabulary.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed)
    pieces = corpus_pipeline.run(spark, DIR).collect()
    words = Counter()
    for r in pieces:
        words[(r.doc_id, r.doc_tokens)] += r.length
    assert {k: n * k[1] for k, n in want.items()} == dict(words)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "packed_sequences"]
    assert zlib.crc32(np.array([1], "<u4").tobytes()) > 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and an empty table; what is dropped is dropped for a rule, and nothing else goes."""
    plain = lambda k: " ".join(f"Sentence {k} word{i} {k * i}." for i in range(40))
    rows = [(1, plain(1), "en", "a", 5), (1, plain(1), "en", "a", 5), (None, plain(2), None, None, None), (3, None, "en", "b", 0), (4, "", "en", "b", 0), (2, plain(3), "en", None, 1), (2, plain(4), "en", None, 1)]
    for name, part in (("rows", rows), ("none", [])):
        spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/rows/documents.parquet")
    assert sorted((str(r.doc_id), r.text) for r in similar.one_of_each(quality.kept_documents(docs)).collect()) == [("1", plain(1)), ("2", plain(3)), ("2", plain(4)), ("None", plain(2))]
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/rows").collect()
    assert {r.doc_id for r in pieces} <= {1, 2, None} and len({r.doc_tokens for r in pieces}) > 1
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
