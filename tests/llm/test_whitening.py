"""Whitening against numpy over whole tables; odd vectors, weights, copies and ties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def numbers(vectors):
    return np.array([np.floor(np.array(v, dtype=float) * 64).astype(np.int64) + 1_000_000 for v in vectors])


def brute(x, weights=None, components=16):
    """Distinct vectors, exact deviations by vector, falling eigenvalues, components and the trace."""
    distinct, counts = np.unique(x, axis=0, return_counts=True)
    w = np.ones(len(distinct), dtype=int) if weights != "counts" else counts
    n, sums = int(w.sum()), (distinct * w[:, None]).sum(axis=0)
    centred = distinct - sums / n
    values, vectors = np.linalg.eigh((centred * w[:, None]).T @ centred / n)
    order = np.argsort(values)[::-1][:components]
    return n, sums, values[order], vectors[:, order], values.sum()


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    given = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    got = whitening.query(spark, sf).toPandas()
    x = numbers(given.embedding)
    n, sums, values, basis, trace = brute(x)
    assert len(got) == len(given) * 16 and set(got.n) == {n} and got.identity_error.nunique() == 1
    assert got.identity_error.max() < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[given.vec_id].to_numpy()
    want = (x - sums / n) @ basis / np.sqrt(values)
    assert np.allclose(np.abs(wide), np.abs(want), atol=1e-7)
    assert np.allclose(np.sign(wide[0]) * np.sign(want[0]) * want, wide, atol=1e-7)  # one sign a component, the same for all rows
    first = got[got.vec_id == given.vec_id[0]].sort_values("component")
    assert np.allclose(first.explained, values / trace, rtol=1e-9)
    deviation = dict(zip(given.vec_id, ((n * x - sums) ** 2).sum(axis=1)))
    assert all(deviation[r.vec_id] == r.deviation for r in got[got.component == 1].itertuples())


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_copies_odd_vectors_and_clashing_columns(spark, weights):
    rng = np.random.default_rng(5)
    some = [[float(v) for v in row] for row in rng.normal(size=(40, 5)).astype(np.float32)]
    rows = [(i, v, 0) for i, v in enumerate(some)] + [(100 + i, some[0], 0) for i in range(60)] + [(None, some[1], 1), (3, some[3], 2)]
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [math.nan, 0.0, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    df = spark.createDataFrame(rows + [(900 + i, v, 0) for i, v in enumerate(bad)], SCHEMA).repartition(5)
    df = df.withColumn("__key", F.lit(1)).withColumn("whitened", F.lit("x")).withColumn("i", F.lit(0))
    out, model = whitening.whiten(df, components=9, weights=weights)
    got = out.toPandas()
    n, sums, values, basis, trace = brute(numbers([r[1] for r in rows]), weights)
    assert model.n == n and len(got) == len(rows) and not set(got.vec_id.dropna()) & set(range(900, 906))
    assert np.allclose(model.values, values) and math.isclose(model.trace, trace) and model.identity_error < 1e-9
    assert got.vec_id.isna().sum() == 1 and (got.vec_id == 3).sum() == 2
    one = numbers([some[0]])
    want = np.abs((one - sums / n) @ basis / np.sqrt(values))[0]
    for r in got[got.vec_id.isin([0, *range(100, 160)])].itertuples():
        assert np.allclose(np.abs(r.whitened), want, atol=1e-7) and r.deviation == int(((n * one - sums) ** 2).sum())


def test_no_variance_huge_entries_and_empty_tables(spark):
    flat, _ = whitening.whiten(spark.createDataFrame([(i, [1.0, float(i % 3), 2.0], 0) for i in range(9)], SCHEMA))
    rows = flat.collect()
    assert len(rows) == 9 and all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in rows)
    same, model = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5], 0)] * 4, SCHEMA))
    assert {(tuple(r.whitened), r.deviation) for r in same.collect()} == {((None, None), 0)} and model.identity_error is None
    huge = [[1e30, 0.0], [-1e30, 1.0], [3.0, 2.0]]
    far, model = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(huge)], SCHEMA))
    assert {r.vec_id: r.deviation for r in far.collect()} == {0: None, 1: None, 2: (3 * 192 - 192) ** 2 + (3 * 128 - 192) ** 2}
    empty, model = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and model is None and empty.columns == ["vec_id", "deviation", "whitened"]


def test_packing_is_exact_and_one_to_one():
    for x in ([0, -128, 127], [0, 128], [-(1 << 31), 5], [1 << 40], [-(1 << 62), 1 << 62]):
        import pyarrow as pa

        assert whitening.unpack(pa.array([whitening.pack(np.array(x))]))[0].tolist() == x
