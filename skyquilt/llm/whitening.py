"""Embedding whitening by weighted multiplicity covariance.

Entries become whole numbers, rows with the same numbers become one distinct vector with its count, and every
distinct vector weighs its count or one in the fit. Tasks add up their own sums and centred products (GEMM) of the
distinct vectors, Spark adds those by place, and the driver gets one matrix of the dimension, whatever the number of
rows. Each distinct vector is whitened once and joined back to its rows; a vector that many rows share is joined by
broadcast (``join_spread``).

Distinct vectors travel as bytes: a vector's numbers less OFFSET, little endian, in the fewest bytes that hold them.

Defined results: a null vector, or one that holds null, NaN or infinite entries, has no rows; neither has a vector of
another length than most have (the longest of equally frequent lengths; an empty one counts as null). Numbers beyond
62 bits are held at that bound. Components without variance have a null ``whitened`` and stay out of the identity
error; a deviation beyond a long is null. Repeated rows give repeated rows, null ids stay null, an empty table gives
an empty result. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_spread, table

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
BOUND = 1 << 62


@dataclass
class Whitener:
    """A fit: total weight, exact sums by dimension, unit components as columns, eigenvalues and the trace."""

    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = field(default=None)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` (less OFFSET) less the mean; the whole part goes first, so no digits are lost."""
        whole = np.array([s // self.n for s in self.sums])
        return (x - whole).astype(np.float64) - np.array([(s % self.n) / self.n for s in self.sums])

    @property
    def varied(self) -> np.ndarray:
        """Which components have variance, beyond what rounding leaves."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values, default=0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; NaN where there is no variance."""
        return (self.centred(x) @ self.basis) / np.sqrt(np.where(self.varied, self.values, np.nan))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S) ** 2; None beyond a long."""
        far = self.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, self.sums), default=0)
        kind = np.int64 if far * far * len(self.sums) < 1 << 63 else object
        off = self.n * x.astype(kind) - np.array(self.sums, dtype=kind)
        return [int(v) if v < 1 << 63 else None for v in (off * off).sum(axis=1)]


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest of 1, 2, 4 or 8 bytes; the length tells how many there are."""
    least, most = int(x.min()), int(x.max())
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
    return kind[-1:].encode() + x.astype(kind).tobytes()


def unpack(keys: pa.Array) -> np.ndarray:
    """The numbers of packed vectors of one length, a row each."""
    return np.array([np.frombuffer(k, f"<i{k[:1].decode()}", offset=1).astype(np.int64) for k in keys.to_pylist()])


def packed_rows(embeddings: DataFrame, vector: str, scale: int, offset: int) -> DataFrame:
    """``__id``, ``__key`` (packed vector) and ``__dims`` of the rows whose vector is whole."""
    kind = embeddings.schema["__id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(vector)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().cast(pa.float64())
            flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
            good = np.isfinite(flat)  # null entries came as NaN
            with np.errstate(all="ignore"):
                x = np.clip(np.floor(np.where(good, flat, 0.0) * scale), -BOUND, BOUND).astype(np.int64) + (offset - OFFSET)
            ends = np.cumsum(np.nan_to_num(sizes)).astype(int)
            keys = [pack(x[e - int(s) : e]) if s > 0 and good[e - int(s) : e].all() else None for s, e in zip(sizes, ends)]
            dims = pa.array([int(s) if s > 0 else None for s in sizes], pa.int32())
            out = pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(keys, pa.binary()), dims], ["__id", "__key", "__dims"])
            yield out.filter(out.column("__key").is_valid())

    return embeddings.mapInArrow(packed, f"__id {kind}, __key binary, __dims int")


def exact_sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """Total weight and weighted sums by dimension, exactly; one row a place goes to the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x, w = unpack(batch.column("__key")), batch.column("__weight").to_numpy()
                wide = np.int64 if int(np.abs(x).max()) * int(w.sum()) < BOUND else object
                part = [int(w.sum()), *(x.astype(wide) * w.astype(wide)[:, None]).sum(axis=0).tolist()]
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.decimal128(38, 0))], ["i", "v"])

    found = distinct.mapInArrow(summed, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").cast("string").alias("v")).toArrow().to_pylist()
    values = {r["i"]: int(r["v"]) for r in found}
    return (values[0], [values[i] for i in range(1, len(values))]) if values else (0, [])


def scatter(distinct: DataFrame, of, size: int) -> np.ndarray:
    """The sum of w * y y^T and, in the last row, of w * y, with ``y = of(x)`` a row of ``size`` numbers for each vector."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            if batch.num_rows:
                y, w = of(unpack(batch.column("__key"))), batch.column("__weight").to_numpy().astype(np.float64)
                total[:size] += (y * w[:, None]).T @ y
                total[size] += w @ y
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    found = distinct.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size + 1, size))
    out[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("v").to_numpy()
    return out


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of weighted distinct vectors (__key, __weight); None if there are none."""
    n, sums = exact_sums(distinct)
    if not n:
        return None
    d = len(sums)
    model = Whitener(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    moments = scatter(distinct, model.centred, d)
    mean = moments[d] / n
    values, vectors = np.linalg.eigh(moments[:d] / n - np.outer(mean, mean))
    falling = np.argsort(values)[::-1][:components]
    model = Whitener(n, sums, vectors[:, falling], values[falling], float(values.sum()))
    if k := int(model.varied.sum()):
        shown = Whitener(n, sums, model.basis[:, :k], model.values[:k], model.trace)
        moments = scatter(distinct, shown.whitened, k)
        mean = moments[k] / n
        model.identity_error = float(np.abs(moments[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def whiten(
    embeddings: DataFrame, components: int = COMPONENTS, weights: str = "one", scale: int = SCALE, offset: int = OFFSET, id: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, Whitener | None]:
    """(id, deviation, whitened) of every row with a whole vector, and the fit. ``weights``: "one" or "counts" for each distinct vector.

    ``whitened`` has one number a component, from the greatest eigenvalue down.
    """
    if weights not in ("one", "counts"):
        raise ValueError("weights is one or counts")
    kind = embeddings.schema[id].dataType.simpleString()
    rows = cut(packed_rows(embeddings.select(F.col(id).alias("__id"), F.col(vector).alias("__vector")), "__vector", scale, offset))
    usual = rows.groupBy("__dims").count().orderBy(F.desc("count"), F.desc("__dims")).limit(1).collect()
    rows = rows.filter(F.col("__dims") == usual[0]["__dims"]) if usual else rows
    weight = F.count("*") if weights == "counts" else F.lit(1).cast("long")
    distinct = cut(rows.groupBy("__key").agg(weight.alias("__weight")))
    model = fit(distinct, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], f"{id} {kind}, deviation long, whitened array<double>"), None

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unpack(batch.column("__key"))
                white = [[None if v != v else v for v in row] for row in model.whitened(x).tolist()]
                # the sums of the model are of x less OFFSET, and so is x: the deviation is the same
                columns = [batch.column("__key"), pa.array(model.deviations(x), pa.int64()), pa.array(white, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["__key", "deviation", "whitened"])

    once = distinct.mapInArrow(projected, "__key binary, deviation long, whitened array<double>")
    return join_spread(rows, once, "__key").select(F.col("__id").alias(id), "deviation", "whitened"), model


def query(spark, sf_dir):
    """op11: every row of embeddings by component, whitened over distinct vectors."""
    rows, model = whiten(table(spark, sf_dir, "embeddings"))
    n, error = (model.n, model.identity_error) if model else (0, None)
    parts = [float(v / model.trace) if model.trace > 0 else None for v in model.values] if model else []
    share = F.array(*map(F.lit, parts)).cast("array<double>")
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("__at", "whitened"))
    return long.select(
        "vec_id", (F.col("__at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("__at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
