"""The raw lane: references, retention and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyquilt.functions.text import sanitize_source

MAX_RECORDS = 1024
MAX_BYTES = 8 << 20
RANGES = 64


def _with_ranges(rows: DataFrame, order: str, ranges: int) -> DataFrame:
    """Adds ``__source`` (null as blank) and ``__range``, which of ``ranges`` equal parts of all rows a row's ``order`` lies in.

    So no group by both has much more than that part of all rows, whatever one source has. ``order`` is a number or a
    time; nulls come first. The bounds are one row.
    """
    bounds = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)]).alias("__bounds"))
    below = F.size(F.filter("__bounds", lambda x: x < F.col(order)))
    placed = rows.join(F.broadcast(bounds), F.lit(True)).withColumn("__range", F.when(F.col(order).isNull() | F.col("__bounds").isNull(), -1).otherwise(below))
    return placed.withColumn("__source", F.coalesce("source", F.lit(""))).drop("__bounds")


def assign_refs(raw: DataFrame, scheme: str, payload: Column, order: list[str], max_bytes: int = MAX_BYTES, middle: Column | None = None, ranges: int = RANGES, start: DataFrame | None = None) -> DataFrame:
    """Accepted rows with their number by source (from 1) and ``ref``. Empty and oversize payloads take no number.

    A row's number is its place in its source's range plus all that the ranges before hold: no source is sorted in one task.
    ``start`` (source, number), one row a source, is where earlier batches ended.
    """
    fits = payload.isNotNull() & (F.octet_length(payload) > 0) & (F.octet_length(payload) <= max_bytes)
    source, key = sanitize_source(F.col("source")), ["__source", "__range"]
    placed = _with_ranges(raw, order[0], ranges).filter(fits)
    before = F.sum("__n").over(W.partitionBy("__source").orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    totals = placed.groupBy(*key).agg(F.count("*").alias("__n")).select(*key, F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    numbered = placed.withColumn("number", within).join(totals, key).withColumn("number", F.col("number") + F.col("__before")).drop("__range", "__before")
    if start is not None:
        ended = start.select(F.col("source").alias("__source"), F.col("number").alias("__ended"))
        numbered = numbered.join(ended, "__source", "left").withColumn("number", F.col("number") + F.coalesce("__ended", F.lit(0))).drop("__ended")
    numbered = numbered.drop("__source")
    parts = [F.lit(f"{scheme}://raw"), source, *([middle] if middle is not None else []), F.lpad(F.col("number").cast("string"), 8, "0")]
    return numbered.withColumn("ref", F.concat_ws("/", *parts))


def retain(lane: DataFrame, size: Column, order: list[str], max_records: int = MAX_RECORDS, max_bytes: int = MAX_BYTES, ranges: int = RANGES) -> DataFrame:
    """R2: what first-in-first-out eviction leaves by source: the longest suffix within both caps.

    Ranges of a source with ``max_records`` rows after them, or more than ``max_bytes``, are left out before the newest rows are counted.
    """
    key = ["__source", "__range"]
    placed = _with_ranges(lane, order[0], ranges)
    later = W.partitionBy("__source").orderBy(F.desc("__range")).rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy(*key).agg(F.count("*").alias("__n"), F.sum(size).alias("__bytes"))
    after = totals.select(*key, F.coalesce(F.sum("__n").over(later), F.lit(0)).alias("__later"), F.coalesce(F.sum("__bytes").over(later), F.lit(0)).alias("__later_bytes"))
    reached = after.filter((F.col("__later") < max_records) & (F.col("__later_bytes") <= max_bytes))
    newest = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = placed.join(reached, key).withColumn("__n", F.count("*").over(newest) + F.col("__later")).withColumn("__bytes", F.sum(size).over(newest) + F.col("__later_bytes"))
    return counted.filter((F.col("__n") <= max_records) & (F.col("__bytes") <= max_bytes)).drop(*key, "__later", "__later_bytes", "__n", "__bytes")


# The decoded columns that a lane record shows, by feed.
HEADLINES = {"cot": ("uid", "type", "callsign", "stale"), "mavlink": ("system_id", "component_id", "message_id"), "sapient": ("node_id", "content"), "adsb": ("snapshot_time",)}


def headlines(decoded: DataFrame, feed: str) -> DataFrame:
    """(ref, headline columns of the feed) of decoded lane records; null where the record was rejected."""
    return decoded.select("ref", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in HEADLINES[feed]])


def lane_get(lane: DataFrame, ref: str) -> DataFrame:
    """The record of a reference; no row if it was evicted."""
    return lane.filter(F.col("ref") == ref)


def trace(triples: DataFrame, lane: DataFrame) -> DataFrame:
    """Every source_ref triple with whether the lane still holds its record."""
    refs = triples.filter(F.col("predicate") == "cop.provenance.source_ref").select("subject", F.col("object").alias("ref")).distinct()
    return refs.join(lane.select("ref", F.lit(True).alias("held")), "ref", "left").withColumn("held", F.coalesce("held", F.lit(False)))
