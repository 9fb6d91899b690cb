"""Triples: one row per subject and predicate, the object as text with its type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def settled(df: DataFrame) -> DataFrame:
    """The same rows with their columns computed once: later filters and columns refer to them, and do not repeat
    the expressions that made them, which would let plans grow with the power of the number of steps."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def time_text(at: Column) -> Column:
    return F.date_format(at, TIME)


def to_triples(rows: DataFrame, subject: Column, pairs: Sequence[tuple[str, str, Column]], keep: Sequence[str], at: Column, source: Column, confidence: Column) -> DataFrame:
    """Rows to triples; ``pairs`` are (predicate, object type, object), and a null object gives no triple.

    The objects go into one array that is exploded, so a row is read once whatever the number of predicates.
    """
    made = F.array(*[F.struct(F.lit(p).alias("predicate"), o.cast("string").alias("object"), F.lit(t).alias("object_type")) for p, t, o in pairs])
    full = F.filter(made, lambda x: x["object"].isNotNull())
    base = rows.select(*keep, subject.alias("subject"), source.alias("source"), at.alias("timestamp"), confidence.alias("confidence"), F.posexplode(full).alias("idx", "t"))
    return base.select(*keep, "subject", "t.predicate", "t.object", "t.object_type", "source", "timestamp", "confidence", "idx")


def to_triples_of(rows: DataFrame, parts: Sequence[tuple[Column, Sequence[tuple[str, str, Column]], Column | None]], keep: Sequence[str], at: Column, source: Column, confidence: Column) -> DataFrame:
    """As ``to_triples`` for several subjects of one row: parts are (subject, pairs, condition or None)."""
    made, idx = [], 0
    for subject, pairs, condition in parts:
        for predicate, kind, value in pairs:
            value = value.cast("string") if condition is None else F.when(condition, value.cast("string"))
            made.append(F.struct(subject.alias("subject"), F.lit(predicate).alias("predicate"), value.alias("object"), F.lit(kind).alias("object_type"), F.lit(idx).alias("idx")))
            idx += 1
    full = F.filter(F.array(*made), lambda x: x["object"].isNotNull())
    base = rows.select(*keep, source.alias("source"), at.alias("timestamp"), confidence.alias("confidence"), F.explode(full).alias("t"))
    return base.select(*keep, "t.subject", "t.predicate", "t.object", "t.object_type", "source", "timestamp", "confidence", "t.idx")


def provenance(source: str, observed: Column, confidence: Column, ref: Column) -> list[tuple[str, str, Column]]:
    return [
        ("cop.provenance.source", "string", F.lit(source)),
        ("cop.provenance.confidence", "double", confidence),
        ("cop.provenance.observed_at", "time", time_text(observed)),
        ("cop.provenance.source_ref", "string", F.nullif(ref, F.lit(""))),
    ]
