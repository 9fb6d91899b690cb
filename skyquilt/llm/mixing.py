"""Mixing sources to target weights.

Documents get hash-random keys; within each source they are ordered by key, word counts are
prefix-summed, and the source is cut where its budget ends. Whole passes over a source (epochs)
come before the cut, so a source may be repeated.

The prefix sum is distributed: the keys are uniform, so equal-width key ranges split every source,
however large, into ``2 ** BUCKET_BITS`` parts of nearly equal size. Each part is summed by itself
and shifted by the total of the parts before it.

Defined results: a null text has no words; a null source is a source of its own, after all others;
a null doc_id takes the lowest key; ties of keys and repeated rows are ordered by doc_id and size, and
rows equal in both are interchangeable; a source without words has target 0; an empty table gives an
empty result. Columns of the input are carried as they are; those of the result win over equal names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, words

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BUCKET_BITS = 10
KEY_BITS = 60


def random_key(doc_id: Column) -> Column:
    """60 uniform bits made from an id."""
    digits = F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, KEY_BITS // 4)
    return F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(0).cast("long"))


def targets(totals: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Share the total of ``source_size`` over the sources by weight, none above ``most`` times its size.

    One row per source. With sources in order of size over weight, the common level is the largest of
    (what is left after capping the first k) / (the weights of the others): capping one source lifts the
    level for the rest exactly until the first source that stays below its cap.
    """
    by_name = W.orderBy(F.col("__source").isNull(), "__source")
    given = F.array(*[F.lit(float(w)) for w in weights])
    weighted = totals.withColumn(
        "__weight", F.get(given, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    ).withColumn("__cap", F.col("source_size") * float(most))
    filling = W.orderBy(F.col("__cap") / F.col("__weight"), F.col("__source").isNull(), "__source").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(filling), F.lit(0.0))
    open_weight = F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(filling), F.lit(0.0))
    levels = weighted.withColumn("__level", left / open_weight)
    level = F.max("__level").over(everything)
    return levels.select("__skey", "source_size", F.least(F.col("__cap"), level * F.col("__weight")).alias("target"))


def mix(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: float = MOST_EPOCHS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """How many words the mix takes of each document.

    ``documents`` needs doc_id, source and text. The result has doc_id, size, source_size, target and
    taken, and the columns named in ``carry``. ``taken`` counts repeats: whole epochs times the size, and
    for the document at the cut the words before it.
    """
    source = F.col("source")
    base = documents.select(
        F.col("doc_id").alias("__id"),
        source.alias("__source"),
        F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source)).alias("__skey"),
        F.size(words(F.col("text"))).cast("long").alias("__size"),
        random_key(F.col("doc_id")).alias("__key"),
        *[F.col(c).alias(f"__carry_{c}") for c in carry],
    ).withColumn("__bucket", F.shiftright("__key", KEY_BITS - BUCKET_BITS))
    parts = base.groupBy("__skey", "__source", "__bucket").agg(F.sum("__size").alias("__part"))
    totals = parts.groupBy("__skey", "__source").agg(F.sum("__part").alias("source_size"))
    before = W.partitionBy("__skey").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    shifted = parts.select("__skey", "__bucket", F.coalesce(F.sum("__part").over(before), F.lit(0)).alias("__before"))
    plan = shifted.join(targets(totals, weights, most), "__skey")
    inside = W.partitionBy("__skey", "__bucket").orderBy("__key", "__id", "__size").rowsBetween(W.unboundedPreceding, W.currentRow)
    budget = F.floor(F.col("target") + 0.5)
    size, total = F.col("__size"), F.col("source_size")
    start = F.col("__before") + F.sum("__size").over(inside) - size
    epochs = F.coalesce(F.try_divide(budget - F.coalesce(F.try_mod(budget, total), F.lit(0)), total), F.lit(0)).cast("long")
    rest = F.coalesce(F.try_mod(budget, total), F.lit(0))
    taken = epochs * size + F.greatest(F.lit(0), F.least(size, rest - start))
    return base.join(plan, ["__skey", "__bucket"]).select(
        *[F.col(f"__carry_{c}").alias(c) for c in carry if c not in ("doc_id", "size", "source_size", "target", "taken")],
        F.col("__id").alias("doc_id"),
        size.alias("size"),
        total.cast("long").alias("source_size"),
        F.col("target"),
        taken.cast("long").alias("taken"),
    )


def mixed_documents(documents: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """The mixed corpus itself: every document as often as it is taken, the last copy cut at the budget.

    The columns are those of ``documents``; a cut copy has its first words, single-spaced, and n_chars follows the text.
    """
    carried = [c for c in documents.columns if c != "doc_id"]
    renamed = documents.select("doc_id", "source", "text", *[F.col(c).alias(f"__own_{c}") for c in carried])
    taken = mix(renamed, weights, most, carry=[f"__own_{c}" for c in carried]).filter("taken > 0")
    copies = taken.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    short = F.col("taken") - (F.col("__nth") - 1) * F.col("size")
    text = F.when(short >= F.col("size"), F.col("__own_text")).otherwise(F.concat_ws(" ", F.slice(words(F.col("__own_text")), F.lit(1), short.cast("int"))))
    out = copies.withColumn("__own_text", text)
    if "n_chars" in carried:
        out = out.withColumn("__own_n_chars", F.length("__own_text").cast(documents.schema["n_chars"].dataType))
    return out.select(*[F.col(c if c == "doc_id" else f"__own_{c}").alias(c) for c in documents.columns])


def query(spark, sf_dir):
    """op1: the whole of documents mixed with weights 5, 2, 1."""
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS k FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         source_size * 3.0::DOUBLE AS cap FROM totals),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS lv
  FROM weighted WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, least(cap, max(lv) OVER () * w) AS target FROM levels),
run AS (
  SELECT b.*, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS budget,
         (sum(b.size) OVER (PARTITION BY b.source ORDER BY k, doc_id, b.size ROWS UNBOUNDED PRECEDING) - b.size)::BIGINT AS start
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) END::BIGINT AS taken
FROM run
"""
