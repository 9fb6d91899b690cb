"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every hash of a five-word shingle below a fixed fraction (1 / SCALE) of the hash range, and the text's
least hash, which alone speaks for a text that has none below. The rule is the same for texts of every length.
Sketches of any two texts are comparable, however unequal, and merge: the sketch of two texts together follows from
their sketches.

Defined results: null and empty texts, and texts of white space alone, have an empty sketch, and two empty
sketches have likeness 1; containment of a text with no hash below the fraction is null; a text of fewer than five words is one shingle; equal texts have equal sketches. Documents
are ordered by doc_id, null first, ties by text, repeated rows next to each other; a lone document is its own next;
doc_id must be a whole number, other kinds raise TypeError; an empty table gives an empty result; only doc_id and
text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import bind, table, words

SHINGLE = 5
SCALE_BITS = 2
ROWS_PER_RANGE = 2000
MOST_RANGES = 65536
_NO_ID = -(2**63)


def unsigned(h: Column) -> Column:
    """Orders hashes as unsigned numbers."""
    return h.bitwiseXOR(F.lit(-(2**63)))


def pruned(hashes: Column) -> Column:
    """Of distinct hashes those below 1 / 2**SCALE_BITS of the unsigned range, and the least one; ascending as unsigned."""

    def kept(ordered: Column) -> Column:
        low = F.filter(ordered, lambda x: x < -(2**63) + 2 ** (64 - SCALE_BITS))
        return F.transform(F.when(F.size(low) > 0, low).otherwise(F.slice(ordered, 1, 1)), unsigned)

    return bind(F.sort_array(F.transform(hashes, unsigned)), kept)


def sketch(text: Column) -> Column:
    """The kept hashes of a text's shingles, array<long>."""

    def shingled(h: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))
        one = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda acc, x: F.xxhash64(acc, x)))
        return F.when(F.size(h) >= SHINGLE, every).when(F.size(h) > 0, one).otherwise(F.array().cast("array<bigint>"))

    hashed = F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))
    return bind(F.array_distinct(bind(hashed, shingled)), pruned)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together, from their sketches: what is below the fraction in either, else the least hash."""
    return bind(F.array_union(a, b), pruned)


def merged_sketches(sketches: DataFrame, key: str, column: str) -> DataFrame:
    """One sketch for each value of ``key``: that of all its texts together. Hashes are made distinct before they are gathered."""
    distinct = sketches.select(key, F.explode(column).alias("__h")).distinct()
    return distinct.groupBy(key).agg(pruned(F.collect_list("__h")).alias(column))


def printed(sk: Column) -> Column:
    """A sketch as text: its hashes in hex."""
    return F.array_join(F.transform(sk, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance (shared over all shingles) of two sketches, 0 to 1: that of what their union keeps."""

    def of(union: Column) -> Column:
        shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
        return F.when(F.size(union) > 0, shared / F.size(union)).otherwise(F.lit(1.0))

    return bind(merged(a, b), of)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has too, from what the first keeps below the fraction.

    Null where it keeps nothing there: a least hash alone is no sample, as a longer text need not keep it.
    """
    low = lambda sk: F.filter(sk, lambda h: F.shiftrightunsigned(h, 64 - SCALE_BITS) == 0)
    return bind(low(a), lambda mine: F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, b)) / F.size(mine)))


def id_ranges(ids: DataFrame, rows: int = ROWS_PER_RANGE) -> list[int]:
    """Bounds that split the ids into ranges of about ``rows``; at most MOST_RANGES numbers reach the driver.

    The bounds are estimates: they balance the work and change no result.
    """
    n = min(MOST_RANGES, -(-ids.count() // rows))
    if n < 2:
        return []
    cuts = ids.agg(F.percentile_approx("__id", [i / n for i in range(1, n)], 10000 + 4 * n)).first()[0]
    return sorted(set(cuts))


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the value, by binary search."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return reduce(lambda at, step: bind(at, lambda p: F.when(F.get(listed, p + (step - 1)) <= value, p + step).otherwise(p)), steps, F.lit(0))


def with_next(documents: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Every document with the columns given and, as next_*, those of the next document by doc_id, cyclic.

    One shuffle by range of doc_id. The first document of each range, at most MOST_RANGES in all, is sent to
    the range before it too, so that every document finds its next one in its own range.
    """
    if not isinstance(documents.schema["doc_id"].dataType, IntegralType):
        raise TypeError("documents are ordered by doc_id, which must be a whole number")
    keyed = documents.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)))
    bounds = id_ranges(keyed.select("__id"))
    ranged = keyed.withColumn("__range", range_of(F.col("__id"), bounds))
    firsts = ranged.groupBy("__range").agg(F.min("__id").alias("__id"))
    order = W.orderBy("__range")
    everything = W.partitionBy(F.lit(1))
    sent = firsts.select("__id", F.coalesce(F.lag("__range").over(order), F.max("__range").over(everything)).alias("__to"))
    own = ranged.select("doc_id", "__id", "__range", F.lit(0).alias("__sent"), *[c.alias(n) for n, c in columns.items()])
    extra = ranged.join(F.broadcast(sent), "__id").select("doc_id", "__id", F.col("__to").alias("__range"), F.lit(1).alias("__sent"), *[c.alias(n) for n, c in columns.items()])
    inside = W.partitionBy("__range").orderBy("__sent", "__id", *[F.col(n) for n in columns if n == "text"])
    led = own.unionByName(extra).select("*", *[F.lead(n).over(inside).alias(f"next_{n}") for n in columns])
    return led.filter("__sent = 0").drop("__id", "__range", "__sent")


def fingerprint(documents: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose second half is the start of the next document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    paired = with_next(documents.select("doc_id", text.alias("text")), {"text": F.col("text"), "sk": sketch(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = paired.withColumn("__edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    sketched = edited.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode("__edited", "UTF-8"), 256).alias("edited_sha256"), "sk", "next_sk", sketch(F.col("__edited")).alias("edited_sk")
    )
    return sketched.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("sk")).alias("fingerprint"),
        printed(F.col("edited_sk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("edited_sk")).alias("near_edited"),
        likeness(F.col("sk"), F.col("next_sk")).alias("near_next"),
        containment(F.col("sk"), F.col("edited_sk")).alias("contained_in_edited"),
    )


def query(spark, sf_dir):
    """op4: fingerprints of the whole of documents."""
    return fingerprint(table(spark, sf_dir, "documents"))
