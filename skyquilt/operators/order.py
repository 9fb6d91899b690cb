"""Places in a total order without sorting anything whole in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyquilt.functions.folders import cut

LOW = (1 << 33) - 1


def numbered(rows: DataFrame, *order, name: str = "number", first: int = 1) -> DataFrame:
    """``rows`` with their place in ``order``, from ``first``, as a column; cut.

    Ranges of the order are sorted apart; a range's numbers go on where those of all ranges before end. The prefix sum
    runs over one row a range. Rows that are equal in ``order`` share a range, so it should tell most rows apart.
    """
    ranges = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sorted_ = rows.repartitionByRange(int(ranges), *order).sortWithinPartitions(*order)
    placed = cut(sorted_.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    joined = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return joined.withColumn(name, F.col("__at").bitwiseAND(LOW) + F.col("__before") + first).drop("__at", "__part", "__before")


def before(rows: DataFrame, key: list[str], order: list[str], ranges: int | None = None, **values: tuple[Column, str]) -> DataFrame:
    """``rows`` with, under each name, what the rows before each in its ``key`` hold of a value; cut.

    Ways: "last" (the last one that is not null), "max" and "sum"; null where nothing is before, or no value. Ranges of
    (key, order) are scanned apart; the first key of a range may have begun in an earlier one, so what a range takes
    over is one row, and no key is sorted or scanned in one task. Nulls come first, also as keys.
    """
    ways = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max, "sum": F.sum}
    together = {"last": lambda a, b: F.coalesce(a, b), "max": F.greatest, "sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumns({f"__{name}": value for name, (value, _) in values.items()}).repartitionByRange(n, *key, *order).sortWithinPartitions(*key, *order)
    placed = cut(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    here = W.partitionBy("__part", *key).orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("__at")))
    totals = placed.groupBy("__part", *key).agg(*[(last if way == "last" else ways[way])(F.col(f"__{name}")).alias(f"__{name}") for name, (_, way) in values.items()])
    over = W.partitionBy(*key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    taken = totals.withColumns({f"__over_{name}": ways[way](F.col(f"__{name}")).over(over) for name, (_, way) in values.items()})
    taken = taken.filter(reduce(lambda a, b: a | b, [F.col(f"__over_{name}").isNotNull() for name in values]))
    taken = taken.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k_{k}") for k in key], *[f"__over_{name}" for name in values])
    scanned = placed.withColumns({name: ways[way](F.col(f"__{name}")).over(here) for name, (_, way) in values.items()})
    same = F.col("__part") == F.col("__p")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = scanned.join(F.broadcast(taken), same, "left")
    out = out.withColumns({name: together[way](F.col(name), F.col(f"__over_{name}")) for name, (_, way) in values.items()})
    return out.select(*[c for c in rows.columns if c not in values], *values)
