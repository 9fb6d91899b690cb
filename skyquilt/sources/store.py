"""The mutation sink and the triple table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ("batch", "arrival")


def judged(mutations: DataFrame, existing: DataFrame | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Mutations (kind, subject, *order) with ``error`` and ``applied``, as if written one by one in order until the first that fails.

    A create of what exists and an update of what does not fail, and a blank id. ``existing``: subjects already in the
    store. The first failure is a minimum, so nothing is walked through.
    """
    place = F.struct(*order)
    born = mutations.filter("kind = 'create'").groupBy("subject").agg(F.min(place).alias("__born"))
    known = mutations.select("subject").limit(0) if existing is None else existing.select("subject").distinct()
    rows = mutations.join(born, "subject", "left").join(known.withColumn("__known", F.lit(True)), "subject", "left")
    there = F.coalesce("__known", F.lit(False))
    late = F.coalesce(place > F.col("__born"), F.lit(False))
    error = (
        F.when(F.trim(F.coalesce("subject", F.lit(""))) == "", "blank id")
        .when((F.col("kind") == "create") & (there | late), "already exists")
        .when((F.col("kind") != "create") & ~there & ~late, "not found")
    )
    rows = rows.withColumn("error", error).drop("__born", "__known")
    stop = rows.filter("error is not null").agg(F.min(place).alias("__stop"))
    cut_off = rows.join(F.broadcast(stop), F.lit(True))
    return cut_off.withColumn("applied", F.col("__stop").isNull() | (place < F.col("__stop"))).drop("__stop")


def write_triples(triples: DataFrame, path: str, part: int | None = None) -> None:
    """Writes triples by system and type of their subject. With ``part``, the number of a batch, writing it again replaces it; else they are appended."""
    places = {"system": 4, "type": 5}
    rows = triples.withColumns({n: F.split_part("subject", F.lit("."), F.lit(i)) for n, i in places.items()})
    if part is None:
        rows.write.mode("append").partitionBy(*places).parquet(path)
    else:
        rows.write.mode("overwrite").partitionBy(*places).parquet(f"{path}/part={part}")


def scan_triples(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """The triples in a store, of all subjects or of those under a five-part prefix: then only the folders of its system and type are read."""
    found = spark.read.parquet(path)
    if prefix is not None:
        system, kind = prefix.split(".")[3:5]
        found = found.filter((F.col("system") == system) & (F.col("type") == kind) & F.startswith("subject", F.lit(prefix + ".")))
    return found.drop("system", "type", "part")
