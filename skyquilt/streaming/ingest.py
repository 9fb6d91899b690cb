"""State, births and references over streams that can be stopped, started again and replayed.

Each operator is one function of a micro-batch over ``KeyedTable``s, and a stream that calls it. Nothing expires: an
entity seen again after any gap is not created twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from skyquilt.operators.lane import assign_refs
from skyquilt.operators.state import STATE, current_state, plan_births, running_state
from skyquilt.streaming.tables import BUCKETS, KeyedTable

ENTITIES = StructType([StructField("subject", StringType()), StructField("born_batch", LongType())])
MARKS = StructType([StructField("source", StringType()), StructField("number", LongType())])


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Calls ``each`` with every micro-batch; ``once``: stops when all that is there has been read."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query


class StreamState:
    """M9: the current state of a stream of triples, in a table by subject."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.folder, self.table = folder, KeyedTable(spark, f"{folder}/state", STATE, buckets=buckets)

    def each(self, triples: DataFrame, batch: int) -> None:
        """Merges a batch; the last written object wins by its place in the order of writing, so a late row changes nothing that is newer."""
        self.table.update(batch, current_state(triples), lambda old, new: running_state(old, new))

    def run(self, triples: DataFrame, once: bool = True) -> StreamingQuery:
        return run(triples, f"{self.folder}/progress", self.each, once)

    def read(self, spark: SparkSession) -> DataFrame:
        """The state, with the columns of ``current_state``."""
        return self.table.read(spark)


class StreamBirths:
    """Mutations of a stream of sightings, one create for each entity that the entity table does not hold.

    ``project`` makes triples of planned sightings (with their ``kind``), as ``mavlink.project_planned`` does: on a
    create the source asset and the edge to it come beside. They are written under the number of their batch.
    """

    def __init__(self, spark: SparkSession, folder: str, project: Callable[[DataFrame], DataFrame], order: tuple[str, ...] = ("batch", "arrival"), buckets: int = BUCKETS):
        self.folder, self.project, self.order = folder, project, order
        self.table = KeyedTable(spark, f"{folder}/entities", ENTITIES, buckets=buckets)

    def seed(self, existing: DataFrame) -> None:
        """Entities that are already in the store count as born; seeding once more, or later, changes nothing that is there."""
        last, _ = self.table.versions(existing.sparkSession)
        if last < 0:
            born = existing.select("subject").distinct().withColumn("born_batch", F.lit(0).cast("long"))
            self.table.update(0, born, lambda old, new: new)

    def each(self, sightings: DataFrame, batch: int) -> None:
        """Plans a batch against the entities of all batches before it. Its triples are there before its entities count."""
        number = batch + 1  # 0 is the seed
        if number <= self.table.versions(sightings.sparkSession)[0]:
            return
        sightings = sightings.persist()
        try:
            known = self.table.read(sightings.sparkSession, self.table.touched(sightings))
            planned = plan_births(sightings, known, self.order)
            self.project(planned).write.mode("overwrite").parquet(f"{self.folder}/triples/part={number}")
            first = planned.filter("kind = 'create'").select("subject", F.lit(number).cast("long").alias("born_batch"))
            self.table.update(number, first, lambda old, new: old.unionByName(new.join(old.select("subject"), "subject", "left_anti")))
        finally:
            sightings.unpersist()

    def run(self, sightings: DataFrame, once: bool = True) -> StreamingQuery:
        return run(sightings, f"{self.folder}/progress", self.each, once)

    def triples(self, spark: SparkSession) -> DataFrame:
        """The triples of all batches that count; one whose entities are not yet entered does not."""
        last, _ = self.table.versions(spark)
        return spark.read.parquet(f"{self.folder}/triples").filter(F.col("part") <= last).drop("part")


class StreamLane:
    """R1 over batches: each source's numbers go on where the last batch ended."""

    def __init__(self, spark: SparkSession, folder: str, scheme: str, payload, order: list[str], buckets: int = 8):
        self.folder, self.scheme, self.payload, self.order = folder, scheme, payload, order
        self.table = KeyedTable(spark, f"{folder}/marks", MARKS, key=("source",), buckets=buckets)

    def each(self, raw: DataFrame, batch: int) -> None:
        if batch <= self.table.versions(raw.sparkSession)[0]:
            return
        path = f"{self.folder}/lane/part={batch}"
        assign_refs(raw, self.scheme, self.payload, self.order, start=self.table.read(raw.sparkSession)).write.mode("overwrite").parquet(path)
        written = raw.sparkSession.read.parquet(path).groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.max("number").alias("number"))
        self.table.update(batch, written, lambda old, new: old.unionByName(new).groupBy("source").agg(F.max("number").alias("number")))

    def run(self, raw: DataFrame, once: bool = True) -> StreamingQuery:
        return run(raw, f"{self.folder}/progress", self.each, once)

    def read(self, spark: SparkSession) -> DataFrame:
        last, _ = self.table.versions(spark)
        return spark.read.parquet(f"{self.folder}/lane").filter(F.col("part") <= last).drop("part")
