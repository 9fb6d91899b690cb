"""A keyed table that micro-batches change: Parquet by bucket of the key, and a ledger of the batches.

A batch writes the buckets that it touches, whole, to a folder of its own; the other buckets stay where they are. Its
entry in the ledger, one small file, names for every bucket the batch that wrote it last, and is written after the
data: until it is there, readers and a retry see the table as it was before the batch, and once it is there the same
batch does nothing any more. So a run that dies anywhere can be started again, with the batches it had begun.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

BUCKETS = 64


def shaped(rows: DataFrame, schema: StructType) -> DataFrame:
    """The columns of a schema, in its order and types."""
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


class KeyedTable:
    """``folder`` holds the table; ``key`` are the columns whose rows stand in one bucket, ``schema`` those of the rows.

    The number of buckets bounds what the driver reads of the ledger, whatever the number of rows and batches; it is
    fixed when the table is made.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: tuple[str, ...] = ("subject",), buckets: int = BUCKETS):
        self.folder, self.schema, self.key, self.buckets = folder, schema, key, buckets
        self.entry = StructType([StructField("bucket", IntegerType()), StructField("version", LongType()), StructField("batch", LongType())])
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            self._enter(spark, {}, -1)

    def _enter(self, spark: SparkSession, versions: dict[int, int], batch: int) -> None:
        """The entry of a batch: which batch wrote each bucket last; bucket -1 stands for the table."""
        rows = [(-1, batch), *versions.items()]
        spark.createDataFrame(rows, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")

    def versions(self, spark: SparkSession) -> tuple[int, dict[int, int]]:
        """The last batch in the ledger, and by bucket the batch that holds its rows."""
        ledger = spark.read.schema(self.entry).parquet(f"{self.folder}/ledger")
        last = ledger.agg(F.max("batch")).first()[0]
        return last, {r["bucket"]: r["version"] for r in ledger.filter(F.col("batch") == last).filter("bucket >= 0").collect()}

    def bucket(self):
        return F.pmod(F.hash(*self.key), F.lit(self.buckets))

    def read(self, spark: SparkSession, buckets: set[int] | None = None) -> DataFrame:
        """The rows as of the last batch, of some buckets or of all; no other folder is opened."""
        _, held = self.versions(spark)
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets that rows with the key fall in."""
        return {r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()}

    def update(self, batch: int, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """``merge(old rows of the touched buckets, rows)`` becomes their content; false if the ledger has the batch already.

        ``rows`` have the table's columns. The merge must keep the old rows that it does not change.
        """
        spark = rows.sparkSession
        last, held = self.versions(spark)
        if batch <= last:
            return False
        rows = rows.persist()
        try:
            touched = self.touched(rows)
            if touched:
                new = shaped(merge(self.read(spark, touched), shaped(rows, self.schema)), self.schema)
                placed = new.withColumn("bucket", self.bucket()).repartition("bucket", *self.key)
                placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/version={batch}")
            self._enter(spark, held | {b: batch for b in touched}, batch)
        finally:
            rows.unpersist()
        return True

    def vacuum(self, spark: SparkSession) -> int:
        """Deletes the versions that no bucket uses any more and all entries but the last; how many versions went."""
        last, held = self.versions(spark)
        base = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files, gone = base.getFileSystem(spark._jsc.hadoopConfiguration()), 0
        for name, keep in (("ledger", {last}), ("data", set(held.values()))):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            for status in files.listStatus(path) if files.exists(path) else []:
                number = status.getPath().getName().rpartition("=")[2]
                if number.lstrip("-").isdigit() and int(number) not in keep:
                    files.delete(status.getPath(), True)
                    gone += name == "data"
        return gone
