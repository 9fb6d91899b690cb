"""Small shared pieces: word splitting, binding a value inside one expression, cutting lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of ASCII white space; everything else is a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doc_key(name: str = "__doc") -> Column:
    """doc_id as text that is never null; a null id is unlike every other."""
    return F.when(F.col("doc_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("doc_id").cast("string"))).alias(name)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; in local mode, where none is set, a folder of our own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder.

    ``narrow``: for short rows; they are written in no more parts than the cluster has cores, so that small results
    do not become many small files.
    """
    shared_folder(df.sparkSession)
    return (df.coalesce(df.sparkSession.sparkContext.defaultParallelism) if narrow else df).checkpoint()


def join_spread(rows: DataFrame, values: DataFrame, key: str, hot: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row a key), inner, without one task for a key that many rows share.

    Keys with more than 1/``hot`` of all rows, fewer than ``hot`` of them at any size of the data, are joined by
    broadcast; all others by shuffle. ``rows`` should be cut: they are read three times.
    """
    total = rows.count()
    often = rows.groupBy(key).count().filter(F.col("count") * hot > total).select(key)
    few = cut(values.join(F.broadcast(often), key, "left_semi"))
    by_broadcast = rows.join(F.broadcast(few), key)
    return rows.join(F.broadcast(few.select(key)), key, "left_anti").join(values, key).unionByName(by_broadcast)


def count_of(text: Column, char_class: str) -> Column:
    """How many characters of a text fall in a regex class."""
    return (F.length(text) - F.length(F.regexp_replace(text, char_class, ""))).cast("long")
