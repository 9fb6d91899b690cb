"""Replay files, streams and landed responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.operators.order import before, numbered

SCHEMAS = {
    "mavlink": "Ref string, Source string, ReceivedAt timestamp, Version int, Sequence int, SystemID int, ComponentID int, MessageID int, Checksum int, Frame string",
    "cot": "Ref string, Source string, ReceivedAt timestamp, UID string, Type string, Callsign string, StaleAt timestamp, RawXML string",
    "cap": "Ref string, Source string, ReceivedAt timestamp, Identifier string, MsgType string, SentAt timestamp, RawXML string",
    "adsb": "Ref string, Source string, ReceivedAt timestamp, SnapshotAt timestamp, RawJSON string",
    "sapient": "Ref string, Source string, ReceivedAt timestamp, Encoding string, Content string, NodeID string, DestinationID string, MessageAt timestamp, RawPayload string",
}
PAYLOAD = {"mavlink": "Frame", "cot": "RawXML", "cap": "RawXML", "adsb": "RawJSON", "sapient": "RawPayload"}
MAX_RESPONSE = 4 << 20


def scan_replay(spark: SparkSession, feed: str, path: str) -> DataFrame:
    """JSON-Lines records with the payload as bytes; a missing path is an empty table; a record without ref or payload fails."""
    from pyspark.errors import AnalysisException

    name = PAYLOAD[feed]
    try:
        raw = spark.read.schema(SCHEMAS[feed]).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], SCHEMAS[feed])
    whole = (F.coalesce("Ref", F.lit("")) != "") & (F.coalesce(name, F.lit("")) != "")
    return raw.withColumn(name, F.when(whole, F.unbase64(name)).otherwise(F.raise_error(F.lit("replay record without ref or payload")).cast("binary")))


def replay_rejects(spark: SparkSession, feed: str, path: str) -> DataFrame:
    """(position, error) of the records that ``scan_replay`` fails on; position: from 1, by line, files in order of their names."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    placed = numbered(lines, "file", "block", "line", name="position").withColumn("r", F.from_json("value", f"{SCHEMAS[feed]}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    blank = lambda c: F.coalesce(F.trim(f"r.{c}"), F.lit("")) == ""
    error = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "malformed").when(blank("Ref"), "no ref").when(blank(PAYLOAD[feed]), "no payload")
    return placed.select("position", error.alias("error")).filter("error is not null")


def append_replay(df: DataFrame, feed: str, path: str) -> None:
    """Append one JSON line per record; refuses records without ref or payload."""
    name = PAYLOAD[feed]
    whole = (F.coalesce("Ref", F.lit("")) != "") & (F.coalesce(F.octet_length(name), F.lit(0)) > 0)
    text = F.when(whole, F.base64(F.col(name))).otherwise(F.raise_error(F.lit("replay record without ref or payload")))
    df.withColumn(name, text).write.mode("append").json(path)


def valid_raw(payload: Column) -> Column:
    """S3: whether a raw payload row (source, received_at, status_code, encoding) is whole; a null status is none, a null encoding is not asked for."""
    status = F.coalesce("status_code", F.lit(0))
    known = F.col("encoding").isNull() | F.col("encoding").isin("json", "protobuf")
    return F.coalesce((F.trim("source") != "") & F.col("received_at").isNotNull() & (F.octet_length(payload) > 0) & ((status == 0) | status.between(100, 599)) & known, F.lit(False))


RAW = "source string, received_at timestamp, status_code int, encoding string, payload string"


def read_raw_stream(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """S3: a stream of raw payload rows (RAW and the columns of ``more``) from landed JSON files, with ``valid``."""
    return spark.readStream.schema(RAW + (f", {more}" if more else "")).json(path).withColumn("valid", valid_raw(F.col("payload")))


def read_cot_lines(spark: SparkSession, path: str, max_bytes: int = 1 << 20) -> DataFrame:
    """Newline-framed XML events with an error for oversize lines."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.col("value").alias("raw_xml"), F.when(F.octet_length("value") > max_bytes, "oversize").alias("error"))


def landed_responses(df: DataFrame, key: str, at: str, max_bytes: int = MAX_RESPONSE, ranges: int | None = None) -> DataFrame:
    """Adds outcome: publish, unchanged (304 or the validator of the last good response), oversize or error.

    The validator goes from range to range of (key, at), so no endpoint's history is scanned in one task.
    """
    good = F.col("status_code").between(200, 299)
    known = before(df, [key], [at], ranges, __last=(F.when(good, F.col("etag")), "last"))
    same = F.coalesce(F.col("etag") == F.col("__last"), F.lit(False))
    outcome = F.when(F.col("status_code") == 304, "unchanged").when(~good, "error").when(F.col("size") > max_bytes, "oversize").when(same, "unchanged").otherwise("publish")
    return known.withColumn("outcome", outcome).drop("__last")


def split_rejects(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded rows and rejects of one decode job."""
    return decoded.filter("error is null"), decoded.filter("error is not null")


def captured(decoded: DataFrame, feed: str) -> DataFrame:
    """What the lane and the replay keep of decoded records: rejects too, their headline null, but warnings only after a good parse."""
    return split_rejects(decoded)[0] if feed == "cap" else decoded


def validate_inputs(inputs: DataFrame) -> DataFrame:
    """Adds error: inputs need a name, a reference and a payload."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return inputs.withColumn("error", F.when(blank("name"), "no name").when(blank("ref"), "no ref").when(F.coalesce(F.octet_length("payload"), F.lit(0)) == 0, "no payload"))
