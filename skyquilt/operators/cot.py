"""Operator events in XML: decoding, routing and projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.text import entity_id, entity_token, first_text, wkt_point
from skyquilt.operators.triples import provenance, settled, time_text, to_triples_of

SHAPE = """_uid string, _type string, _how string, _time string, _start string, _stale string,
point struct<_lat string, _lon string, _hae string, _ce string, _le string>,
detail struct<contact struct<_callsign string>, track struct<_course string, _speed string>, remarks string,
__chat struct<_message string, _senderUid string, _sender_uid string, _VALUE string>>, _corrupt_record string"""
ROOT = r"^\s*(<\?xml[^>]*\?>)?\s*<event[\s>/]"


def classify(kind: Column) -> Column:
    """D3: the class of an event type, by prefix."""
    starts = lambda *p: [kind.startswith(x) for x in p]
    air, operator, marker = starts("a-f-A", "a-h-A"), starts("a-f-G", "a-h-G"), starts("u-d-p", "b-m-p")
    return F.when(kind.startswith("b-t-f"), "geochat").when(marker[0] | marker[1], "marker").when(operator[0] | operator[1], "operator").when(air[0] | air[1], "air").when(kind.startswith("b-a-"), "alert").otherwise("other")


def decode(raw: DataFrame, xml: str = "raw_xml") -> DataFrame:
    """The input with the event's columns and error. uid and type are required, times and numbers must parse."""
    df = settled(raw.withColumn("__e", F.from_xml(F.col(xml), SHAPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})))
    text = lambda path: F.nullif(F.trim(F.col(f"__e.{path}")), F.lit(""))
    number = lambda path: F.col(f"__e.{path}").try_cast("double")
    names = {"time": "_time", "start": "_start", "stale": "_stale"}
    df = df.withColumns({n: text(p) for n, p in {"uid": "_uid", "type": "_type", "how": "_how", "callsign": "detail.contact._callsign", "remarks": "detail.remarks"}.items()})
    df = df.withColumns({n: F.try_to_timestamp(text(p)) for n, p in names.items()})
    point = F.struct(*[number(f"point._{n}").alias(n) for n in ("lat", "lon", "hae", "ce", "le")])
    df = df.withColumn("point", F.when(F.col("__e.point").isNotNull(), point))
    df = df.withColumn("has_track", F.col("__e.detail.track").isNotNull()).withColumn("course", number("detail.track._course")).withColumn("speed", number("detail.track._speed"))
    df = settled(df)
    chat = first_text(F.col("__e.detail.__chat._message"), F.col("__e.detail.__chat._VALUE"), F.when(classify(F.col("type")) == "geochat", F.col("remarks")))
    df = df.withColumn("chat_text", chat).withColumn("sender_uid", first_text(F.col("__e.detail.__chat._senderUid"), F.col("__e.detail.__chat._sender_uid")))
    bad_time = F.lit(False)
    for n, p in names.items():
        bad_time = bad_time | (text(p).isNotNull() & F.col(n).isNull())
    bad_number = F.lit(False)
    for p in ("point._lat", "point._lon", "detail.track._course", "detail.track._speed"):
        bad_number = bad_number | F.coalesce(text(p).isNotNull() & number(p).isNull(), F.lit(False))
    malformed = F.col("__e").isNull() | F.col("__e._corrupt_record").isNotNull() | ~F.col(xml).rlike(ROOT)
    error = F.when(malformed, "malformed").when(F.col("uid").isNull(), "no uid").when(F.col("type").isNull(), "no type").when(bad_time, "bad time").when(bad_number, "bad number")
    return settled(df.withColumn("error", error).drop("__e"))


def route(df: DataFrame) -> DataFrame:
    """Adds route: advisory, task or track; null gives no output."""
    kind = classify(F.col("type"))
    return df.withColumn("route", F.when(kind == "geochat", "advisory").when(kind == "marker", "task").when(kind.isin("operator", "air"), "track"))


def event_status(kind: Column) -> Column:
    """Active or stale, with the kind."""
    state = F.when(F.coalesce("time", "received_at") > F.col("stale"), "stale").otherwise("active")
    return F.concat_ws(".", state, kind)


def _texts() -> tuple[Column, Column, Column]:
    """Name, text and sender of an event."""
    return first_text(F.col("callsign"), F.col("uid")), first_text(F.col("chat_text"), F.col("remarks")), first_text(F.col("sender_uid"), F.col("callsign"))


def sightings(decoded: DataFrame, org: str, platform: str) -> DataFrame:
    """The good events that give an entity, with route and subject: tracks and tasks that say something, advisories with a text."""
    usable = {
        "track": F.col("point").isNotNull() | F.col("has_track"),
        "task": F.col("point").isNotNull() | F.col("callsign").isNotNull() | F.col("remarks").isNotNull(),
        "advisory": _texts()[1].isNotNull(),
    }
    good = route(decoded.filter(F.col("error").isNull()))
    some = reduce(lambda x, y: x | y, [(F.col("route") == kind) & said for kind, said in usable.items()])
    return good.filter(some).withColumn("subject", entity_id(F.lit(org), F.lit(platform), F.lit("tak"), F.col("route"), entity_token(F.col("uid"))))


def _seen() -> Column:
    return F.coalesce("time", "received_at")


def _pairs(confidence: float) -> dict[str, list]:
    native = F.concat(F.lit("cot.uid."), F.trim("uid"))
    position = F.when(F.col("point.lat").isNotNull() & F.col("point.lon").isNotNull(), wkt_point(F.col("point.lon"), F.col("point.lat")))
    motion = F.when(F.col("has_track"), F.format_string("COURSE_SPEED_MPS(%.2f %.2f)", F.round(F.coalesce("course", F.lit(0.0)) * 100) / 100, F.round(F.coalesce("speed", F.lit(0.0)) * 100) / 100))
    air = classify(F.col("type")) == "air"
    name, text, sender = _texts()
    made = {
        "track": [("native_id", "string", native), ("observed_at", "time", time_text(_seen())), ("status", "string", event_status(F.when(air, "air-track").otherwise("operator"))), ("position", "string", position), ("velocity", "string", motion)],
        "task": [("native_id", "string", native), ("name", "string", name), ("kind", "string", F.lit("marker")), ("status", "string", event_status(F.lit("marker"))), ("position", "string", position), ("description", "string", F.col("remarks"))],
        "advisory": [("native_id", "string", native), ("text", "string", text), ("kind", "string", F.lit("geochat")), ("status", "string", event_status(F.lit("geochat"))), ("sender", "string", sender), ("position", "string", position)],
    }
    said = {kind: [(f"cop.{kind}.{n}", t, o) for n, t, o in pairs] for kind, pairs in made.items()}
    said["asset"] = [("cop.asset.name", "string", name), ("cop.asset.kind", "string", F.lit("tak-cot-source")), ("cop.asset.source", "string", F.lit("tak-cot")), ("cop.asset.native_id", "string", native)]
    return said


def project_planned(planned: DataFrame, org: str, platform: str, confidence: float, keep: list[str]) -> DataFrame:
    """P7-P10 in one pass over ``sightings`` with their ``kind``: tracks, tasks and advisories by route, and on the create of a track its source asset and the edge to it."""
    said, provenance_ = _pairs(confidence), provenance("tak-cot", _seen(), F.lit(confidence), F.col("ref"))
    asset = entity_id(F.lit(org), F.lit(platform), "tak", "asset", entity_token(F.col("uid")))
    created = (F.col("route") == "track") & (F.col("kind") == "create")
    parts = [
        (F.col("subject"), provenance_, None),
        *[(F.col("subject"), said[kind], F.col("route") == kind) for kind in ("track", "task", "advisory")],
        (asset, provenance_ + said["asset"], created),
        (F.col("subject"), [("cop.track.source", "entity", asset)], created),
    ]
    return to_triples_of(planned, parts, keep, _seen(), F.lit("tak-cot"), F.lit(confidence))
