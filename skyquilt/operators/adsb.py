"""Aircraft state snapshots in JSON: decoding and projection.

Values are read as variants, so a number is told from a string that looks like one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.folders import stored
from skyquilt.functions.text import entity_id, entity_token, wkt_point
from skyquilt.operators.triples import provenance, settled, time_text, to_triples

# Fixed values: (name, position, kind, required); a leading ? allows an absent element.
FIELDS = (
    ("icao24", 0, "string", True), ("callsign", 1, "string", False), ("origin_country", 2, "string", True), ("time_position", 3, "number", False), ("last_contact", 4, "number", True),
    ("longitude", 5, "number", False), ("latitude", 6, "number", False), ("baro_altitude", 7, "number", False), ("on_ground", 8, "boolean", True), ("velocity", 9, "number", False),
    ("true_track", 10, "number", False), ("vertical_rate", 11, "number", False), ("geo_altitude", 13, "number", False), ("squawk", 14, "string", False), ("spi", 15, "boolean", True), ("position_source", 16, "number", False),
)
LEAST = 17


def position_source_label(code: Column) -> Column:
    """D11."""
    return F.when(code == 0, "ads-b").when(code == 1, "asterix").when(code == 2, "mlat").when(code == 3, "flarm").otherwise("unknown")


def decode(raw: DataFrame, key: str, text: str = "raw_json") -> DataFrame:
    """One row per state vector of a good snapshot (``key`` names it); one bad row rejects its snapshot.

    Rejected snapshots give one row with an error and no state. No row holds the text of its snapshot, which would grow
    with the square of the states in it. The states are read once and stored.
    """
    v = F.try_parse_json(F.col(text))
    base = settled(raw.withColumn("__v", v).drop(text)).withColumn("snapshot_time", F.try_variant_get("__v", "$.time", "bigint")).withColumn("__s", F.try_variant_get("__v", "$.states", "array<variant>"))
    head = F.when(F.col("__v").isNull(), "malformed").when(F.coalesce("snapshot_time", F.lit(0)) <= 0, "no time").when(F.col("__s").isNull(), "no states")
    plain = [c for c in raw.columns if c != text]
    rows = base.select(*plain, "snapshot_time", head.alias("__head"), F.posexplode_outer(F.when(head.isNull(), F.col("__s"))).alias("state_no", "__row"))
    rows = settled(rows.withColumn("__a", F.try_variant_get("__row", "$", "array<variant>")))
    bad: list[Column] = []
    for name, at, kind, required in FIELDS:
        x = F.get("__a", F.lit(at))
        type_ = F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
        ok = {"string": type_ == "STRING", "boolean": type_ == "BOOLEAN", "number": type_.isin("BIGINT", "DOUBLE", "FLOAT") | type_.startswith("DECIMAL")}[kind]
        value = F.try_variant_get(x, "$", {"string": "string", "boolean": "boolean", "number": "double"}[kind])
        value = F.nullif(F.trim(value), F.lit("")) if kind == "string" else value
        rows = rows.withColumn(name, value)
        bad.append(~ok & (F.lit(True) if required else type_ != "VOID"))
        if required and kind != "boolean":
            bad.append(F.col(name).isNull() if kind == "string" else F.coalesce(F.col(name) <= 0, F.lit(True)))
    wrong = F.coalesce(F.size("__a") < LEAST, F.lit(True)) | reduce(lambda x, y: x | y, bad)
    error = F.coalesce("__head", F.when(F.col("state_no").isNotNull() & wrong, "bad state"))
    rows = rows.withColumn("error", error).drop("__row", "__a", "__head")
    rows = stored(rows.withColumn("time_position", F.when(F.col("time_position") > 0, F.col("time_position"))))
    spoiled = rows.filter("error is not null").groupBy(key).agg(F.min("error").alias("__bad"))
    joined = rows.join(spoiled, key, "left")
    good = joined.filter("__bad is null and state_no is not null").drop("__bad")
    rejected = joined.filter("__bad is not null").withColumn("error", F.col("__bad")).dropDuplicates([key]).drop("__bad")
    blank = [F.lit(None).cast(good.schema[c].dataType).alias(c) if c in {f[0] for f in FIELDS} | {"state_no"} else F.col(c) for c in good.columns]
    return good.unionByName(rejected.select(*blank))


def confidence_of(base: float, code: Column) -> Column:
    """The base confidence, capped by position source."""
    cap = F.when(code == 0, 1.0).when(code == 1, 0.8).when(code == 2, 0.75).when(code == 3, 0.65).otherwise(0.5)
    return F.least(F.lit(base), cap)


def native_id(icao24: Column, callsign: Column, code: Column) -> Column:
    """P14."""
    call = F.when(callsign.isNotNull(), F.concat(F.lit("callsign."), entity_token(callsign)))
    return F.concat_ws(".", F.lit("adsb.icao24"), entity_token(icao24), call, F.lit("source"), position_source_label(code))


def motion(velocity: Column, track: Column, rate: Column) -> Column:
    """The motion text, with unknown for what is missing; null if all is."""
    part = lambda x: F.coalesce(F.format_string("%.2f", F.round(x * 100) / 100), F.lit("unknown"))
    shown = [F.when(x.isNotNull(), part(x)).otherwise("unknown") for x in (velocity, track, rate)]
    return F.when(F.coalesce(velocity, track, rate).isNotNull(), F.concat(F.lit("AIR_MOTION_MPS("), F.concat_ws(" ", *shown), F.lit(")")))


def project(decoded: DataFrame, org: str, platform: str, confidence: float, keep: list[str]) -> DataFrame:
    """Triples of aircraft tracks; they have no source edge."""
    seen = F.timestamp_seconds(F.coalesce("time_position", "last_contact"))
    sure = confidence_of(confidence, F.col("position_source"))
    position = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), wkt_point(F.col("longitude"), F.col("latitude")))
    pairs = [
        ("cop.track.native_id", "string", native_id(F.col("icao24"), F.col("callsign"), F.col("position_source"))),
        ("cop.track.status", "string", F.when(F.col("on_ground"), "active.aircraft.ground").otherwise("active.aircraft")),
        ("cop.track.observed_at", "time", time_text(seen)),
        *provenance("adsb", seen, sure, F.col("ref")),
        ("cop.track.position", "string", position),
        ("cop.track.velocity", "string", motion(F.col("velocity"), F.col("true_track"), F.col("vertical_rate"))),
    ]
    subject = entity_id(entity_token(F.lit(org)), entity_token(F.lit(platform)), "adsb", "track", entity_token(F.col("icao24")))
    return to_triples(decoded.filter("error is null"), subject, pairs, keep, seen, F.lit("adsb"), sure)
