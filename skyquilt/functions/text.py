"""Scalar rules on names, positions, times and statuses, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_POINT = r"^\s*POINT\(\s*([^\s()]+)\s+([^\s()]+)\s*\)\s*$"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas, where Spark repeats what is used twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_text(*values: Column) -> Column:
    """The first value that is not blank, trimmed; null if all are."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def entity_token(value: Column) -> Column:
    """P20: lower-cased, runs outside a-z, 0-9, _ and - become one dash, outer dashes trimmed; blank: unknown."""
    slug = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[^a-z0-9_-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(slug, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def entity_id(org: Column, platform: Column, system: str | Column, kind: str | Column, instance: Column) -> Column:
    """P20: the six-part id of an entity in the domain ``cop``."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat_ws(".", org, platform, F.lit("cop"), as_column(system), as_column(kind), instance)


def sanitize_source(value: Column) -> Column:
    """Lower-cased; letters, digits, full stops and underscores stay, other runs become one dash; blank: default."""
    slug = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{Nd}._]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(slug, "^-+|-+$", ""), F.lit("")), F.lit("default"))


def ref_segment(value: Column) -> Column:
    """Lower-cased and trimmed; a-z, digits, full stops, dashes and underscores stay, each other character becomes a dash of its own; outer dashes go; blank: unknown."""
    low = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"^\s+|\s+$", "")
    slug = F.regexp_replace(low, "[^a-z0-9._-]", "-")
    return F.coalesce(F.nullif(F.regexp_replace(slug, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def infer_encoding(configured: Column, content_type: Column) -> Column:
    """The configured encoding, else by content type; null is a reject."""
    low = F.lower(content_type)
    return F.coalesce(F.nullif(F.lower(F.trim(configured)), F.lit("")), F.when(low.contains("json"), "json").when(low.contains("protobuf"), "protobuf"))


def wkt_point(lon: Column, lat: Column) -> Column:
    """A point as text with seven decimals."""
    return F.format_string("POINT(%.7f %.7f)", lon, lat)


def wkt_lon(text: Column) -> Column:
    """Longitude of a point text; null where it is no point."""
    return F.when(wkt_ok(text), F.regexp_extract(text, _POINT, 1).try_cast("double"))


def wkt_lat(text: Column) -> Column:
    """Latitude of a point text."""
    return F.when(wkt_ok(text), F.regexp_extract(text, _POINT, 2).try_cast("double"))


def wkt_ok(text: Column) -> Column:
    parts = [F.regexp_extract(text, _POINT, k).try_cast("double").isNotNull() for k in (1, 2)]
    return F.coalesce(text.rlike(_POINT) & parts[0] & parts[1], F.lit(False))


def freshness_status(status: Column, now: Column, at: Column, window: Column) -> Column:
    """A status older than the window becomes stale, keeping what follows its first full stop."""
    old = (now - at) > window
    dot = F.locate(".", status)
    rest = F.when(dot > 0, F.substring(status, dot, F.length(status))).otherwise("")
    already = (status == "stale") | status.startswith("stale.")
    return F.when(old & ~already, F.concat(F.lit("stale"), rest)).otherwise(status)


def age_label(now: Column, at: Column) -> Column:
    """The age in seconds, minutes or hours, rounded; a time in the future has age 0; null: unknown."""
    s = F.greatest(F.lit(0.0), F.unix_micros(now) / 1e6 - F.unix_micros(at) / 1e6)
    r = F.round(s).cast("long")
    m = F.round(s / 60).cast("long")
    label = F.when(r < 60, F.concat(r.cast("string"), F.lit("s"))).when(m < 60, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.concat(F.round(s / 3600).cast("long").cast("string"), F.lit("h")))
    return F.coalesce(label, F.lit("unknown"))


def source_of(entity: Column) -> Column:
    """The feed of an entity, from the system part of its id."""
    system = F.split_part(entity, F.lit("."), F.lit(4))
    return F.when(system == "tak", "tak-cot").otherwise(system)


def source_label(source: Column) -> Column:
    """The name of a discovery source for people."""
    return F.when(source == "mavlink", "MAVLink").when(source == "tak", "TAK/CoT").when(source == "cap", "CAP").when(source == "adsb", "ADS-B").otherwise(source)


def track_label(entity: Column, native_id: Column) -> Column:
    """A name for a track, by its feed."""
    system, instance = F.split_part(entity, F.lit("."), F.lit(4)), F.split_part(entity, F.lit("."), F.lit(6))
    call = F.regexp_extract(native_id, r"\.callsign\.(.+?)\.source\.", 1)
    icao = F.regexp_extract(native_id, r"^adsb\.icao24\.([^.]+)", 1)
    aircraft = first_text(F.upper(call), F.upper(icao), instance)
    uid = F.regexp_extract(native_id, r"^cot\.uid\.(.+)$", 1)
    vehicle = F.concat(F.lit("UAS "), F.regexp_replace(instance, "^system-", ""))
    return F.when(system == "mavlink", vehicle).when(system == "adsb", aircraft).when(system == "tak", first_text(uid, instance)).when(instance.startswith("system-"), vehicle).otherwise(instance)


def cap_ref(source: Column, identifier: Column, received_at: Column) -> Column:
    """The reference of a warning."""
    return F.concat_ws("/", F.lit("cap://raw"), ref_segment(source), ref_segment(identifier), (F.unix_micros(received_at) * 1000).cast("string"))


def owner_of(source: Column) -> Column:
    """The owner of what a source says."""
    return F.when(source == "mavlink", "feed.mavlink").when(source == "tak-cot", "feed.tak").when(source == "cap", "feed.cap").when(source == "adsb", "feed.adsb").otherwise("fusion.structural")
