"""Civil warnings in XML: decoding, evidence and hazard rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.text import entity_id, entity_token, first_text, freshness_status, once
from skyquilt.operators.state import latest_property
from skyquilt.operators.triples import provenance, settled, to_triples

_PAIR = "array<struct<valueName string, value string>>"
_RESOURCE = "array<struct<resourceDesc string, mimeType string, uri string, digest string>>"
SHAPE = f"""identifier string, sender string, sent string, status string, msgType string, source string, scope string, references string,
info array<struct<language string, category array<string>, event string, urgency string, severity string, certainty string, effective string, expires string, senderName string,
headline string, description string, instruction string, web string, contact string, parameter {_PAIR}, resource {_RESOURCE},
area array<struct<areaDesc string, polygon array<string>, circle array<string>, geocode {_PAIR}>>>>, _corrupt_record string"""
ROOT = r"^\s*(<\?xml[^>]*\?>)?\s*<(\w+:)?alert[\s>/]"


def polygon(text: Column) -> Column:
    """array<struct<lat, lon>> of at least three points in range; null if it is no polygon."""
    def point(p: Column) -> Column:
        return F.struct(F.get(p, F.lit(0)).try_cast("double").alias("lat"), F.get(p, F.lit(1)).try_cast("double").alias("lon"), (F.size(p) == 2).alias("two"))

    def ring(points: Column) -> Column:
        good = F.forall(points, lambda x: F.coalesce(x["two"] & x["lat"].between(-90, 90) & x["lon"].between(-180, 180), F.lit(False)))
        return F.when(good & (F.size(points) >= 3), F.transform(points, lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))))

    return once(F.transform(F.split(F.trim(text), r"\s+"), lambda pair: once(F.split(pair, ","), point)), ring)


def circle(text: Column) -> Column:
    """struct<lat, lon, radius_km>; null if it is no circle with a radius."""
    def read(c: Column) -> Column:
        good = (c["n"] == 3) & c["lat"].between(-90, 90) & c["lon"].between(-180, 180) & (c["radius_km"] > 0)
        return F.when(good, F.struct(*[c[n].alias(n) for n in ("lat", "lon", "radius_km")]))

    parts = lambda p: F.struct(F.size(p).alias("n"), *[F.get(p, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("lat", "lon", "radius_km"))])
    return once(once(F.split(F.trim(text), r"[\s,]+"), parts), read)


def _text(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit(""))


def _pairs(values: Column) -> Column:
    """Name and value, trimmed; pairs without either are left out."""
    named = F.transform(F.coalesce(values, F.array()), lambda x: F.struct(_text(x["valueName"]).alias("name"), _text(x["value"]).alias("value")))
    return F.filter(named, lambda x: (x["name"] != "") | (x["value"] != ""))


def _area(a: Column) -> Column:
    shapes = lambda c, f: F.transform(F.coalesce(a[c], F.array()), f)
    return F.struct(_text(a["areaDesc"]).alias("area_desc"), shapes("polygon", polygon).alias("polygons"), shapes("circle", circle).alias("circles"), _pairs(a["geocode"]).alias("geocodes"))


def _info(i: Column) -> Column:
    """One info block, whole; texts are trimmed and never null."""
    plain = {"language": "language", "event": "event", "urgency": "urgency", "severity": "severity", "certainty": "certainty", "sender_name": "senderName", "headline": "headline", "description": "description", "instruction": "instruction", "web": "web", "contact": "contact"}
    resources = F.transform(F.coalesce(i["resource"], F.array()), lambda r: F.struct(_text(r["resourceDesc"]).alias("description"), _text(r["mimeType"]).alias("mime_type"), _text(r["uri"]).alias("uri"), _text(r["digest"]).alias("digest")))
    return F.struct(
        *[_text(i[c]).alias(n) for n, c in plain.items()],
        F.filter(F.transform(F.coalesce(i["category"], F.array()), _text), lambda c: c != "").alias("categories"),
        *[F.try_to_timestamp(F.nullif(_text(i[c]), F.lit(""))).alias(c) for c in ("effective", "expires")],
        _pairs(i["parameter"]).alias("parameters"), resources.alias("resources"), F.transform(F.coalesce(i["area"], F.array()), _area).alias("areas"),
    )


def _any_bad(given: Column, read: Column, name: str) -> Column:
    """Whether a time is given, not blank, and could not be read."""
    return (_text(given[name]) != "") & read[name].isNull()


def decode(raw: DataFrame, xml: str = "raw_xml") -> DataFrame:
    """Header, ``infos`` (all blocks with all areas and resources), the first info and its first area as columns, advisory text and error.

    Any bad time or shape rejects the alert; a rejected one has no infos.
    """
    df = settled(raw.withColumn("__c", F.from_xml(F.col(xml), SHAPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})))
    head = {n: F.nullif(F.trim(F.col(f"__c.{c}")), F.lit("")) for n, c in {"identifier": "identifier", "sender": "sender", "sent_text": "sent", "alert_status": "status", "msg_type": "msgType", "scope": "scope"}.items()}
    df = df.withColumns(head).withColumn("__i", F.get("__c.info", F.lit(0))).withColumn("__a", F.get("__i.area", F.lit(0)))
    text = lambda f: F.nullif(F.trim(F.col(f"__i.{f}")), F.lit(""))
    df = df.withColumns({n: text(n) for n in ("event", "urgency", "severity", "certainty", "headline", "description", "instruction", "senderName")}).withColumn("area_desc", F.trim("__a.areaDesc"))
    df = df.withColumns({n: F.try_to_timestamp(c) for n, c in {"sent": F.col("sent_text"), "effective": text("effective"), "expires": text("expires")}.items()})
    df = df.withColumns({"alert_source": _text(F.col("__c.source")), "references": _text(F.col("__c.references")), "infos": F.transform("__c.info", _info)})
    df = settled(df)  # so that every shape and list is read once
    first = F.get("infos", F.lit(0))
    area = F.get(first["areas"], F.lit(0))
    given = {c: F.when(F.col(f"__a.{c[:-1]}").isNotNull(), area[c]) for c in ("polygons", "circles")}
    none = F.array().cast("array<struct<name string, value string>>")
    df = df.withColumns(given | {"geocodes": F.coalesce(area["geocodes"], none), "parameters": F.coalesce(first["parameters"], none)})
    joined = F.array_join(F.array_compact(F.array("headline", "description", "instruction")), "\n\n")
    df = df.withColumn("advisory_text", first_text(joined, F.col("event"), F.col("identifier")))
    missing = F.greatest(*[F.col(n).isNull() for n in head])
    times = F.zip_with("__c.info", "infos", lambda i, x: _any_bad(i, x, "effective") | _any_bad(i, x, "expires"))
    bad_time = F.exists(times, lambda bad: bad)
    bad_shape = F.exists("infos", lambda i: F.exists(i["areas"], lambda a: F.exists(a["polygons"], lambda p: p.isNull()) | F.exists(a["circles"], lambda c: c.isNull())))
    malformed = F.col("__c").isNull() | F.col("__c._corrupt_record").isNotNull() | ~F.col(xml).rlike(ROOT)
    error = F.when(malformed, "malformed").when(missing, "missing header").when(F.coalesce(F.size("__c.info"), F.lit(0)) < 1, "no info").when(F.col("sent").isNull() | bad_time, "bad time").when(bad_shape, "bad shape")
    whole = settled(df.withColumn("error", error).drop("__c", "__i", "__a", "sent_text"))
    return whole.withColumn("infos", F.when(F.col("error").isNull(), F.col("infos")))


def confidence_of(certainty: Column, base: float) -> Column:
    """P16."""
    low = F.lower(certainty)
    return F.when(low == "observed", 0.95).when(low == "likely", 0.82).when(low == "possible", 0.58).when(low == "unlikely", 0.35).when(low == "unknown", 0.4).otherwise(base)


#: The evidence document as it is read back.
_POINT, _NAMED = "struct<lat double, lon double>", "array<struct<name string, value string>>"
DOCUMENT = f"""identifier string, message_type string, status string, event string, urgency string, severity string, certainty string, area_desc string, sender string, sender_name string,
sent string, effective string, expires string, polygons array<array<{_POINT}>>, circles array<struct<center {_POINT}, radius_km double>>,
resources array<struct<description string, mime_type string, uri string, digest string>>, geocodes {_NAMED}, parameters {_NAMED}"""


def document(decoded: DataFrame) -> Column:
    """The evidence document as JSON, of the first info and its first area; empty lists, times and digests are left out."""
    i = F.get("infos", F.lit(0))
    a = F.get(i["areas"], F.lit(0))
    full = lambda c, n: F.when(F.size(c) > 0, c).alias(n)
    time = lambda c, n: F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"\.?0*Z$", "Z").alias(n)
    circles = F.transform(a["circles"], lambda c: F.struct(F.struct(c["lat"].alias("lat"), c["lon"].alias("lon")).alias("center"), c["radius_km"].alias("radius_km")))
    resources = F.transform(i["resources"], lambda r: F.struct(r["description"].alias("description"), r["mime_type"].alias("mime_type"), r["uri"].alias("uri"), F.nullif(r["digest"], F.lit("")).alias("digest")))
    return F.to_json(F.struct(
        "identifier", F.col("msg_type").alias("message_type"), F.col("alert_status").alias("status"), *[i[c].alias(c) for c in ("event", "urgency", "severity", "certainty")],
        F.coalesce(a["area_desc"], F.lit("")).alias("area_desc"), "sender", i["sender_name"].alias("sender_name"), time("sent", "sent"), time(F.coalesce(i["effective"], "sent"), "effective"), time(i["expires"], "expires"),
        full(a["polygons"], "polygons"), full(circles, "circles"), full(resources, "resources"), full(a["geocodes"], "geocodes"), full(i["parameters"], "parameters"),
    ))


def evidence(decoded: DataFrame) -> DataFrame:
    """The good alerts with their evidence document and observed_at."""
    return decoded.filter("error is null").withColumn("evidence", document(decoded)).withColumn("observed_at", F.coalesce("effective", "sent"))


def project(decoded: DataFrame, org: str, platform: str, confidence: float, keep: list[str]) -> DataFrame:
    """Evidence triples of hazards, to be appended: advisory text, the document, source and provenance of each good alert (with ``ref``)."""
    rows = settled(evidence(decoded).withColumn("__sure", confidence_of(F.col("certainty"), confidence)))
    pairs = [("cop.hazard.advisory_text", "string", F.col("advisory_text")), ("cop.hazard.evidence", "json", F.col("evidence")), ("cop.hazard.source", "string", F.lit("cap"))]
    subject = entity_id(F.lit(org), F.lit(platform), "cap", "hazard_area", entity_token(F.col("identifier")))
    return to_triples(rows, subject, pairs + provenance("cap", F.col("observed_at"), F.col("__sure"), F.col("ref")), keep, F.col("observed_at"), F.lit("cap"), F.col("__sure"))


def hazards_of_evidence(triples: DataFrame, now: Column, window: Column) -> DataFrame:
    """V5, M3: hazards of three points or more, read back from appended evidence: of each property the latest, of equal times the one written last."""
    names = {"document": "cop.hazard.evidence", "text": "cop.hazard.advisory_text", "source": "cop.hazard.source", "source_ref": "cop.provenance.source_ref", "observed": "cop.provenance.observed_at", "sure": "cop.provenance.confidence"}
    latest = latest_property(triples.filter(F.col("predicate").isin(*names.values())))
    wide = latest.groupBy("subject").agg(*[F.max(F.when(F.col("predicate") == p, F.col("object"))).alias(n) for n, p in names.items()])
    d = F.col("d")
    read = settled(wide.withColumn("d", F.from_json("document", DOCUMENT)))
    known = (F.coalesce(d["identifier"], F.lit("")) != "") | (F.coalesce(d["event"], F.lit("")) != "") | d["polygons"].isNotNull() | d["circles"].isNotNull()
    round_ = F.transform(F.coalesce(d["circles"], F.array()), lambda c: F.struct(c["center"]["lat"].alias("lat"), c["center"]["lon"].alias("lon"), c["radius_km"].alias("radius_km")))
    shaped = settled(read.filter(known).withColumn("geometry", hazard_geometry(F.coalesce(d["polygons"], F.array()), round_)).withColumn("updated_at", F.try_to_timestamp("observed")))
    status = hazard_status(d["status"], d["message_type"], F.try_to_timestamp(d["expires"]), now, F.col("updated_at"), window)
    instance = F.split_part("subject", F.lit("."), F.lit(6))
    return shaped.filter(F.size("geometry") >= 3).select("subject", hazard_label(d["event"], F.col("text"), instance, d["area_desc"]).alias("label"), hazard_kind(d["event"]).alias("kind"), F.lower(F.coalesce(F.nullif(d["severity"], F.lit("")), F.lit("unknown"))).alias("severity"), status.alias("status"), "geometry", F.coalesce("source", F.lit("cap")).alias("source"), "updated_at", F.col("sure").try_cast("double").alias("confidence"), F.coalesce("source_ref", F.lit("")).alias("source_ref"))


def hazard_status(status: Column, msg_type: Column, expires: Column, now: Column, updated: Column, window: Column) -> Column:
    """V6."""
    ended = F.when(F.lower(msg_type) == "cancel", "cancelled").when(F.lower(msg_type) == "error", "error").when(F.lower(msg_type) == "ack", "acknowledged").when(expires <= now, "expired")
    live = freshness_status(F.when(F.lower(msg_type) == "update", "active.update").otherwise("active"), now, updated, window)
    return F.when(F.lower(status) != "actual", F.concat(F.lit("nonoperational."), F.lower(status))).otherwise(F.coalesce(ended, live))


def circle_to_polygon(c: Column, n: int = 24) -> Column:
    """V8: a circle as a polygon of n points; null where a degree of longitude has no length or the radius none."""
    scale = F.cos(F.radians(c["lat"]))
    dlat = c["radius_km"] * (1 / 111.32)
    dlon = dlat * F.pow(scale, F.lit(-1.0))
    around = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((c["lat"] + dlat * F.sin(i * (2 * math.pi / n))).alias("lat"), (c["lon"] + dlon * F.cos(i * (2 * math.pi / n))).alias("lon")))
    return F.when((F.abs(scale) >= 0.001) & (c["radius_km"] > 0), around)


def hazard_geometry(polygons: Column, circles: Column) -> Column:
    """V7: the first polygon of three points or more, else the first usable circle."""
    first = F.get(F.filter(polygons, lambda p: F.size(p) >= 3), F.lit(0))
    return F.coalesce(first, F.get(F.filter(F.transform(circles, lambda c: circle_to_polygon(c)), lambda p: p.isNotNull()), F.lit(0)))


def hazard_label(event: Column, text: Column, instance: Column, area: Column) -> Column:
    """V9."""
    name = first_text(event, text, instance)
    return F.when((F.coalesce(area, F.lit("")) != "") & ~F.contains(name, area), F.concat(name, F.lit(": "), area)).otherwise(name)


def hazard_kind(event: Column) -> Column:
    """V9."""
    return F.concat(F.lit("cap-"), F.replace(F.lower(F.trim(event)), F.lit(" "), F.lit("-")))


def hazards(documents: DataFrame, now: Column, window: Column, org: str, platform: str, confidence: float = 0.9) -> DataFrame:
    """V5: hazards of three points or more from ``evidence`` rows, the latest by identifier; of equal times the later arrival."""
    used = ("certainty", "source_ref", "alert_status", "msg_type", "severity", "event", "advisory_text", "area_desc", "expires", "polygons", "circles")
    documents = documents if "source_ref" in documents.columns else documents.withColumn("source_ref", F.lit(""))
    last = documents.groupBy("identifier").agg(F.max("observed_at").alias("updated_at"), F.max_by(F.struct(*used), F.struct("observed_at", *[c for c in ("batch", "arrival") if c in documents.columns])).alias("d")).select("identifier", "updated_at", "d.*")
    usable = F.filter("polygons", lambda p: p.isNotNull())
    shaped = settled(last.withColumn("geometry", hazard_geometry(F.coalesce(usable, F.array()), F.coalesce("circles", F.array()))))
    status = hazard_status(F.col("alert_status"), F.col("msg_type"), F.col("expires"), now, F.col("updated_at"), window)
    subject = entity_id(F.lit(org), F.lit(platform), "cap", "hazard_area", entity_token(F.col("identifier")))
    label = hazard_label(F.col("event"), F.col("advisory_text"), F.col("identifier"), F.col("area_desc"))
    return shaped.filter(F.size("geometry") >= 3).select(subject.alias("subject"), label.alias("label"), hazard_kind(F.col("event")).alias("kind"), F.lower(F.coalesce("severity", F.lit("unknown"))).alias("severity"), status.alias("status"), "geometry", "updated_at", confidence_of(F.col("certainty"), confidence).alias("confidence"), "source_ref")
