"""Registered queries of the operating-picture engine and their SQL.

The SQL starts from the source columns of the given tables, so what goes through bytes, XML or JSON is checked
by a round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.functions import text as tx
from skyquilt.functions.folders import stored
from skyquilt.operators import adsb, cap, contracts, cot, lane, mavlink, sapient, state, views
from skyquilt.plans import lenses
from skyquilt.sources import replay

ORG, PLATFORM, SURE = "org", "edge", 0.9
KEEP = ["batch", "arrival"]


def now():
    return F.lit("2024-01-31T00:00:00Z").cast("timestamp")


def window():
    return F.expr("interval 6 hours")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# -- shared pieces ---------------------------------------------------------------------------------------

_E = """WITH e AS (SELECT event_id, ts, user_id, event_type, value, (props->>'k')::BIGINT AS k, user_id % 150 + 1 AS sys FROM events),
usable AS (SELECT * FROM e WHERE event_type IN ('view', 'click', 'purchase', 'signup')) """


def vehicle_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of vehicle tracks and assets, with the source edge on the create. Births read the sightings twice, the decoding is done once."""
    seen = mavlink.usable(mavlink.decode(lenses.frames(spark, sf_dir))).withColumn("subject", mavlink.subject_of(ORG, PLATFORM, "track"))
    seen = stored(seen.select(*KEEP, "subject", "system_id", "component_id", "received_at", "ref", "heartbeat", "global_position_int", "attitude", "battery_status"))
    return mavlink.project_planned(state.plan_births(seen), ORG, PLATFORM, SURE, KEEP)


def operator_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of operators' tracks, tasks and advisories, with the source asset of each track and the edge to it."""
    seen = cot.sightings(cot.decode(lenses.cot_events(spark, sf_dir)), ORG, PLATFORM)
    seen = stored(seen.select(*KEEP, "subject", "route", "uid", "type", "time", "stale", "received_at", "ref", "callsign", "remarks", "chat_text", "sender_uid", "point", "has_track", "course", "speed"))
    return cot.project_planned(state.plan_births(seen), ORG, PLATFORM, SURE, KEEP)


def aircraft_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adsb.project(adsb.decode(lenses.snapshots(spark, sf_dir), "slot"), ORG, PLATFORM, 0.85, KEEP)


def all_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vehicle_triples(spark, sf_dir).unionByName(operator_triples(spark, sf_dir)).unionByName(aircraft_triples(spark, sf_dir))


def track_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.tracks(state.wide(state.current_state(vehicle_triples(spark, sf_dir))), now(), window())


@query(
    "v2_vehicles_with_assets",
    _E + """, pos AS (SELECT sys, arg_max(event_id, event_id) AS p FROM usable WHERE event_type = 'view' GROUP BY sys),
    beat AS (SELECT sys, arg_max(CASE k % 6 WHEN 3 THEN 'standby' WHEN 4 THEN 'active' ELSE 'unknown' END || CASE WHEN ((k * 5) % 256) & 128 <> 0 THEN '.armed' ELSE '' END, event_id) AS s FROM usable WHERE event_type = 'click' GROUP BY sys),
    seen AS (SELECT sys, arg_max(ts, event_id) AS seen_at FROM usable GROUP BY sys)
    SELECT 'org.edge.cop.mavlink.track.system-' || sys AS track, 'UAS ' || sys AS label, 'MAVLink system ' || sys AS asset_name,
      CASE WHEN TIMESTAMP '2024-01-31' - seen_at > INTERVAL 6 HOUR THEN 'stale' || CASE WHEN coalesce(s, '') LIKE '%.armed' THEN '.armed' ELSE '' END ELSE coalesce(s, 'unknown') END AS status,
      ((p * 104729) % 2000000000 - 1000000000) / 1e7 AS lon, ((p * 7919) % 1000000000 - 500000000) / 1e7 AS lat
    FROM pos JOIN seen USING (sys) LEFT JOIN beat USING (sys)""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, status and freshness of every vehicle, with its asset."""
    triples = vehicle_triples(spark, sf_dir)
    wide = state.wide(state.current_state(triples))
    tracks = views.tracks(wide, now(), window())
    assets = views.assets(wide, tracks).select(F.col("subject").alias("track_source"), F.col("name").alias("asset_name"))
    joined = tracks.join(assets, "track_source", "left")
    return joined.select(F.col("subject").alias("track"), "label", "asset_name", "status", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


# -- scalars and the lane --------------------------------------------------------------------------------


@query("s6_infer_encoding", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'json' WHEN page_id % 5 = 1 THEN 'json' WHEN page_id % 5 = 2 THEN 'protobuf' END AS encoding FROM pages")
def s6(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    m = F.col("page_id") % 5
    kind = F.when(m == 1, "application/JSON; charset=utf-8").when(m == 2, "application/x-protobuf").when(m == 3, "text/html")
    return p.select("page_id", tx.infer_encoding(F.when(m == 0, " JSON ").otherwise(""), kind).alias("encoding"))


@query(
    "p20_entity_token",
    "SELECT c_custkey, coalesce(nullif(trim(regexp_replace(lower(trim(c_name || ' (' || c_mktsegment || ') É')), '[^a-z0-9_-]+', '-', 'g'), '-'), ''), 'unknown') AS token, coalesce(nullif(trim(regexp_replace(lower(c_name || '#A_b.c - ' || c_mktsegment), '[^\\p{L}\\p{Nd}._]+', '-', 'g'), '-'), ''), 'default') AS source FROM customer",
)
def p20(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", tx.entity_token(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(") É"))).alias("token"), tx.sanitize_source(F.concat("c_name", F.lit("#A_b.c - "), "c_mktsegment")).alias("source"))


@query(
    "v10_freshness_and_age",
    _E + "SELECT event_id, CASE WHEN TIMESTAMP '2024-01-31' - ts > INTERVAL 6 HOUR THEN 'stale.' || event_type ELSE 'active.' || event_type END AS status, CASE WHEN s < 59.5 THEN round(s)::BIGINT || 's' WHEN round(s / 60) < 60 THEN round(s / 60)::BIGINT || 'm' ELSE round(s / 3600)::BIGINT || 'h' END AS age FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-31') / 1e6 - epoch_us(ts) / 1e6 AS s FROM e)",
)
def v10(spark, sf_dir):
    e = lenses.events(spark, sf_dir)
    return e.select("event_id", tx.freshness_status(F.concat(F.lit("active."), "event_type"), now(), F.col("received_at"), window()).alias("status"), tx.age_label(now(), F.col("received_at")).alias("age"))


@query(
    "v13_wkt_points",
    _E + "SELECT event_id, (event_id % 360 - 180) / 1.0 AS lon, (event_id % 180 - 90) / 1.0 AS lat FROM e WHERE event_type <> 'error'",
)
def v13(spark, sf_dir):
    e = lenses.events(spark, sf_dir)
    point = tx.wkt_point((F.col("event_id") % 360 - 180) / 1.0, (F.col("event_id") % 180 - 90) / 1.0)
    made = e.withColumn("p", F.when(F.col("event_type") == "error", "POINT(1)").otherwise(point))
    return made.filter(tx.wkt_ok(F.col("p"))).select("event_id", tx.wkt_lon(F.col("p")).alias("lon"), tx.wkt_lat(F.col("p")).alias("lat"))


@query(
    "s5_landed_responses",
    """SELECT outcome, count(*)::BIGINT AS n FROM (SELECT CASE WHEN st = 304 THEN 'unchanged' WHEN st <> 200 THEN 'error' WHEN length(html) > 3000 THEN 'oversize'
       WHEN etag = last_value(CASE WHEN st = 200 THEN etag END IGNORE NULLS) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'unchanged' ELSE 'publish' END AS outcome
       FROM (SELECT page_id, html, page_id % 7 AS host, 'v' || page_id // 20 AS etag, CASE WHEN page_id % 11 = 0 THEN 304 WHEN page_id % 13 = 0 THEN 500 ELSE 200 END AS st FROM pages)) GROUP BY outcome""",
)
def s5(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    status = F.when(F.col("page_id") % 11 == 0, 304).when(F.col("page_id") % 13 == 0, 500).otherwise(200)
    made = p.select("page_id", (F.col("page_id") % 7).alias("host"), F.concat(F.lit("v"), F.floor(F.col("page_id") / 20).cast("string")).alias("etag"), status.alias("status_code"), F.length("html").alias("size"))
    return replay.landed_responses(made, "host", "page_id", 3000).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "r2_retained_lane",
    _E + """, n AS (SELECT event_id, 'uav-' || user_id % 4 AS source, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS number, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id DESC) AS back FROM e)
    SELECT event_id, source, 'mavlink://raw/' || source || '/' || lpad(number::VARCHAR, 8, '0') AS ref FROM n WHERE back <= 300""",
)
def r2(spark, sf_dir):
    kept = lane.retain(lenses.frames(spark, sf_dir), F.octet_length("frame"), ["number"], max_records=300)
    return kept.select("event_id", "source", "ref")


@query(
    "r7_lineage",
    _E + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id DESC) AS back FROM e),
    t AS (SELECT sys, arg_max(back, event_id) AS b FROM n WHERE event_type <> 'error' GROUP BY sys)
    SELECT 'org.edge.cop.mavlink.track.system-' || sys AS subject, b <= 300 AS held FROM t""",
)
def r7(spark, sf_dir):
    raw = lenses.frames(spark, sf_dir)
    current = state.current_state(mavlink.project(mavlink.decode(raw), ORG, PLATFORM, SURE, KEEP))
    return lane.trace(current, lane.retain(raw, F.octet_length("frame"), ["number"], max_records=300)).select("subject", "held")


# -- decoding --------------------------------------------------------------------------------------------


@query(
    "d20_decode_frames",
    _E + """SELECT event_id, sys AS system_id, CASE event_type WHEN 'view' THEN 33 WHEN 'purchase' THEN 147 WHEN 'signup' THEN 30 ELSE 0 END::BIGINT AS message_id,
    CASE WHEN event_type = 'error' THEN 'bad checksum' END AS error,
    CASE WHEN event_type = 'view' THEN (event_id * 7919) % 1000000000 - 500000000 END AS lat, CASE WHEN event_type = 'view' THEN (event_id * 104729) % 2000000000 - 1000000000 END AS lon,
    CASE WHEN event_type = 'view' THEN k * 10 - 500 END AS vx, CASE WHEN event_type = 'view' THEN -k END AS vy,
    CASE WHEN event_type = 'click' THEN k % 6 END AS system_status, CASE WHEN event_type = 'purchase' THEN k END AS battery, CASE WHEN event_type = 'purchase' THEN -k END AS current_battery,
    CASE WHEN event_type = 'signup' THEN [0.5, 1.0, -2.0, 0.25][k % 4 + 1]::DOUBLE END AS roll FROM e""",
)
def d20(spark, sf_dir):
    d = mavlink.decode(lenses.frames(spark, sf_dir))
    return d.select("event_id", "system_id", "message_id", "error", "global_position_int.lat", "global_position_int.lon", "global_position_int.vx", "global_position_int.vy", "heartbeat.system_status", F.col("battery_status.battery_remaining").alias("battery"), "battery_status.current_battery", "attitude.roll")


@query("d22_parse_stats", _E + "SELECT 'uav-' || user_id % 4 AS source, count(*) FILTER (event_type <> 'error')::BIGINT AS total, count(*) FILTER (event_type <> 'error')::BIGINT AS valid, count(*) FILTER (event_type = 'error')::BIGINT AS invalid, count(*) FILTER (event_type = 'error')::BIGINT AS checksum_errors, 0::BIGINT AS unknown_ids FROM e GROUP BY user_id % 4")
def d22(spark, sf_dir):
    return mavlink.parse_stats(mavlink.decode(lenses.frames(spark, sf_dir)))


@query("d23_labels", _E + "SELECT event_id, coalesce(['accepted', 'temporarily_rejected', 'denied', 'unsupported', 'failed', 'in_progress', 'cancelled'][k % 9 + 1], 'unknown(' || k % 9 || ')') AS result, CASE WHEN k % 30 IN (8, 10, 12) OR k % 30 > 26 THEN 'UNKNOWN(' || k % 30 || ')' ELSE ['STABILIZE','ACRO','ALT_HOLD','AUTO','GUIDED','LOITER','RTL','CIRCLE','','LAND','','DRIFT','','SPORT','FLIP','AUTOTUNE','POSHOLD','BRAKE','THROW','AVOID_ADSB','GUIDED_NOGPS','SMART_RTL','FLOWHOLD','FOLLOW','ZIGZAG','SYSTEMID','AUTOROTATE'][k % 30 + 1] END AS mode FROM e")
def d23(spark, sf_dir):
    return lenses.events(spark, sf_dir).select("event_id", mavlink.named(F.col("k") % 9, mavlink.RESULTS).alias("result"), mavlink.named(F.col("k") % 30, mavlink.MODES, "UNKNOWN(%d)").alias("mode"))


@query(
    "d1_decode_cot",
    _E + """SELECT event_id, CASE WHEN k = 0 THEN 'no uid' END AS error, CASE WHEN k > 0 THEN 'U-' || user_id END AS uid, 'C' || k AS callsign, (event_id % 90)::DOUBLE AS lat, CASE WHEN event_type = 'purchase' THEN k + 0.5::DOUBLE END AS course,
    CASE WHEN event_type = 'signup' THEN 'hold ' || k END AS chat_text, CASE WHEN event_type = 'signup' THEN 'S-' || user_id END AS sender_uid,
    CASE event_type WHEN 'view' THEN 'track' WHEN 'purchase' THEN 'track' WHEN 'click' THEN 'task' WHEN 'signup' THEN 'advisory' END AS route, k % 5 = 0 AS is_stale FROM e""",
)
def d1(spark, sf_dir):
    d = cot.route(cot.decode(lenses.cot_events(spark, sf_dir)))
    return d.select("event_id", "error", "uid", "callsign", "point.lat", "course", "chat_text", "sender_uid", "route", (F.col("time") > F.col("stale")).alias("is_stale"))


@query(
    "p7_cot_state",
    _E + """, t AS (SELECT *, CASE event_type WHEN 'view' THEN 'track' WHEN 'purchase' THEN 'track' WHEN 'click' THEN 'task' WHEN 'signup' THEN 'advisory' END AS kind,
      CASE event_type WHEN 'view' THEN 'operator' WHEN 'purchase' THEN 'air-track' WHEN 'click' THEN 'marker' WHEN 'signup' THEN 'geochat' END AS what FROM e WHERE k > 0 AND event_type <> 'error')
    SELECT 'org.edge.cop.tak.' || kind || '.u-' || user_id AS subject, arg_max(CASE WHEN k % 5 = 0 THEN 'stale.' ELSE 'active.' END || what, event_id) AS status FROM t GROUP BY kind, user_id""",
)
def p7(spark, sf_dir):
    s = state.current_state(operator_triples(spark, sf_dir)).filter(F.col("predicate").endswith(".status"))
    return s.select("subject", F.col("object").alias("status"))


@query(
    "d9_decode_opensky",
    _E + """, s AS (SELECT *, floor(epoch(ts) / 600)::BIGINT AS slot FROM e), bad AS (SELECT DISTINCT slot FROM s WHERE k = 99)
    SELECT slot, user_id, k % 5 AS position_source, CASE WHEN k % 4 <> 0 THEN k - 50 + CASE WHEN k >= 50 THEN 0.5 ELSE 0.5 * CASE WHEN k - 50 < 0 THEN -1 ELSE 1 END END END::DOUBLE AS latitude, CASE WHEN k % 7 <> 0 THEN k + 0.125 END::DOUBLE AS velocity, k % 2 = 0 AS on_ground, CASE WHEN k % 3 <> 0 THEN 'Call' || user_id END AS callsign FROM s WHERE slot NOT IN (SELECT slot FROM bad)""",
)
def d9(spark, sf_dir):
    d = adsb.decode(lenses.snapshots(spark, sf_dir), "slot").filter("error is null")
    return d.select("slot", F.conv("icao24", 16, 10).cast("long").alias("user_id"), F.col("position_source").cast("long").alias("position_source"), "latitude", "velocity", "on_ground", "callsign")


@query(
    "p12_aircraft_state",
    _E + """, s AS (SELECT *, floor(epoch(ts) / 600)::BIGINT AS slot FROM e), good AS (SELECT * FROM s WHERE slot NOT IN (SELECT slot FROM s WHERE k = 99))
    SELECT 'org.edge.cop.adsb.track.' || lower(lpad(to_hex(user_id), 6, '0')) AS subject, min(CASE k % 5 WHEN 0 THEN 0.85 WHEN 1 THEN 0.8 WHEN 2 THEN 0.75 WHEN 3 THEN 0.65 ELSE 0.5 END)::DOUBLE AS least_confidence, count(*)::BIGINT AS n, count(*) FILTER (k % 4 <> 0)::BIGINT AS n_positions FROM good GROUP BY user_id""",
)
def p12(spark, sf_dir):
    t = aircraft_triples(spark, sf_dir)
    return t.groupBy("subject").agg(F.min("confidence").alias("least_confidence"), F.count_if(F.col("predicate") == "cop.track.status").alias("n"), F.count_if(F.col("predicate") == "cop.track.position").alias("n_positions"))


@query(
    "d4_decode_cap",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 50 = 1 THEN 'bad shape' END AS error, 'W-' || o_orderkey AS identifier, CASE o_orderstatus WHEN 'F' THEN 'Alert' WHEN 'O' THEN 'Update' ELSE 'Cancel' END AS msg_type, substr(o_orderpriority, 3) AS severity,
    'Wind' || chr(10) || chr(10) || 'Strong' AS advisory_text, CASE WHEN o_orderkey % 3 = 0 THEN 24 WHEN o_orderkey % 50 = 1 THEN 0 ELSE 3 END::INT AS n_points, 0.82::DOUBLE AS confidence,
    CASE WHEN o_orderkey % 10 = 0 THEN 'nonoperational.test' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'cancelled' WHEN o_orderstatus = 'O' THEN 'stale.update' ELSE 'stale' END AS status FROM orders""",
)
def d4(spark, sf_dir):
    d = cap.decode(lenses.warnings(spark, sf_dir))
    status = cap.hazard_status(F.col("alert_status"), F.col("msg_type"), F.col("expires"), now(), F.col("sent"), window())
    points = F.coalesce(F.size(cap.hazard_geometry(F.filter("polygons", lambda p: p.isNotNull()), F.coalesce("circles", F.array()))), F.lit(0))
    return d.select("o_orderkey", "error", "identifier", "msg_type", "severity", "advisory_text", F.greatest(F.lit(0), points).alias("n_points"), cap.confidence_of(F.col("certainty"), 0.9).alias("confidence"), status.alias("status"))


_L = """WITH l AS (SELECT l_orderkey::BIGINT AS o, l_linenumber::INT AS n, l_partkey::BIGINT AS p, l_suppkey::BIGINT AS s FROM lineitem),
m AS (SELECT *, CASE WHEN n <= 4 THEN 'detectionReport' WHEN n = 5 THEN 'registration' WHEN n = 6 THEN 'statusReport' WHEN o % 3 = 0 THEN 'statusReport' WHEN o % 3 = 1 THEN 'alert' ELSE 'taskAck' END AS content,
  CASE WHEN n = 3 AND o % 5 = 0 THEN 'not one position' WHEN n <= 4 AND p % 11 = 0 THEN 'bad confidence' WHEN n <= 4 AND s % 13 = 0 THEN 'bad class' WHEN n = 5 AND o % 4 = 0 THEN 'bad version'
  WHEN n = 6 AND o % 4 = 0 THEN 'bad status' WHEN n > 6 AND o % 3 = 0 THEN 'several contents' WHEN n > 6 AND o % 3 = 1 THEN 'no decoder' END AS error FROM l) """


@query(
    "d12_decode_sensor_messages",
    _L + """SELECT o AS l_orderkey, n AS l_linenumber, content, error, printf('%08x-0000-4000-8000-%012x', s, o) AS node_id, CASE WHEN error IS NULL AND n IN (1, 3, 4) THEN p % 180 + 0.5::DOUBLE END AS x,
    CASE WHEN error IS NULL AND n = 2 THEN (p % 360)::DOUBLE END AS azimuth, CASE WHEN error IS NULL AND n <= 4 THEN (p % 100) / 100::DOUBLE END AS confidence, CASE WHEN error IS NULL AND n = 5 THEN 't' || p % 9 END AS capability,
    CASE WHEN error IS NULL AND n = 6 THEN 'default' END AS mode, CASE WHEN error IS NULL AND n > 6 THEN lpad(p::VARCHAR, 26, '0') END AS task_id FROM m""",
)
def d12(spark, sf_dir):
    d = sapient.decode(lenses.sensor_messages(spark, sf_dir))
    return d.select("l_orderkey", "l_linenumber", "content", "error", "node_id", "detection.x", "detection.azimuth", "detection.confidence", F.get("registration.capabilities.type", F.lit(0)).alias("capability"), "status_report.mode", "task_ack.task_id")


@query(
    "d14_sensor_classes",
    _L + """SELECT o AS l_orderkey, n AS l_linenumber, '0' AS path, 'Class ' || p % 7 AS type, 0.5::DOUBLE AS confidence, NULL::BIGINT AS level FROM m WHERE n <= 4 AND error IS NULL
    UNION ALL SELECT o, n, '0.0', 'Sub', NULL, 1 FROM m WHERE n <= 4 AND error IS NULL""",
)
def d14(spark, sf_dir):
    return sapient.classifications(sapient.decode(lenses.sensor_messages(spark, sf_dir)), ["l_orderkey", "l_linenumber"]).drop("object_id")


@query("d15_sensor_references", _L + "SELECT o AS l_orderkey, n AS l_linenumber, lpad(p::VARCHAR, 26, '0') AS subject_id, 'derived' AS relation, lpad(s::VARCHAR, 26, '0') AS object_id FROM m WHERE n <= 4 AND error IS NULL")
def d15(spark, sf_dir):
    r = sapient.references(sapient.decode(lenses.sensor_messages(spark, sf_dir)), ["l_orderkey", "l_linenumber"])
    return r.select("l_orderkey", "l_linenumber", "subject_id", "relation", "object_id")


# -- state, governance, views ----------------------------------------------------------------------------


@query(
    "p17_births",
    _E + "SELECT sys AS system_id, min(event_id) AS born, count(*)::BIGINT AS n FROM usable GROUP BY sys",
)
def p17(spark, sf_dir):
    d = mavlink.decode(lenses.frames(spark, sf_dir)).filter("error is null")
    subject = tx.entity_id(F.lit(ORG), F.lit(PLATFORM), "mavlink", "track", F.format_string("system-%d", "system_id"))
    p = state.plan_births(d.withColumn("subject", subject))
    return p.groupBy("system_id").agg(F.min(F.when(F.col("kind") == "create", F.col("event_id"))).alias("born"), F.count("*").alias("n"))


@query(
    "m1_current_state",
    _E + """SELECT 'org.edge.cop.mavlink.track.system-' || sys AS subject, arg_max(k, event_id)::VARCHAR AS battery FROM usable WHERE event_type = 'purchase' GROUP BY sys""",
)
def m1(spark, sf_dir):
    s = state.current_state(mavlink.project(mavlink.decode(lenses.frames(spark, sf_dir)), ORG, PLATFORM, SURE, KEEP))
    return s.filter("predicate = 'cop.track.battery_remaining'").select("subject", F.col("object").alias("battery"))


@query(
    "g7_violations",
    _E + """, born AS (SELECT sys, min(event_id) AS event_id FROM usable GROUP BY sys), f AS (SELECT * FROM usable)
    SELECT count(*) FILTER (k = 7)::BIGINT + count(*) FILTER (k = 10)::BIGINT AS n_unowned, count(*) FILTER (k = 8)::BIGINT AS n_mismatched, count(*) FILTER (k = 10)::BIGINT AS n_unprofiled, count(*) FILTER (k = 9)::BIGINT AS n_dangling FROM f""",
)
def g7(spark, sf_dir):
    """Violations over all triples, with planted ones: an unowned predicate (k = 7), another source (8), an edge to nothing (9), an entity without a contract (10)."""
    t = all_triples(spark, sf_dir)
    seen = mavlink.usable(mavlink.decode(lenses.frames(spark, sf_dir))).filter("k between 7 and 10")
    track = mavlink.subject_of(ORG, PLATFORM, "track")
    subject = F.when(F.col("k") == 10, mavlink.subject_of(ORG, PLATFORM, "gadget")).otherwise(track)
    predicate = F.when(F.col("k") == 7, "cop.track.colour").when(F.col("k") == 9, "cop.track.source").otherwise("cop.track.status")
    target = F.when(F.col("k") == 9, F.concat(F.lit(f"{ORG}.{PLATFORM}.cop.mavlink.asset.none-"), F.col("event_id").cast("string"))).otherwise("planted")
    source = F.when(F.col("k") == 8, "adsb").otherwise("mavlink")
    planted = seen.select(*KEEP, subject.alias("subject"), predicate.alias("predicate"), target.alias("object"), F.lit("string").alias("object_type"), source.alias("source"), F.col("received_at").alias("timestamp"), F.lit(SURE).alias("confidence"), F.lit(0).alias("idx"))
    every = t.unionByName(planted)
    return contracts.violation_counters(every, state.entities(t), contracts.contracts(spark))


@query(
    "g6_profiles",
    _E + """, cot AS (SELECT * FROM e WHERE k > 0) SELECT profile, n FROM (SELECT 'signal' AS profile, count(DISTINCT user_id)::BIGINT AS n FROM cot WHERE event_type IN ('view', 'purchase')
    UNION ALL SELECT 'control', (count(DISTINCT user_id) FILTER (event_type = 'click') + count(DISTINCT user_id) FILTER (event_type IN ('view', 'purchase')))::BIGINT FROM cot UNION ALL SELECT 'content', count(DISTINCT user_id) FROM cot WHERE event_type = 'signup')""",
)
def g6(spark, sf_dir):
    return contracts.route_by_profile(operator_triples(spark, sf_dir), contracts.contracts(spark)).select("profile", F.col("n_entities").alias("n"))


@query(
    "q5_discovery",
    _E + """, n AS (SELECT 'mavlink.track' AS t, count(DISTINCT sys) AS n FROM usable UNION ALL SELECT 'mavlink.asset', count(DISTINCT sys) FROM usable),
    targets AS (SELECT unnest(['mavlink.asset', 'mavlink.track', 'tak.asset', 'tak.track', 'tak.task', 'tak.advisory', 'cap.hazard_area', 'adsb.track']) AS t)
    SELECT 'org.edge.cop.' || t AS prefix, least(coalesce(n, 0), 100)::BIGINT AS n, coalesce(n, 0) > 100 AS at_limit FROM targets LEFT JOIN n USING (t)""",
)
def q5(spark, sf_dir):
    e = state.entities(vehicle_triples(spark, sf_dir))
    return views.discovery_diagnostics(e, views.discovery_targets(spark, [(ORG, PLATFORM)]), 100).select("prefix", "n", "at_limit")


@query(
    "h1_feed_health",
    _E + """, p AS (SELECT sys FROM usable WHERE event_type = 'view' GROUP BY sys), last AS (SELECT max(seen_at) AS seen_at FROM (SELECT sys, arg_max(ts, event_id) AS seen_at FROM usable GROUP BY sys) JOIN p USING (sys))
    SELECT 'feed.mavlink' AS feed, CASE WHEN TIMESTAMP '2024-01-31' - seen_at > INTERVAL 6 HOUR THEN 'stale' ELSE 'live' END AS status, strftime(seen_at, '%Y-%m-%d %H:%M') AS last_minute FROM last
    UNION ALL VALUES ('feed.tak', 'stale', '2024-01-31 00:00'), ('feed.cap', 'planned', '2024-01-30 23:27'), ('feed.adsb', 'planned', '2024-01-30 23:15')""",
)
def h1(spark, sf_dir):
    t = track_view(spark, sf_dir).select(F.concat(F.lit("feed."), F.col("source")).alias("feed"), "updated_at")
    h = views.feed_health(spark, t, now(), window())
    return h.select("feed", "status", F.date_format("last_event_at", "yyyy-MM-dd HH:mm").alias("last_minute"))


@query(
    "h5_adapter_health",
    _E + "SELECT count(*)::BIGINT AS received, count(*) FILTER (k > 0)::BIGINT AS decoded, count(*) FILTER (k = 0)::BIGINT AS parse_errors, max(event_id) FILTER (k > 0) AS last_good FROM e",
)
def h5(spark, sf_dir):
    d = cot.decode(lenses.cot_events(spark, sf_dir))
    good = F.col("error").isNull()
    return d.agg(F.count("*").alias("received"), F.count_if(good).alias("decoded"), F.count_if(~good).alias("parse_errors"), F.max(F.when(good, F.col("event_id"))).alias("last_good"))


@query(
    "h7_flow_rates",
    _E + "SELECT 'uav-' || user_id % 4 AS source, count(*)::BIGINT AS n, round(count(*) / greatest(1, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6), 6) AS per_second FROM e GROUP BY user_id % 4",
)
def h7(spark, sf_dir):
    f = lenses.frames(spark, sf_dir)
    elapsed = F.greatest(F.lit(1.0), F.unix_micros(F.max("received_at")) / 1e6 - F.unix_micros(F.min("received_at")) / 1e6)
    return f.groupBy("source").agg(F.count("*").alias("n"), F.round(F.count("*") / elapsed, 6).alias("per_second"))


@query(
    "h8_source_staleness",
    _E + "SELECT user_id % 4 AS endpoint, coalesce(max(ts) FILTER (event_type <> 'error') < TIMESTAMP '2024-01-31' - INTERVAL 2 MINUTE, true) AS stale FROM e GROUP BY user_id % 4",
)
def h8(spark, sf_dir):
    e = lenses.events(spark, sf_dir)
    fresh = F.max(F.when(F.col("event_type") != "error", F.col("received_at")))
    return e.groupBy((F.col("user_id") % 4).alias("endpoint")).agg(F.coalesce(now() - fresh > F.expr("interval 120 seconds"), F.lit(True)).alias("stale"))


@query(
    "x3_stop_at_first_error",
    _E + "SELECT count(*)::BIGINT AS steps, count(*) FILTER (k = 0)::BIGINT AS failed FROM e WHERE event_id <= coalesce((SELECT min(event_id) FROM e WHERE k = 0), 9223372036854775807)",
)
def x3(spark, sf_dir):
    d = cot.decode(lenses.cot_events(spark, sf_dir)).select("event_id", "error")
    return state.stop_at_first_error(d, "event_id").agg(F.count("*").alias("steps"), F.count_if(F.col("error").isNotNull()).alias("failed"))


@query(
    "t4_map_bounds",
    _E + """, p AS (SELECT sys, max(event_id) AS p FROM usable WHERE event_type = 'view' GROUP BY sys), x AS (SELECT ((p * 104729) % 2000000000 - 1000000000) / 1e7 AS lon, ((p * 7919) % 1000000000 - 500000000) / 1e7 AS lat FROM p)
    SELECT round(min(lon) - 0.01, 5) AS west, round(min(lat) - 0.008, 5) AS south, round(max(lon) + 0.01, 5) AS east, round(max(lat) + 0.008, 5) AS north FROM x""",
)
def t4(spark, sf_dir):
    b = views.map_bounds(track_view(spark, sf_dir))
    return b.select(*[F.round(c, 5).alias(c) for c in ("west", "south", "east", "north")])


@query(
    "e4_nearest_tracks",
    _E + """, p AS (SELECT sys, max(event_id) AS p FROM usable WHERE event_type = 'view' GROUP BY sys), x AS (SELECT sys, ((p * 104729) % 2000000000 - 1000000000) / 1e7 AS lon, ((p * 7919) % 1000000000 - 500000000) / 1e7 AS lat FROM p)
    SELECT 'org.edge.cop.mavlink.track.system-' || sys AS subject FROM x ORDER BY 2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat - 10) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(lon - 20) / 2), 2))) LIMIT 10""",
)
def e4(spark, sf_dir):
    return views.nearest(track_view(spark, sf_dir).select("subject", "lon", "lat"), 20.0, 10.0, 10).select("subject")


@query(
    "e6_moving_windows",
    _E + "SELECT 'org.edge.cop.mavlink.track.system-' || sys AS subject, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*)::BIGINT AS n FROM usable WHERE event_type = 'view' GROUP BY sys, date_trunc('hour', ts)",
)
def e6(spark, sf_dir):
    t = mavlink.project(mavlink.decode(lenses.frames(spark, sf_dir)), ORG, PLATFORM, SURE, KEEP).filter("predicate = 'cop.track.position'")
    return views.positions_by_window(t).select("subject", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "n")


# -- tasks, advisories, hazards, layers and alerts -------------------------------------------------------


def operator_view(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    columns = (views.TASK_COLUMNS if kind == "task" else views.ADVISORY_COLUMNS) | views.PROVENANCE_COLUMNS
    current = state.current_state(views.of_type(operator_triples(spark, sf_dir), kind))
    return (views.tasks if kind == "task" else views.advisories)(state.wide(current, columns), now(), window())


def hazard_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap.hazards(cap.evidence(cap.decode(lenses.warnings(spark, sf_dir))), now(), window(), ORG, PLATFORM)


_LAST = """, t AS (SELECT user_id, max(event_id) AS event_id FROM e WHERE k > 0 AND event_type = '{kind}' GROUP BY user_id), v AS (SELECT t.user_id, e.event_id, k,
CASE WHEN TIMESTAMP '2024-01-31' - date_trunc('second', ts) > INTERVAL 6 HOUR OR k % 5 = 0 THEN 'stale.' ELSE 'active.' END || '{what}' AS status, -(e.event_id % 180)::DOUBLE AS lon, (e.event_id % 90)::DOUBLE AS lat FROM t JOIN e ON t.event_id = e.event_id) """
_TRACKED = """, seen AS (SELECT sys, arg_max(ts, event_id) AS seen_at, max(event_id) FILTER (event_type = 'view') AS p FROM usable GROUP BY sys),
x AS (SELECT sys, seen_at, ((p * 104729) % 2000000000 - 1000000000) / 1e7 AS lon, ((p * 7919) % 1000000000 - 500000000) / 1e7 AS lat FROM seen WHERE p IS NOT NULL) """
_H = """, h AS (SELECT o_orderkey AS key, o_orderkey % 80 AS lat, o_orderkey % 170 AS lon, o_orderkey % 3 = 0 AS round, o_orderpriority AS priority,
CASE WHEN o_orderkey % 10 = 0 THEN 'nonoperational.test' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'cancelled' WHEN o_orderstatus = 'O' THEN 'stale.update' ELSE 'stale' END AS status FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 50 <> 1) """


@query("v3_tasks", _E + _LAST.format(kind="click", what="marker") + "SELECT 'org.edge.cop.tak.task.u-' || user_id AS subject, 'C' || k AS label, 'marker' AS kind, status, lon, lat FROM v")
def v3(spark, sf_dir):
    return operator_view(spark, sf_dir, "task").select("subject", "label", "kind", "status", "lon", "lat")


@query("v4_advisories", _E + _LAST.format(kind="signup", what="geochat") + "SELECT 'org.edge.cop.tak.advisory.u-' || user_id AS subject, 'GeoChat S-' || user_id AS label, 'hold ' || k AS text, status, lon, lat FROM v")
def v4(spark, sf_dir):
    return operator_view(spark, sf_dir, "advisory").select("subject", "label", "text", "status", "lon", "lat")


@query("v5_hazards", "WITH q AS (SELECT 1)" + _H + "SELECT 'org.edge.cop.cap.hazard_area.w-' || key AS subject, 'High Wind: Zone ' || key % 7 AS label, 'cap-high-wind' AS kind, lower(substr(priority, 3)) AS severity, status, CASE WHEN round THEN 24 ELSE 3 END::INT AS n_points FROM h")
def v5(spark, sf_dir):
    return hazard_view(spark, sf_dir).select("subject", "label", "kind", "severity", "status", F.size("geometry").alias("n_points"))


@query("t1_point_layer", _E + _TRACKED + """SELECT 'track' AS kind, 'org.edge.cop.mavlink.track.system-' || sys AS subject FROM x UNION ALL SELECT 'asset', 'org.edge.cop.mavlink.asset.system-' || sys FROM x
UNION ALL SELECT DISTINCT 'task', 'org.edge.cop.tak.task.u-' || user_id FROM e WHERE k > 0 AND event_type = 'click' UNION ALL SELECT DISTINCT 'advisory', 'org.edge.cop.tak.advisory.u-' || user_id FROM e WHERE k > 0 AND event_type = 'signup'""")
def t1(spark, sf_dir):
    wide = state.wide(state.current_state(vehicle_triples(spark, sf_dir)))
    tracks = views.tracks(wide, now(), window())
    assets = views.assets(wide, tracks).withColumnRenamed("name", "label")
    layer = views.point_layer(track=tracks, asset=assets, task=operator_view(spark, sf_dir, "task"), advisory=operator_view(spark, sf_dir, "advisory"))
    return layer.filter("lon is not null").select("kind", "subject")


@query("t2_polygon_layer", "WITH q AS (SELECT 1)" + _H + "SELECT 'org.edge.cop.cap.hazard_area.w-' || key AS subject, CASE WHEN round THEN 24 ELSE 3 END::INT AS n_points, CASE WHEN NOT round THEN lon::DOUBLE END AS first_lon, lat::DOUBLE AS first_lat FROM h")
def t2(spark, sf_dir):
    first = F.get("polygon", F.lit(0))
    lon = F.when(F.size("polygon") == 3, F.get(first, F.lit(0)))
    return views.polygon_layer(hazard_view(spark, sf_dir)).select("subject", F.size("polygon").alias("n_points"), lon.alias("first_lon"), F.get(first, F.lit(1)).alias("first_lat"))


@query("t3_hazard_labels", "WITH q AS (SELECT 1)" + _H + "SELECT 'High Wind: Zone ' || key % 7 AS label, key AS key, round(lon + CASE WHEN round THEN 0 ELSE 1 / 6 END, 6) AS lon, round(lat + CASE WHEN round THEN 0 ELSE 1 / 3 END, 6) AS lat FROM h")
def t3(spark, sf_dir):
    return views.hazard_labels(hazard_view(spark, sf_dir)).select("label", F.regexp_extract("subject", r"w-(\d+)$", 1).cast("long").alias("key"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(
    "e1_hazard_intersections",
    _E + _H + """, x AS (SELECT event_id, abs((event_id * 104729) % 2000000000 - 1000000000) / 1e7 AS lon, abs((event_id * 7919) % 1000000000 - 500000000) / 1e7 AS lat FROM usable WHERE event_type = 'view'),
    c AS (SELECT event_id, key, round, x.lon - h.lon AS dx, x.lat - h.lat AS dy, (x.lon - h.lon) * cos(radians(h.lat)) * 111.32 / 7.5 AS u, (x.lat - h.lat) * 111.32 / 7.5 AS w FROM x, h WHERE abs(x.lon - h.lon) < 1 AND abs(x.lat - h.lat) < 1),
    a AS (SELECT *, atan2(w, u) AS angle FROM c)
    SELECT event_id::VARCHAR AS entity_id, 'org.edge.cop.cap.hazard_area.w-' || key AS hazard_id FROM a
    WHERE CASE WHEN round THEN sqrt(u * u + w * w) * cos(angle - floor(angle / (pi() / 12)) * (pi() / 12) - pi() / 24) < cos(pi() / 24) ELSE dx > 0 AND dy < 0.5 AND dy > dx END""",
)
def e1(spark, sf_dir):
    """Every reported position, mirrored into the north-east where the warnings lie."""
    at = mavlink.decode(lenses.frames(spark, sf_dir)).filter("global_position_int.lat is not null")
    points = at.select(F.col("event_id").cast("string").alias("subject"), (F.abs("global_position_int.lon") / 1e7).alias("lon"), (F.abs("global_position_int.lat") / 1e7).alias("lat"))
    return views.hazard_intersections(points, hazard_view(spark, sf_dir))


@query("e2_stale_track_alerts", _E + _TRACKED + "SELECT 'org.edge.cop.mavlink.track.system-' || sys AS entity_id, 'warning' AS severity FROM x WHERE TIMESTAMP '2024-01-31' - seen_at > INTERVAL 6 HOUR")
def e2(spark, sf_dir):
    return views.stale_track_alerts(track_view(spark, sf_dir)).select("entity_id", "severity")


@query("e3_low_battery_alerts", _E + "SELECT 'org.edge.cop.mavlink.track.system-' || sys AS entity_id, b::INT AS battery FROM (SELECT sys, arg_max(k, event_id) AS b FROM usable WHERE event_type = 'purchase' GROUP BY sys) WHERE b < 20")
def e3(spark, sf_dir):
    current = state.current_state(mavlink.project(mavlink.decode(lenses.frames(spark, sf_dir)), ORG, PLATFORM, SURE, KEEP))
    return views.low_battery_alerts(current, 20).select("entity_id", "battery")


@query(
    "x4_run_summary",
    _E + """, s AS (SELECT floor(epoch(ts) / 600) AS slot, max(k = 99) AS bad FROM e GROUP BY slot), f AS (SELECT 'mavlink' AS feed, event_type = 'error' AS bad FROM e UNION ALL SELECT 'cot', k = 0 FROM e
    UNION ALL SELECT 'cap', o_orderkey % 3 <> 0 AND o_orderkey % 50 = 1 FROM orders UNION ALL SELECT 'adsb', bad FROM s)
    SELECT feed, count(*)::BIGINT AS inputs, count(*) FILTER (NOT bad)::BIGINT AS completed, count(*) FILTER (bad)::BIGINT AS failed, CASE WHEN bool_or(bad) THEN 'failed' ELSE 'succeeded' END AS state FROM f GROUP BY feed""",
)
def x4(spark, sf_dir):
    """Steps of all four feeds; a snapshot is one step, whatever the number of its states."""
    snapshots = adsb.decode(lenses.snapshots(spark, sf_dir), "slot").groupBy("slot").agg(F.min("error").alias("error"))
    feeds = {"mavlink": mavlink.decode(lenses.frames(spark, sf_dir)), "cot": cot.decode(lenses.cot_events(spark, sf_dir)), "cap": cap.decode(lenses.warnings(spark, sf_dir)), "adsb": snapshots}
    steps = None
    for feed, decoded in feeds.items():
        part = decoded.select(F.lit(feed).alias("feed"), "error")
        steps = part if steps is None else steps.unionByName(part)
    return state.run_summary(steps)


@query("q1_prefix_scan", _E + ", s AS (SELECT DISTINCT 'org.edge.cop.mavlink.track.system-' || sys AS subject FROM usable) SELECT subject, (SELECT count(*) > 100 FROM s) AS truncated FROM s ORDER BY subject LIMIT 100")
def q1(spark, sf_dir):
    return views.prefix_scan(state.entities(vehicle_triples(spark, sf_dir)), f"{ORG}.{PLATFORM}.cop.mavlink.track", 100)


@query("r1_assign_refs", _E + "SELECT event_id, 'mavlink://raw/uav-' || user_id % 4 || '/' || lpad((row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id))::VARCHAR, 8, '0') AS ref FROM e")
def r1(spark, sf_dir):
    return lenses.frames(spark, sf_dir).select("event_id", "ref")


# -- readback, mutations, evidence and runs ------------------------------------------------------------------

_COT = _E + """, c AS (SELECT *, CASE event_type WHEN 'view' THEN 'track' WHEN 'purchase' THEN 'track' WHEN 'click' THEN 'task' WHEN 'signup' THEN 'advisory' END AS kind FROM e WHERE k > 0 AND event_type <> 'error') """


@query(
    "p8_operator_assets",
    _COT + "SELECT 'org.edge.cop.tak.asset.u-' || user_id AS subject, 'C' || arg_min(k, event_id) AS name, 'cot.uid.U-' || user_id AS native_id, 'org.edge.cop.tak.track.u-' || user_id AS track FROM c WHERE kind = 'track' GROUP BY user_id",
)
def p8(spark, sf_dir):
    """The source asset of every operator and aircraft track, and the track whose edge leads to it."""
    t = state.current_state(operator_triples(spark, sf_dir))
    asset = state.wide(t.filter(F.col("predicate").startswith("cop.asset.")), {"name": "cop.asset.name", "native_id": "cop.asset.native_id"})
    edges = t.filter("predicate = 'cop.track.source'").select(F.col("subject").alias("track"), F.col("object").alias("subject"))
    return asset.join(edges, "subject").select("subject", "name", "native_id", "track")


@query(
    "q2_get_entities",
    _E + """, known AS (SELECT sys, count(DISTINCT event_type) AS n FROM usable GROUP BY sys), asked AS (SELECT DISTINCT user_id % 300 + 1 AS sys FROM events)
    SELECT 'org.edge.cop.mavlink.track.system-' || a.sys AS subject, n IS NOT NULL AS found FROM asked a LEFT JOIN known USING (sys)""",
)
def q2(spark, sf_dir):
    asked = lenses.events(spark, sf_dir).select(F.concat(F.lit(f"{ORG}.{PLATFORM}.cop.mavlink.track.system-"), (F.col("user_id") % 300 + 1).cast("string")).alias("subject")).distinct()
    return views.get_entities(asked, state.current_state(vehicle_triples(spark, sf_dir))).select("subject", "found")


@query(
    "q4_discover",
    _COT + """, s AS (SELECT DISTINCT 'org.edge.cop.tak.' || kind || '.u-' || user_id AS subject, 'org.edge.cop.tak.' || kind AS prefix FROM c UNION SELECT 'org.edge.cop.tak.asset.u-' || user_id, 'org.edge.cop.tak.asset' FROM c WHERE kind = 'track')
    SELECT prefix, subject FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY subject) AS n FROM s) WHERE n <= 40""",
)
def q4(spark, sf_dir):
    return views.discover(state.entities(operator_triples(spark, sf_dir)), views.discovery_targets(spark, [(ORG, PLATFORM)]), 40)


@query(
    "h2_feed_membership",
    _COT + """, pos AS (SELECT sys, max(event_id) FILTER (event_type = 'view') AS p, arg_max(ts, event_id) AS seen FROM usable GROUP BY sys), last AS (SELECT arg_max(ts, event_id) AS seen FROM c GROUP BY kind, user_id)
    SELECT 'feed.mavlink' AS feed, count(*)::BIGINT AS n, strftime(max(seen), '%Y-%m-%d %H:%M:%S') AS last_second FROM pos WHERE p IS NOT NULL UNION ALL SELECT 'feed.tak', count(*), strftime(max(date_trunc('second', seen)), '%Y-%m-%d %H:%M:%S') FROM last""",
)
def h2(spark, sf_dir):
    """How many entities speak for each feed, and the last of them."""
    operators = state.wide(state.current_state(views.of_type(operator_triples(spark, sf_dir), "track")))
    seen = track_view(spark, sf_dir).unionByName(views.tracks(operators, now(), window()))
    o = views.feed_observations(seen, operator_view(spark, sf_dir, "task"), operator_view(spark, sf_dir, "advisory"))
    return o.groupBy("feed").agg(F.count("*").alias("n"), F.date_format(F.max("updated_at"), "yyyy-MM-dd HH:mm:ss").alias("last_second"))


@query(
    "h3_summary",
    _COT + """SELECT (SELECT count(DISTINCT sys) FROM usable WHERE event_type = 'view')::BIGINT AS n_tracks, count(DISTINCT user_id) FILTER (kind = 'task')::BIGINT AS n_tasks, count(DISTINCT user_id) FILTER (kind = 'advisory')::BIGINT AS n_advisories FROM c""",
)
def h3(spark, sf_dir):
    tracks = track_view(spark, sf_dir)
    feeds = views.feed_health(spark, views.feed_observations(tracks, operator_view(spark, sf_dir, "task"), operator_view(spark, sf_dir, "advisory")), now(), window())
    return views.summary({"tracks": tracks, "tasks": operator_view(spark, sf_dir, "task"), "advisories": operator_view(spark, sf_dir, "advisory")}, feeds).select("n_tracks", "n_tasks", "n_advisories")


@query("p19_whole_batches", _E + "SELECT event_id // 20 AS lot, count(*)::BIGINT AS n FROM e WHERE event_id // 20 NOT IN (SELECT event_id // 20 FROM e WHERE k = 0) GROUP BY 1")
def p19(spark, sf_dir):
    d = cot.decode(lenses.cot_events(spark, sf_dir)).withColumn("lot", F.floor(F.col("event_id") / 20))
    return state.whole_batches(d, "lot").groupBy("lot").agg(F.count("*").alias("n"))


@query(
    "p21_mutation_log",
    _E + """, born AS (SELECT sys, min(event_id) AS first FROM usable GROUP BY sys)
    SELECT event_id AS arrival, CASE WHEN event_id = first THEN 'create' ELSE 'update' END AS kind, CASE WHEN event_id = first THEN 'create' ELSE 'update' END || '-track-system-' || sys || '-' || event_id AS request_id, CASE WHEN event_id = first THEN 'entity.create' ELSE 'entity.update' END AS message_type FROM usable JOIN born USING (sys)""",
)
def p21(spark, sf_dir):
    seen = mavlink.usable(mavlink.decode(lenses.frames(spark, sf_dir))).withColumn("subject", mavlink.subject_of(ORG, PLATFORM, "track"))
    return state.mutation_log(state.plan_births(seen), "signal", "feed.mavlink").select("arrival", "kind", "request_id", "message_type")


@query("m3_latest_property", _E + "SELECT 'org.edge.cop.mavlink.track.system-' || sys AS subject, k::VARCHAR AS battery FROM (SELECT *, row_number() OVER (PARTITION BY sys ORDER BY ts DESC, event_id DESC) AS n FROM usable WHERE event_type = 'purchase') WHERE n = 1")
def m3(spark, sf_dir):
    t = mavlink.project(mavlink.decode(lenses.frames(spark, sf_dir)), ORG, PLATFORM, SURE, KEEP).filter("predicate = 'cop.track.battery_remaining'")
    half = F.col("arrival") % 2 == 0
    return state.latest_property(state.append_evidence(t.filter(half), t.filter(~half))).select("subject", F.col("object").alias("battery"))


@query("m9_running_state", _E + "SELECT 'org.edge.cop.mavlink.track.system-' || sys AS subject, arg_max(k, event_id)::VARCHAR AS battery FROM usable WHERE event_type = 'purchase' GROUP BY sys")
def m9(spark, sf_dir):
    """The state of two thirds of the frames, merged with the others, and with them again."""
    t = mavlink.project(mavlink.decode(lenses.frames(spark, sf_dir)), ORG, PLATFORM, SURE, KEEP).filter("predicate = 'cop.track.battery_remaining'")
    early = F.col("arrival") % 3 != 0
    once = state.running_state(state.current_state(t.filter(early)), t.filter(~early))
    return state.running_state(once, t.filter(~early)).select("subject", F.col("object").alias("battery"))


@query("h6_last_seen", _E + "SELECT 'U-' || arg_max(user_id, event_id) AS uid, 'C' || arg_max(k, event_id) AS callsign, (SELECT max(event_id) FROM e WHERE k = 0) AS last_error FROM e WHERE k > 0")
def h6(spark, sf_dir):
    d = cot.decode(lenses.cot_events(spark, sf_dir))
    good = F.when(F.col("error").isNull(), F.col("event_id"))
    seen = d.agg(F.max_by(F.struct("uid", "callsign"), good).alias("s"), F.max(F.when(F.col("error").isNotNull(), F.col("event_id"))).alias("last_error"))
    return seen.select("s.uid", "s.callsign", "last_error")


@query("r5_warning_refs", "SELECT o_orderkey, 'cap://raw/desk-1--west/' || 'w-' || o_orderkey || '--' || lower(substr(o_orderpriority, 1, 1)) || '/' || (epoch_us(o_orderdate::TIMESTAMP) * 1000)::VARCHAR AS ref FROM orders")
def r5(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.concat(F.lit("W-"), F.col("o_orderkey").cast("string"), F.lit(" #"), F.substring("o_orderpriority", 1, 1))
    return o.select("o_orderkey", tx.cap_ref(F.lit("Desk 1, West"), name, F.col("o_orderdate").cast("timestamp")).alias("ref"))


@query("v12_owners", _E + "SELECT event_id, CASE WHEN k % 5 = 0 THEN 'feed.mavlink' WHEN k % 5 = 1 THEN 'feed.tak' WHEN k % 5 = 2 THEN 'feed.cap' WHEN k % 5 = 3 THEN 'feed.adsb' ELSE 'fusion.structural' END AS owner FROM e")
def v12(spark, sf_dir):
    system = F.get(F.array(*[F.lit(x) for x in ("mavlink", "tak", "cap", "adsb", "fusion")]), (F.col("k") % 5).cast("int"))
    return lenses.events(spark, sf_dir).select("event_id", tx.owner_of(tx.source_of(F.concat(F.lit("org.edge.cop."), system, F.lit(".track.x")))).alias("owner"))


@query(
    "x2_step_report",
    _E + """, born AS (SELECT sys, min(event_id) AS first FROM usable GROUP BY sys)
    SELECT 'mavlink' AS feed, event_id AS position, CASE WHEN event_type = 'error' THEN 'bad checksum' END AS error, CASE WHEN event_type = 'error' THEN 0 WHEN event_id = first THEN 2 ELSE 1 END::BIGINT AS mutations FROM e LEFT JOIN born USING (sys)
    UNION ALL SELECT 'cot', event_id, CASE WHEN k = 0 THEN 'no uid' END, CASE WHEN k = 0 OR event_type = 'error' THEN 0 WHEN event_type IN ('view', 'purchase') AND event_id = min(event_id) FILTER (k > 0 AND event_type IN ('view', 'purchase')) OVER (PARTITION BY user_id) THEN 2 ELSE 1 END::BIGINT FROM e""",
)
def x2(spark, sf_dir):
    """Vehicles, then operators, each in the order given; a create also writes the source asset."""
    frames, events = mavlink.decode(lenses.frames(spark, sf_dir)), cot.decode(lenses.cot_events(spark, sf_dir))
    seen = mavlink.usable(frames).withColumn("subject", mavlink.subject_of(ORG, PLATFORM, "track"))
    writes = F.when(F.col("kind") == "create", 2).otherwise(1).cast("long").alias("mutations")
    vehicles = state.plan_births(seen).select("event_id", writes)
    also = F.when((F.col("kind") == "create") & (F.col("route") == "track"), 2).otherwise(1).cast("long").alias("mutations")
    operators = state.plan_births(cot.sightings(events, ORG, PLATFORM)).select("event_id", also)
    report = lambda feed, rank, inputs, planned: inputs.select("event_id", "error").join(planned, "event_id", "left").select(F.lit(rank).alias("rank"), F.lit(feed).alias("feed"), F.col("event_id").alias("position"), "error", F.coalesce("mutations", F.lit(0)).cast("long").alias("mutations"))
    return report("mavlink", 0, frames, vehicles).unionByName(report("cot", 1, events, operators)).drop("rank")


@query("x5_validate_inputs", _E + "SELECT event_id, CASE WHEN event_type = 'error' THEN 'no name' WHEN k % 10 = 0 THEN 'no ref' WHEN k % 10 = 1 THEN 'no payload' END AS error FROM e")
def x5(spark, sf_dir):
    e = lenses.events(spark, sf_dir)
    given = e.select("event_id", F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("name"), F.when(F.col("k") % 10 != 0, F.lit("r")).alias("ref"), F.when(F.col("k") % 10 != 1, F.lit("x")).otherwise("").cast("binary").alias("payload"))
    return replay.validate_inputs(given).select("event_id", "error")


@query("r6_lane_headlines", _E + """SELECT 'cot://raw/tak-main/' || lpad((row_number() OVER (ORDER BY event_id))::VARCHAR, 8, '0') AS ref, CASE WHEN k > 0 THEN 'U-' || user_id END AS uid,
    CASE WHEN k > 0 THEN CASE event_type WHEN 'view' THEN 'a-f-G-U-C' WHEN 'click' THEN 'u-d-p' WHEN 'signup' THEN 'b-t-f' WHEN 'purchase' THEN 'a-f-A-M' ELSE 'b-a-o' END END AS type,
    CASE WHEN k > 0 THEN 'C' || k END AS callsign, CASE WHEN k > 0 THEN strftime(date_trunc('second', ts) + CASE WHEN k % 5 = 0 THEN INTERVAL (-60) SECOND ELSE INTERVAL 300 SECOND END, '%Y-%m-%d %H:%M:%S') END AS stale FROM e""")
def r6(spark, sf_dir):
    h = lane.headlines(cot.decode(lenses.cot_events(spark, sf_dir)), "cot")
    return h.withColumn("stale", F.date_format("stale", "yyyy-MM-dd HH:mm:ss"))


@query("e5_association", _E + """, good AS (SELECT *, floor(epoch(ts) / 600)::BIGINT AS slot FROM e), a AS (SELECT user_id, max(slot) * 600 + 600 AS at FROM good WHERE k % 3 <> 0 AND slot NOT IN (SELECT slot FROM good WHERE k = 99) GROUP BY user_id),
    o AS (SELECT user_id, floor(epoch(max(ts)))::BIGINT AS at FROM e WHERE k > 0 AND event_type IN ('view', 'purchase') GROUP BY user_id)
    SELECT 'org.edge.cop.tak.track.u-' || user_id AS subject, 'org.edge.cop.adsb.track.' || lower(lpad(to_hex(user_id), 6, '0')) AS object FROM o JOIN a USING (user_id) WHERE abs(o.at - a.at) <= 6 * 3600""")
def e5(spark, sf_dir):
    """Operators and aircraft that bear one call sign, last seen within six hours of each other."""
    seen = cot.sightings(cot.decode(lenses.cot_events(spark, sf_dir)), ORG, PLATFORM).filter("route = 'track'")
    operators = seen.groupBy("subject", F.regexp_replace("uid", "^U-", "call ").alias("stable_id")).agg(F.max("time").alias("at"))
    aircraft = adsb.decode(lenses.snapshots(spark, sf_dir), "slot").filter("error is null and callsign is not null")
    subject = tx.entity_id(F.lit(ORG), F.lit(PLATFORM), "adsb", "track", tx.entity_token(F.col("icao24")))
    flying = aircraft.groupBy(subject.alias("subject"), F.col("callsign").alias("stable_id")).agg(F.max("received_at").alias("at"))
    return views.associate(operators, flying, "6 hours").select("subject", "object")


@query("q7_snapshot_fallback", "SELECT 'live' AS shown, 'track' AS view, count(*)::BIGINT AS n FROM (SELECT DISTINCT user_id % 150 FROM events WHERE event_type = 'view') UNION ALL SELECT 'fixture', 'track', count(*) FROM customer")
def q7(spark, sf_dir):
    """The track view beside a stored one (customers as ids), and the same with every view empty."""
    tracks = track_view(spark, sf_dir).select("subject")
    stored = {"track": spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("subject"))}
    live = views.snapshot_fallback({"track": tracks}, stored)["track"].select(F.lit("live").alias("shown"))
    blank = views.snapshot_fallback({"track": tracks.filter("subject = ''")}, stored)["track"].select(F.lit("fixture").alias("shown"))
    return live.unionByName(blank).groupBy("shown", F.lit("track").alias("view")).agg(F.count("*").alias("n"))
