"""Registered queries of health, rates and mutations over all feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquilt.functions.folders import stored
from skyquilt.functions.text import entity_id, entity_token
from skyquilt.operators import cap, contracts, cot, health, mavlink, runs, state
from skyquilt.plans import lenses
from skyquilt.plans.catalog import _E, ORG, PLATFORM, now, query
from skyquilt.plans.runs import _WHOLE, feeds
from skyquilt.sources import replay



@query(
    "h5_all_adapters",
    _E + _WHOLE + """SELECT feed, count(*)::BIGINT AS received, count(*) FILTER (error IS NULL)::BIGINT AS decoded, count(error)::BIGINT AS parse_errors, sum(mutations)::BIGINT AS mutations, count(*) FILTER (error IS NULL AND mutations = 0)::BIGINT AS projection_drops,
    bool_or(error IS NULL AND position = last) AS ready, coalesce(max(CASE WHEN position = last THEN error END), '') AS last_error, feed || '-' || max(CASE WHEN error IS NULL THEN position END) AS last_name FROM (SELECT *, max(position) OVER (PARTITION BY feed) AS last FROM report) GROUP BY feed""",
)
def h5(spark, sf_dir):
    """Counters and last sights of all four adapters, from a run that does not stop."""
    report = runs.replay_run(feeds(spark, sf_dir), stop=False).withColumnRenamed("raw_ref", "ref").withColumn("at", F.timestamp_seconds("step"))
    h = health.adapter_health(report, "feed", "position", ["name"])
    return h.select("feed", "received", "decoded", "parse_errors", "mutations", "projection_drops", "ready", "last_error", "last_name")


@query(
    "h7_all_rates",
    _E + """, f AS (SELECT *, 12 + CASE event_type WHEN 'view' THEN 28 WHEN 'purchase' THEN 36 WHEN 'signup' THEN 28 ELSE 9 END AS size, event_type = 'error' AS bad FROM e), g AS (SELECT user_id % 4 AS s, min(ts) FILTER (NOT bad) AS first, count(*) FILTER (NOT bad) AS n, sum(size) FILTER (NOT bad) AS b, count(*) FILTER (bad) AS x, max(ts) AS last FROM f GROUP BY 1)
    SELECT 'uav-' || s AS source, round(n / w, 9) AS messages_per_second, round(b / w, 9) AS bytes_per_second, round(x / w, 9) AS errors_per_second, last AS last_activity FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-31') / 1e6 - epoch_us(first) / 1e6 AS w FROM g)""",
)
def h7(spark, sf_dir):
    frames = mavlink.decode(lenses.frames(spark, sf_dir))
    f = health.flow_rates(frames, "source", "received_at", F.octet_length("frame"), F.col("error"), now())
    return f.select("source", *[F.round(c, 9).alias(c) for c in ("messages_per_second", "bytes_per_second", "errors_per_second")], F.col("last_activity").cast("timestamp_ntz").alias("last_activity"))


@query(
    "h8_feed_staleness",
    _E + """, r AS (SELECT CASE user_id % 3 WHEN 0 THEN 'cap' WHEN 1 THEN 'adsb' ELSE 'sapient' END AS feed, 's' || user_id % 5 AS source, ts, CASE event_type WHEN 'error' THEN 500 WHEN 'click' THEN 304 ELSE 200 END AS st FROM e), g AS (SELECT feed, source, max(ts) FILTER (st = 200) AS fresh, max(ts) FILTER (st <> 500) AS contact FROM r GROUP BY feed, source), n AS (SELECT max(fresh) AS latest FROM g)
    SELECT feed, source, CASE WHEN epoch_us(latest) - epoch_us(fresh) > CASE feed WHEN 'cap' THEN 900 ELSE 120 END * 1000000 THEN 'stale' ELSE 'healthy' END AS status, contact > fresh AS contact_later FROM g, n""",
)
def h8(spark, sf_dir):
    """Three polled feeds with their own limits, as of the last fresh payload of all."""
    e = lenses.events(spark, sf_dir)
    feed = F.element_at(F.array(F.lit("cap"), F.lit("adsb"), F.lit("sapient")), (F.col("user_id") % 3 + 1).cast("int"))
    kind = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "click", 304).otherwise(200)
    r = e.select(feed.alias("feed"), F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("source"), F.col("received_at").alias("at"), kind.alias("status_code"))
    latest = r.filter("status_code = 200").agg(F.max("at").alias("latest"))
    # as of is one row: time runs to the latest fresh payload
    shifted = r.join(F.broadcast(latest), F.lit(True)).withColumn("at", F.timestamp_micros(F.unix_micros(now()) - (F.unix_micros("latest") - F.unix_micros("at")))).drop("latest")
    s = health.source_staleness(shifted, now())
    return s.select("feed", "source", "status", (F.col("contact_at") > F.col("fresh_at")).alias("contact_later"))


@query(
    "p21_all_mutations",
    _E + """, v AS (SELECT sys, event_id, event_id = min(event_id) OVER (PARTITION BY sys) AS first FROM usable), c AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'track' WHEN 'purchase' THEN 'track' WHEN 'click' THEN 'task' WHEN 'signup' THEN 'advisory' END AS kind FROM e WHERE k > 0 AND event_type <> 'error'),
    t AS (SELECT *, event_id = min(event_id) OVER (PARTITION BY kind, user_id) AS first FROM c), o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders)
    SELECT 0 AS batch, event_id AS arrival, 1 AS sub, CASE WHEN first THEN 'create' ELSE 'update' END AS kind, 'org.edge.cop.mavlink.track.system-' || sys AS subject, CASE WHEN first THEN 'create' ELSE 'update' END || '-track-' || sys AS request_id, 'feed.mavlink' AS owner, 'signal' AS indexing_profile FROM v
    UNION ALL SELECT 0, event_id, 0, 'create', 'org.edge.cop.mavlink.asset.system-' || sys, 'create-source-asset-' || sys, 'feed.asset', 'control' FROM v WHERE first
    UNION ALL SELECT 1, event_id, 1, CASE WHEN first THEN 'create' ELSE 'update' END, 'org.edge.cop.tak.' || kind || '.u-' || user_id, CASE WHEN first THEN 'create' ELSE 'update' END || '-' || kind || '-u-' || user_id, 'feed.tak', CASE kind WHEN 'track' THEN 'signal' WHEN 'task' THEN 'control' ELSE 'content' END FROM t
    UNION ALL SELECT 1, event_id, 0, 'create', 'org.edge.cop.tak.asset.u-' || user_id, 'create-source-asset-u-' || user_id, 'feed.asset', 'control' FROM t WHERE first AND kind = 'track'
    UNION ALL SELECT 3, k, 1, CASE WHEN first THEN 'create' ELSE 'update' END, 'org.edge.cop.cap.hazard_area.c-' || c, CASE WHEN first THEN 'create' ELSE 'append' END || '-hazard-evidence-c-' || c, 'feed.cap', 'content' FROM o""",
)
def p21(spark, sf_dir):
    """The mutations of vehicles, operators and warnings, with the source assets before their tracks."""
    rules = contracts.contracts(spark)
    seen = mavlink.usable(mavlink.decode(lenses.frames(spark, sf_dir))).withColumn("subject", mavlink.subject_of(ORG, PLATFORM, "track"))
    events = cot.sightings(cot.decode(lenses.cot_events(spark, sf_dir)), ORG, PLATFORM)
    hazard = entity_id(F.lit(ORG), F.lit(PLATFORM), "cap", "hazard_area", entity_token(F.col("identifier")))
    alerts = cap.decode(lenses.warning_histories(spark, sf_dir)).filter("error is null").withColumn("subject", hazard)
    asset = entity_id(F.lit(ORG), F.lit(PLATFORM), F.lit("tak"), F.lit("asset"), entity_token(F.col("uid")))
    # births read the sightings twice, the decoding is done once
    seen, events, alerts = [stored(rows.select("batch", "arrival", "ref", "subject", *more)) for rows, more in ((seen, ["system_id"]), (events, ["uid", "route"]), (alerts, ["identifier"]))]
    log = state.mutations(state.plan_births(seen), F.col("system_id").cast("string"), rules, mavlink.subject_of(ORG, PLATFORM, "asset"))
    log = log.unionByName(state.mutations(state.plan_births(events), entity_token(F.col("uid")), rules, F.when(F.col("route") == "track", asset)))
    log = log.unionByName(state.mutations(state.plan_births(alerts), entity_token(F.col("identifier")), rules))
    return log.select("batch", "arrival", "sub", "kind", "subject", "request_id", "owner", "indexing_profile")


@query(
    "s7_captured",
    _E + """SELECT 'cot' AS feed, count(*)::BIGINT AS captured, count(*) FILTER (k > 0)::BIGINT AS decoded FROM e UNION ALL SELECT 'mavlink', count(*), count(*) FILTER (event_type <> 'error') FROM e
    UNION ALL SELECT 'cap', count(*) FILTER (NOT bad), count(*) FILTER (NOT bad) FROM (SELECT o_orderkey % 3 <> 0 AND o_orderkey % 50 = 1 AS bad FROM orders)""",
)
def s7(spark, sf_dir):
    """How many records each lane keeps, and how many of them decode."""
    feeds_ = {"cot": cot.decode(lenses.cot_events(spark, sf_dir)), "mavlink": mavlink.decode(lenses.frames(spark, sf_dir)), "cap": cap.decode(lenses.warnings(spark, sf_dir))}
    out = None
    for feed, decoded in feeds_.items():
        kept = replay.captured(decoded, feed)
        part = kept.agg(F.count("*").alias("captured"), F.count_if(F.col("error").isNull()).alias("decoded")).select(F.lit(feed).alias("feed"), "captured", "decoded")
        out = part if out is None else out.unionByName(part)
    return out
