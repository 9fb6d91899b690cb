"""Registered queries of the whole picture: all four feeds, discovery with its limit, and the snapshot document.

The SQL builds the same views from the source columns once; each query reads what it needs of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.functions.folders import cut
from skyquilt.operators import adsb, snapshot, state, views
from skyquilt.plans import lenses
from skyquilt.plans.catalog import _E, _H, KEEP, ORG, PLATFORM, hazard_view, now, operator_triples, query, vehicle_triples, window

LIMIT = 100


def triples_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of vehicles, operators and aircraft; the states of one snapshot arrive in their order."""
    states = adsb.decode(lenses.snapshots(spark, sf_dir), "slot").withColumn("arrival", F.col("slot") * 1_000_000 + F.coalesce("state_no", F.lit(0)))
    return vehicle_triples(spark, sf_dir).unionByName(operator_triples(spark, sf_dir)).unionByName(adsb.project(states, ORG, PLATFORM, 0.85, KEEP))


def picture(spark: SparkSession, sf_dir: str, limit: int = LIMIT) -> dict[str, DataFrame]:
    """Every view of the picture, from what discovery finds."""
    current = cut(state.current_state(triples_of_all(spark, sf_dir)))
    hazards = cut(hazard_view(spark, sf_dir))
    ids = current.select("subject").distinct().unionByName(hazards.select("subject"))
    targets = views.discovery_targets(spark, [(ORG, PLATFORM)])
    found = views.discover(ids, targets, limit).select("subject")
    diagnostics = views.discovery_diagnostics(ids, targets, limit)
    held = current.join(found, "subject", "left_semi")
    wide = state.wide(held)
    tracks = views.tracks(wide, now(), window())
    own = {n: c for n, c in state.STATE_PREDICATES.items() if n.startswith(("name", "kind", "asset_", "native", "prov", "source_ref"))} | {"observed_at": "cop.provenance.observed_at"}
    assets = views.assets(state.wide(views.of_type(held, "asset"), own), tracks)
    tasks = views.tasks(state.wide(views.of_type(held, "task"), views.TASK_COLUMNS | views.PROVENANCE_COLUMNS), now(), window())
    advisories = views.advisories(state.wide(views.of_type(held, "advisory"), views.ADVISORY_COLUMNS | views.PROVENANCE_COLUMNS), now(), window())
    shown = hazards.join(found, "subject", "left_semi")
    observed = views.feed_observations(tracks, tasks, advisories, shown)
    return {
        "discovery": diagnostics, "feeds": views.feed_health(spark, observed, now(), window()), "assets": assets, "tracks": tracks, "tasks": tasks,
        "advisories": advisories, "hazards": shown, "alerts": views.discovery_alerts(diagnostics, now()), "observations": observed,
    }


_P = _E + _H + f""", good AS (SELECT *, floor(epoch(ts) / 600)::BIGINT AS slot FROM e WHERE floor(epoch(ts) / 600)::BIGINT NOT IN (SELECT floor(epoch(ts) / 600)::BIGINT FROM e WHERE k = 99)),
air AS (SELECT user_id, arg_max(event_id, slot * 100000000 + event_id) AS last, arg_max(CASE WHEN k % 4 <> 0 THEN event_id END, CASE WHEN k % 4 <> 0 THEN slot * 100000000 + event_id END) AS at FROM good GROUP BY user_id),
op AS (SELECT user_id, max(event_id) AS last, min(event_id) AS first FROM e WHERE k > 0 AND event_type IN ('view', 'purchase') GROUP BY user_id),
mav AS (SELECT sys, max(event_id) FILTER (event_type = 'view') AS p, arg_max(ts, event_id) AS seen_at, arg_min(ts, event_id) AS first_at FROM usable GROUP BY sys),
beat AS (SELECT sys, arg_max(CASE k % 6 WHEN 3 THEN 'standby' WHEN 4 THEN 'active' ELSE 'unknown' END, event_id) AS s, arg_max(CASE WHEN ((k * 5) % 256) & 128 <> 0 THEN '.armed' ELSE '' END, event_id) AS armed FROM usable WHERE event_type = 'click' GROUP BY sys),
said AS (SELECT event_type, user_id, max(event_id) AS last FROM e WHERE k > 0 AND event_type IN ('click', 'signup') GROUP BY event_type, user_id),
x AS (SELECT TIMESTAMP '2024-01-31' - INTERVAL 6 HOUR AS fresh),
every AS (
SELECT 'tracks' AS c, 'mavlink.track' AS target, 'org.edge.cop.mavlink.track.system-' || sys AS id, 'UAS ' || sys AS label, 'mavlink' AS source, CASE WHEN seen_at < fresh THEN 'stale' ELSE coalesce(s, 'unknown') END || coalesce(armed, '') AS status,
  ((p * 104729) % 2000000000 - 1000000000) / 1e7 AS lon, ((p * 7919) % 1000000000 - 500000000) / 1e7 AS lat, seen_at AS updated_at, sys AS key FROM x, mav LEFT JOIN beat USING (sys)
UNION ALL SELECT 'tracks', 'tak.track', 'org.edge.cop.tak.track.u-' || op.user_id, 'U-' || op.user_id, 'tak-cot', CASE WHEN date_trunc('second', ts) < fresh OR k % 5 = 0 THEN 'stale.' ELSE 'active.' END || CASE event_type WHEN 'view' THEN 'operator' ELSE 'air-track' END,
  (-(event_id % 180))::DOUBLE, (event_id % 90)::DOUBLE, date_trunc('second', ts), op.user_id FROM x, op JOIN e ON event_id = last
UNION ALL SELECT 'tracks', 'adsb.track', 'org.edge.cop.adsb.track.' || lower(lpad(to_hex(air.user_id), 6, '0')), CASE WHEN l.k % 3 <> 0 THEN 'CALL' || air.user_id ELSE upper(lpad(to_hex(air.user_id), 6, '0')) END, 'adsb',
  CASE WHEN date_trunc('second', l.ts) < fresh THEN 'stale' ELSE 'active' END || '.aircraft' || CASE WHEN l.k % 2 = 0 THEN '.ground' ELSE '' END, CASE WHEN a.k IS NOT NULL THEN -77.25 END, CASE WHEN a.k >= 50 THEN a.k - 49.5 ELSE a.k - 50.5 END, date_trunc('second', l.ts), air.user_id
  FROM x, air JOIN e l ON l.event_id = air.last LEFT JOIN e a ON a.event_id = air.at
UNION ALL SELECT 'assets', 'mavlink.asset', 'org.edge.cop.mavlink.asset.system-' || sys, 'MAVLink system ' || sys, 'mavlink', NULL, NULL, NULL, first_at, sys FROM mav
UNION ALL SELECT 'assets', 'tak.asset', 'org.edge.cop.tak.asset.u-' || op.user_id, 'C' || k, 'tak-cot', NULL, NULL, NULL, date_trunc('second', ts), op.user_id FROM op JOIN e ON event_id = first
UNION ALL SELECT CASE said.event_type WHEN 'click' THEN 'tasks' ELSE 'advisories' END, CASE said.event_type WHEN 'click' THEN 'tak.task' ELSE 'tak.advisory' END, 'org.edge.cop.tak.' || CASE said.event_type WHEN 'click' THEN 'task' ELSE 'advisory' END || '.u-' || said.user_id,
  CASE said.event_type WHEN 'click' THEN 'C' || k ELSE 'GeoChat S-' || said.user_id END, 'tak-cot', CASE WHEN date_trunc('second', ts) < fresh OR k % 5 = 0 THEN 'stale.' ELSE 'active.' END || CASE said.event_type WHEN 'click' THEN 'marker' ELSE 'geochat' END,
  (-(event_id % 180))::DOUBLE, (event_id % 90)::DOUBLE, date_trunc('second', ts), said.user_id FROM x, said JOIN e ON event_id = last
UNION ALL SELECT 'hazards', 'cap.hazard_area', 'org.edge.cop.cap.hazard_area.w-' || h.key, 'High Wind: Zone ' || h.key % 7, 'cap', status, NULL, NULL, o_orderdate::TIMESTAMP, h.key FROM h JOIN orders ON o_orderkey = h.key),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS n, count(*) OVER (PARTITION BY target) AS total FROM every),
held AS (SELECT * FROM ranked WHERE n <= {LIMIT} AND NOT (c = 'tracks' AND lon IS NULL)),
shown AS (SELECT h.c, h.id, h.label, h.source, h.status, h.updated_at, coalesce(h.lon, t.lon) AS lon, coalesce(h.lat, t.lat) AS lat FROM held h LEFT JOIN held t ON h.c = 'assets' AND t.c = 'tracks' AND t.target = replace(h.target, 'asset', 'track') AND t.key = h.key),
targets AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS position, unnest(['mavlink.asset', 'mavlink.track', 'tak.asset', 'tak.track', 'tak.task', 'tak.advisory', 'cap.hazard_area', 'adsb.track']) AS target),
diag AS (SELECT position, target, coalesce(max(total), 0) AS total FROM targets LEFT JOIN ranked USING (target) GROUP BY position, target),
spoke AS (SELECT CASE WHEN source = 'tak-cot' OR c IN ('tasks', 'advisories') THEN 'feed.tak' WHEN c = 'hazards' THEN 'feed.cap' ELSE 'feed.' || source END AS feed, count(*)::BIGINT AS n, max(updated_at) AS last FROM shown WHERE c <> 'assets' GROUP BY 1),
feeds AS (SELECT f.feed, f.rank, coalesce(n, 0) AS n, CASE WHEN last IS NULL THEN empty WHEN last < fresh THEN 'stale' ELSE 'live' END AS status, last, CASE WHEN last IS NULL THEN 'none' WHEN last < fresh THEN 'old' ELSE 'new' END AS kind
  FROM x, (VALUES ('feed.mavlink', 0, 'stale'), ('feed.tak', 1, 'stale'), ('feed.cap', 2, 'planned'), ('feed.adsb', 3, 'planned')) f(feed, rank, empty) LEFT JOIN spoke USING (feed)) """


@query(
    "s9_snapshot",
    _P + """, alerts AS (SELECT position, 'alert.discovery.org.edge.' || replace(target, '_', '-') || '.limit' AS id FROM diag WHERE total > 100), parts AS (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY id) - 1 AS place, id, label, status, round(lon, 6) AS lon, round(lat, 6) AS lat FROM shown
    UNION ALL SELECT 'feeds', rank, feed, kind, status, NULL, NULL FROM feeds UNION ALL SELECT 'discovery', position, 'org.edge.cop.' || target, least(total, 100)::VARCHAR, (total > 100)::VARCHAR, NULL, NULL FROM diag
    UNION ALL SELECT 'alerts', row_number() OVER (ORDER BY position) - 1, id, NULL, 'active', NULL, NULL FROM alerts
    UNION ALL SELECT 'summary', 0, '2024-01-31T00:00:00Z', concat_ws('/', count(*) FILTER (c = 'tracks'), count(*) FILTER (c = 'tasks'), count(*) FILTER (c = 'advisories'), (SELECT count(*) FROM alerts), (SELECT count(*) FROM feeds WHERE status = 'stale')), 'phase-1-live-graph', NULL, NULL FROM shown)
    SELECT c, place::INT AS place, id, label, status, lon, lat FROM parts""",
)
def s9(spark, sf_dir):
    """The document of the snapshot, read back: every member of every collection with its place."""
    views_ = picture(spark, sf_dir)
    one = snapshot.document({n: v for n, v in views_.items() if n != "observations"}, now())
    member = "id string, label string, status string, position struct<lat double, lon double>, geometry array<struct<lat double, lon double>>, message string"
    counts = ", ".join(f"{c} long" for c in ("active_tracks", "active_tasks", "active_advisories", "active_alerts", "stale_feeds"))
    shape = f"generated_at string, scenario string, summary struct<{counts}>, diagnostics struct<discovery array<struct<prefix string, `count` long, at_limit boolean>>>, " + ", ".join(f"{n} array<struct<{member}>>" for n in list(snapshot.COLLECTIONS)[1:])
    doc = cut(one.select(F.from_json("snapshot", shape, {"mode": "FAILFAST"}).alias("d"))).select("d.*")
    out = doc.select(F.lit("summary").alias("c"), F.lit(0).alias("place"), F.col("generated_at").alias("id"), F.concat_ws("/", "summary.active_tracks", "summary.active_tasks", "summary.active_advisories", "summary.active_alerts", "summary.stale_feeds").alias("label"), F.col("scenario").alias("status"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"))
    found = doc.select(F.posexplode("diagnostics.discovery").alias("place", "m"))
    out = out.unionByName(found.select(F.lit("discovery").alias("c"), "place", F.col("m.prefix").alias("id"), F.col("m.count").cast("string").alias("label"), F.col("m.at_limit").cast("string").alias("status"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat")))
    kind = F.when(F.startswith("m.message", F.lit("Graph")), "new").when(F.startswith("m.message", F.lit("Last")), "old").otherwise("none")
    for name in list(snapshot.COLLECTIONS)[1:]:
        label = kind if name == "feeds" else F.lit(None).cast("string") if name == "alerts" else F.col("m.label")
        row = doc.select(F.posexplode(name).alias("place", "m"))
        out = out.unionByName(row.select(F.lit(name).alias("c"), "place", "m.id", label.alias("label"), "m.status", F.round("m.position.lon", 6).alias("lon"), F.round("m.position.lat", 6).alias("lat")))
    return out


@query("q5_all_feeds", _P + "SELECT 'org.edge.cop.' || target AS prefix, least(total, 100)::BIGINT AS n, total > 100 AS at_limit FROM diag")
def q5(spark, sf_dir):
    return picture(spark, sf_dir)["discovery"].select("prefix", "n", "at_limit")


@query("h1_all_feeds", _P + "SELECT feed, status, n, strftime(CASE WHEN last IS NOT NULL THEN last WHEN rank = 2 THEN TIMESTAMP '2024-01-30 23:27:00' WHEN rank = 3 THEN TIMESTAMP '2024-01-30 23:15:00' ELSE TIMESTAMP '2024-01-31' END, '%Y-%m-%d %H:%M') AS last_minute FROM feeds")
def h1(spark, sf_dir):
    """H1, H2: the health of every feed over all its members, and how many they are."""
    p = picture(spark, sf_dir)
    n = p["observations"].groupBy("feed").agg(F.count("*").alias("n"))
    return p["feeds"].join(n, "feed", "left").select("feed", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.date_format("last_event_at", "yyyy-MM-dd HH:mm").alias("last_minute"))


@query("h3_all_feeds", _P + """SELECT count(*) FILTER (c = 'tracks')::BIGINT AS n_tracks, count(*) FILTER (c = 'tasks')::BIGINT AS n_tasks, count(*) FILTER (c = 'advisories')::BIGINT AS n_advisories,
    (SELECT count(*) FROM diag WHERE total > 100)::BIGINT AS n_alerts, (SELECT count(*) FROM feeds WHERE status = 'stale')::BIGINT AS n_stale_feeds FROM shown""")
def h3(spark, sf_dir):
    p = picture(spark, sf_dir)
    return views.summary({n: p[n] for n in ("tracks", "tasks", "advisories", "alerts")}, p["feeds"]).select("n_tracks", "n_tasks", "n_advisories", "n_alerts", "n_stale_feeds")


@query("h4_discovery_alerts", _P + """, shaped AS (SELECT *, CASE target WHEN 'cap.hazard_area' THEN 'CAP hazard area' WHEN 'adsb.track' THEN 'ADS-B track' ELSE CASE split_part(target, '.', 1) WHEN 'tak' THEN 'TAK/CoT' ELSE 'MAVLink' END || ' ' || split_part(target, '.', 2) END AS name, 'alert.discovery.org.edge.' || replace(target, '_', '-') AS base FROM diag)
    SELECT base || '.limit' AS id, name || ' discovery truncated' AS label, 'feed.' || split_part(target, '.', 1) AS entity_id FROM shaped WHERE total > 100
    UNION ALL SELECT base || '.error', name || ' discovery error', 'feed.' || split_part(target, '.', 1) FROM shaped WHERE total < 100""")
def h4(spark, sf_dir):
    """Alerts of targets with more than the limit, and of those that an (injected) error names: every target with fewer."""
    d = picture(spark, sf_dir)["discovery"]
    failing = d.withColumn("error", F.when((F.col("n") < LIMIT), "timeout"))
    return views.discovery_alerts(failing, now()).select("id", "label", "entity_id")


@query("t1_all_feeds", _P + "SELECT c AS kind, id AS subject, label, round(lon, 6) AS lon, round(lat, 6) AS lat FROM shown WHERE lon IS NOT NULL AND c <> 'hazards'")
def t1(spark, sf_dir):
    p = picture(spark, sf_dir)
    layer = views.point_layer(tracks=p["tracks"], assets=p["assets"].withColumnRenamed("name", "label"), tasks=p["tasks"], advisories=p["advisories"])
    return layer.filter("lon is not null").select("kind", "subject", "label", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("t5_entity_index", _P + "SELECT c AS kind, id AS subject, label FROM shown")
def t5(spark, sf_dir):
    """The pick list of all entities, hazards and those without a position included."""
    p = picture(spark, sf_dir)
    none = F.lit(None).cast("double")
    layer = views.point_layer(tracks=p["tracks"], assets=p["assets"].withColumnRenamed("name", "label"), tasks=p["tasks"], advisories=p["advisories"], hazards=p["hazards"].withColumns({"lon": none, "lat": none}))
    return layer.select("kind", "subject", "label")
