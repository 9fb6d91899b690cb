"""Registered queries of the restartable streams: files are landed in turns, the stream is stopped and started between."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquilt.functions.folders import cut, new_folder
from skyquilt.operators import mavlink, state
from skyquilt.plans import lenses
from skyquilt.plans.catalog import _E, KEEP, ORG, PLATFORM, SURE, query
from skyquilt.sources import store
from skyquilt.streaming import freshness, ingest

TURNS = 3


def landed(spark, rows, folder: str, turn, files: int = 2):
    """Lands ``rows`` in turns (``turn``: a column of 0 to TURNS - 1) as Parquet files; yields a fresh stream over them after each.

    The rows are made once. Each stream stands for a process of its own: it knows the one before by its folder only.
    """
    made = f"{folder}/made"
    rows.withColumn("__turn", turn).write.parquet(made)
    source = spark.read.parquet(made)
    for n in range(TURNS):
        source.filter(F.col("__turn") == n).drop("__turn").repartition(files, *rows.columns[:1]).write.mode("append").parquet(f"{folder}/in")
        yield spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")


def vehicles_seen(spark, sf_dir: str):
    return mavlink.usable(mavlink.decode(lenses.frames(spark, sf_dir))).withColumn("subject", mavlink.subject_of(ORG, PLATFORM, "track"))


@query(
    "m9_stream_state",
    _E + """SELECT 'org.edge.cop.mavlink.track.system-' || sys AS subject, max(event_id) AS last_event, strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS seen_at,
    arg_max(k, event_id) FILTER (event_type = 'purchase')::VARCHAR AS battery, max(event_id) FILTER (event_type = 'purchase') AS battery_event,
    arg_max('NED_CMPS(' || k * 10 - 500 || ' ' || -k || ' ' || event_id % 100 || ')', event_id) FILTER (event_type = 'view') AS velocity, max(event_id) FILTER (event_type = 'view') AS velocity_event FROM usable GROUP BY sys""",
)
def m9_stream_state(spark, sf_dir):
    """The state that three runs of a stream leave. Rows come out of order: each turn has every third event, so two turns are late."""
    folder = new_folder(spark, "m9")
    triples = mavlink.project(mavlink.decode(lenses.frames(spark, sf_dir)), ORG, PLATFORM, SURE, KEEP)
    for stream in landed(spark, triples, folder, F.col("arrival") % TURNS):
        ingest.StreamState(spark, folder).run(stream)
    held = ingest.StreamState(spark, folder).read(spark)
    of = lambda name, value: F.max(F.when(F.col("predicate") == f"cop.track.{name}", value))
    at = F.col("place.arrival")
    return held.groupBy("subject").agg(
        F.max(at).alias("last_event"), F.date_format(F.max_by("timestamp", "place"), "yyyy-MM-dd HH:mm:ss").alias("seen_at"),
        of("battery_remaining", F.col("object")).alias("battery"), of("battery_remaining", at).alias("battery_event"),
        of("velocity", F.col("object")).alias("velocity"), of("velocity", at).alias("velocity_event"),
    )


@query(
    "p18_seeded_births",
    _E + """, third AS (SELECT event_id, sys, event_id * 3 // (SELECT max(event_id) + 1 FROM events) AS turn FROM usable), old AS (SELECT DISTINCT sys FROM usable WHERE event_type = 'signup' AND user_id % 7 = 0),
    born AS (SELECT sys, min(event_id) AS first FROM third WHERE sys NOT IN (SELECT sys FROM old) GROUP BY sys)
    SELECT 'org.edge.cop.mavlink.track.system-' || sys AS subject, first AS created_at, CASE WHEN first IS NULL THEN 0 ELSE 1 END::BIGINT AS edges, CASE WHEN first IS NULL THEN 0 ELSE 1 END::BIGINT AS asset_names, count(*)::BIGINT AS observations
    FROM third LEFT JOIN born USING (sys) GROUP BY sys, first""",
)
def p18_seeded_births(spark, sf_dir):
    """Births of three runs of a stream over an entity table that has some vehicles already: a create, an asset and an edge once for each other."""
    folder, seen = new_folder(spark, "p18"), vehicles_seen(spark, sf_dir)
    project = lambda planned: mavlink.project_planned(planned, ORG, PLATFORM, SURE, KEEP)
    known = seen.filter((F.col("event_type") == "signup") & (F.col("user_id") % 7 == 0))
    last = seen.sparkSession.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] or 0
    for stream in landed(spark, seen, folder, F.floor(F.col("event_id") * TURNS / (last + 1))):
        births = ingest.StreamBirths(spark, folder, project)
        births.seed(known)
        births.run(stream)
    made = ingest.StreamBirths(spark, folder, project).triples(spark)
    edge = F.col("predicate") == "cop.track.source"
    track = F.when(F.split_part("subject", F.lit("."), F.lit(5)) == "asset", F.regexp_replace("subject", r"\.asset\.", ".track.")).otherwise(F.col("subject"))
    return made.groupBy(track.alias("subject")).agg(
        F.min(F.when(edge, F.col("arrival"))).alias("created_at"), F.count_if(edge).alias("edges"),
        F.count_if(F.col("predicate") == "cop.asset.name").alias("asset_names"), F.count_if(F.col("predicate") == "cop.track.observed_at").alias("observations"),
    )


@query(
    "r1_refs_over_batches",
    _E + """, turns AS (SELECT *, event_id * 3 // (SELECT max(event_id) + 1 FROM events) AS turn FROM e)
    SELECT event_id, 'mavlink://raw/uav-' || user_id % 4 || '/' || lpad((row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id))::VARCHAR, 8, '0') AS ref FROM turns""",
)
def r1_over_batches(spark, sf_dir):
    """References of three batches, numbered on from one to the next, equal to those of one."""
    folder = new_folder(spark, "r1")
    raw = lenses.frames(spark, sf_dir).select("event_id", "received_at", "source", "frame")
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] or 0
    for stream in landed(spark, raw, folder, F.floor(F.col("event_id") * TURNS / (last + 1))):
        ingest.StreamLane(spark, folder, "mavlink", F.col("frame"), ["event_id"]).run(stream)
    return ingest.StreamLane(spark, folder, "mavlink", F.col("frame"), ["event_id"]).read(spark).select("event_id", "ref")


@query(
    "s8_triple_store",
    _E + """, cut AS (SELECT min(event_id) AS stop FROM usable WHERE event_id * 5 > 4 * (SELECT max(event_id) FROM events) AND k = 7), done AS (SELECT usable.* FROM usable, cut WHERE stop IS NULL OR event_id < stop)
    SELECT p AS predicate, count(*)::BIGINT AS n, count(DISTINCT sys)::BIGINT AS n_subjects, max(event_id) AS last FROM (SELECT 'cop.track.battery_remaining' AS p, * FROM done WHERE event_type = 'purchase' UNION ALL SELECT 'cop.track.position', * FROM done WHERE event_type = 'view' UNION ALL SELECT 'cop.track.observed_at', * FROM done) GROUP BY p""",
)
def s8(spark, sf_dir):
    """What the store holds of vehicles' tracks: two batches, the second written twice and ended by an update of an entity that is not there."""
    path, seen = new_folder(spark, "s8"), vehicles_seen(spark, sf_dir)
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] or 0
    lost = (F.col("event_id") * 5 > 4 * last) & (F.col("k") == 7)
    planned = cut(state.plan_births(seen).withColumn("subject", F.when(lost, F.concat("subject", F.lit("-lost"))).otherwise(F.col("subject"))).withColumn("kind", F.when(lost, "update").otherwise(F.col("kind"))))
    first = F.col("event_id") * 2 <= last
    for part, rows in ((0, planned.filter(first)), (1, planned.filter(~first)), (1, planned.filter(~first))):
        applied = store.judged(rows, None if part == 0 else planned.filter(first).select("subject")).filter("applied")
        store.write_triples(mavlink.project_planned(applied, ORG, PLATFORM, SURE, KEEP), path, part)
    held = store.scan_triples(spark, path, f"{ORG}.{PLATFORM}.cop.mavlink.track")
    shown = held.filter(F.col("predicate").isin("cop.track.battery_remaining", "cop.track.position", "cop.track.observed_at"))
    return shown.groupBy("predicate").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("n_subjects"), F.max("arrival").alias("last"))


@query("h8_silent_sources", _E + "SELECT (user_id % 4)::VARCHAR AS id, 'stale' AS status, max(ts) FILTER (event_type <> 'error') AS since FROM e GROUP BY user_id % 4")
def h8(spark, sf_dir):
    """Sources that have fallen silent, from a stream: an error event is a contact that renews nothing."""
    folder = new_folder(spark, "h8")
    lenses.events(spark, sf_dir).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    told = freshness.freshness_changes(stream, F.col("user_id") % 4, F.col("received_at"), F.col("event_type") != "error", 120)
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/out/part={batch}")
    # one batch: a stream with timers goes on without input and would not end by itself
    told.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(once=True).start().awaitTermination()
    return spark.read.schema(freshness.TOLD).parquet(f"{folder}/out").select("id", "status", "since")
