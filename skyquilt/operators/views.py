"""Snapshot views, discovery, feed health, alerts and map layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyquilt.functions.text import freshness_status, source_label, source_of, track_label, wkt_lat, wkt_lon, wkt_ok

# Discovery targets in order, (source, entity type, family), and feeds (id, name, kind, planned minutes).
TARGETS = (("mavlink", "asset", "mavlink"), ("mavlink", "track", "mavlink"), ("tak", "asset", "cot"), ("tak", "track", "cot"), ("tak", "task", "cot"), ("tak", "advisory", "cot"), ("cap", "hazard_area", "cap"), ("adsb", "track", "adsb"))
FEEDS = (("feed.mavlink", "MAVLink", "telemetry", None), ("feed.tak", "TAK/CoT", "operators", None), ("feed.cap", "CAP", "advisory", 33), ("feed.adsb", "ADS-B", "air-picture", 45))
# What a feed says without any observation, and with a fresh one.
FEED_TEXTS = {
    "feed.mavlink": ("Waiting for graph-backed MAVLink state", "Graph-backed source asset and track state"),
    "feed.tak": ("Waiting for graph-backed TAK/CoT state", "Graph-backed CoT tracks, tasks, and advisories"),
    "feed.cap": ("Schema/sample gate pending", "Graph-backed civilian alert evidence"),
    "feed.adsb": ("ADS-B projection gate pending", "Graph-backed ADS-B aircraft tracks"),
}
OUTSIDE = "Last graph-backed state is outside freshness window"
# Fixed value: where the map looks when there is nothing to show (lon, lat).
CENTRE = (-77.0002, 38.9001)
LIMIT = 500


def tracks(wide: DataFrame, now: Column, window: Column) -> DataFrame:
    """Entities of type track that have a readable position."""
    kind = F.split_part("subject", F.lit("."), F.lit(5))
    rows = wide.filter((kind == "track") & wkt_ok(F.col("position")))
    source = F.coalesce("provenance", source_of(F.col("subject")))
    status = freshness_status(F.coalesce("status", F.lit("unknown")), now, F.col("updated_at"), window)
    return rows.select("subject", track_label(F.col("subject"), F.col("native_id")).alias("label"), source.alias("source"), status.alias("status"), wkt_lon(F.col("position")).alias("lon"), wkt_lat(F.col("position")).alias("lat"), F.coalesce("velocity", F.lit("")).alias("velocity"), "confidence", "updated_at", "track_source", "source_ref")


def assets(wide: DataFrame, tracks_view: DataFrame) -> DataFrame:
    """V2: assets with the position of the track that names them as its source; of several the greatest track id."""
    lent = tracks_view.filter("track_source is not null").groupBy(F.col("track_source").alias("subject")).agg(F.max_by(F.struct("lon", "lat"), "subject").alias("at"))
    rows = wide.filter(F.split_part("subject", F.lit("."), F.lit(5)) == "asset")
    return rows.join(lent, "subject", "left").select("subject", F.coalesce("name", F.split_part("subject", F.lit("."), F.lit(6))).alias("name"), F.coalesce("kind", F.lit("asset")).alias("kind"), F.coalesce("asset_source", source_of(F.col("subject"))).alias("source"), F.col("at.lon").alias("lon"), F.col("at.lat").alias("lat"), "confidence", "updated_at", "source_ref")


def discovery_targets(spark: SparkSession, scopes: list[tuple[str, str]]) -> DataFrame:
    """Q3: scopes times the eight targets, in order."""
    rows = [(org, platform, i, s, t, f, f"{org}.{platform}.cop.{s}.{t}") for org, platform in scopes for i, (s, t, f) in enumerate(TARGETS)]
    return spark.createDataFrame(rows, "org string, platform string, position int, source string, entity_type string, family string, prefix string")


def prefix_scan(entities: DataFrame, prefix: str, limit: int = LIMIT) -> DataFrame:
    """Q1: the first ``limit`` entities under a five-part prefix, by id, with whether there are more."""
    under = entities.filter(F.substring_index("subject", ".", 5) == prefix).select("subject").distinct()
    first = under.orderBy("subject").limit(limit + 1)
    n = first.agg((F.count("*") > limit).alias("truncated"))
    return first.orderBy("subject").limit(limit).join(F.broadcast(n), F.lit(True))


def get_entities(requested: DataFrame, current: DataFrame) -> DataFrame:
    """Q2: every requested id (column subject) with whether it is known and how many properties it has; unknown ids are no error."""
    known = current.groupBy("subject").agg(F.count("*").alias("n_properties"), F.max("timestamp").alias("updated_at"))
    return requested.join(known, "subject", "left").select("subject", F.col("n_properties").isNotNull().alias("found"), F.coalesce("n_properties", F.lit(0)).cast("long").alias("n_properties"), "updated_at")


def discover(entities: DataFrame, targets: DataFrame, limit: int = LIMIT, salts: int = 64) -> DataFrame:
    """Q4: (prefix, subject): the first ``limit`` entities of each target by id; blank ids are skipped.

    First the best of each of ``salts`` parts of a prefix are taken, so that no prefix is ranked whole in one task.
    """
    named = entities.filter(F.trim("subject") != "").select(F.substring_index("subject", ".", 5).alias("prefix"), "subject").distinct().join(F.broadcast(targets.select("prefix")), "prefix", "left_semi")
    part = W.partitionBy("prefix", F.pmod(F.xxhash64("subject"), F.lit(salts))).orderBy("subject")
    best = named.withColumn("__n", F.row_number().over(part)).filter(F.col("__n") <= limit)
    return best.withColumn("__n", F.row_number().over(W.partitionBy("prefix").orderBy("subject"))).filter(F.col("__n") <= limit).drop("__n")


def feed_observations(tracks_view: DataFrame, tasks_view: DataFrame, advisories_view: DataFrame, hazards_view: DataFrame | None = None) -> DataFrame:
    """H2: (feed, updated_at): tracks by their source; all tasks and advisories speak for TAK, all hazards for CAP."""
    feed = F.when(F.col("source") == "tak-cot", "feed.tak").otherwise(F.concat(F.lit("feed."), F.col("source")))
    out = tracks_view.select(feed.alias("feed"), "updated_at")
    for view in (tasks_view, advisories_view):
        out = out.unionByName(view.select(F.lit("feed.tak").alias("feed"), "updated_at"))
    return out if hazards_view is None else out.unionByName(hazards_view.select(F.lit("feed.cap").alias("feed"), "updated_at"))


def discovery_diagnostics(entities: DataFrame, targets: DataFrame, limit: int = LIMIT, errors: DataFrame | None = None) -> DataFrame:
    """Q4, Q5: how many entities each target finds, up to the limit, and whether there are more; ``errors`` (prefix, error) are of targets that could not be read."""
    counts = entities.groupBy(F.substring_index("subject", ".", 5).alias("prefix")).agg(F.countDistinct("subject").alias("__n"))
    n = F.coalesce("__n", F.lit(0))
    joined = targets.join(counts, "prefix", "left")
    joined = joined.withColumn("error", F.lit(None).cast("string")) if errors is None else joined.join(errors, "prefix", "left")
    return joined.select("org", "platform", "source", "family", "entity_type", "prefix", F.least(n, F.lit(limit)).cast("long").alias("n"), F.lit(limit).cast("long").alias("lim"), (n > limit).alias("at_limit"), "position", "error")


def family_fallback(configured: DataFrame, diagnostics: DataFrame, entities: DataFrame) -> DataFrame:
    """Q6: configured ids (family, subject) of families of which nothing was discovered in any scope; ADS-B has none."""
    found = diagnostics.filter("n > 0").select("family").distinct()
    return configured.filter("family <> 'adsb'").join(found, "family", "left_anti").join(entities, "subject")


def discovery_alerts(diagnostics: DataFrame, now: Column) -> DataFrame:
    """H4: one alert for each error of a diagnostic (if it has a column ``error``) and one for each truncation, the error first by ``position``."""
    slug = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(c)), "[_ ]", "-"), F.lit("")), F.lit("unknown"))
    error = F.nullif("error", F.lit("")) if "error" in diagnostics.columns else F.lit(None).cast("string")
    failed = F.struct(F.lit(0).alias("sub"), F.lit("error").alias("what"), F.lit("error").alias("suffix"), F.concat(F.lit("Prefix query for "), F.col("prefix"), F.lit(" returned an error: "), error).alias("reason"))
    many = F.format_string("Prefix query returned %d entities of more than the configured limit of %d; snapshot results may be truncated.", "n", "lim")
    cut_off = F.struct(F.lit(1).alias("sub"), F.lit("truncated").alias("what"), F.lit("limit").alias("suffix"), many.alias("reason"))
    each = F.array_compact(F.array(F.when(error.isNotNull(), failed), F.when(F.col("at_limit"), cut_off)))
    rows = diagnostics.withColumn("a", F.explode(each))
    label = F.concat_ws(" ", source_label(F.col("source")), F.replace("entity_type", F.lit("_"), F.lit(" ")), F.lit("discovery"), F.col("a.what"))
    feed = F.concat(F.lit("feed."), slug("source"))
    id_ = F.concat_ws(".", F.lit("alert.discovery"), slug("org"), slug("platform"), slug("source"), slug("entity_type"), F.col("a.suffix"))
    place = [F.format_string("%08d.%d", F.col("position"), F.col("a.sub")).alias("place")] if "position" in diagnostics.columns else []
    return rows.select(id_.alias("id"), label.alias("label"), F.lit("warning").alias("severity"), F.lit("active").alias("status"), feed.alias("entity_id"), F.col("a.reason").alias("reason"), now.alias("updated_at"), *place)


def feed_health(spark: SparkSession, observations: DataFrame, now: Column, window: Column) -> DataFrame:
    """H1, H2: ``observations`` (feed, updated_at) to one row per feed, also for feeds without any."""
    feeds = spark.createDataFrame(list(FEEDS), "feed string, name string, kind string, planned int")
    last = observations.groupBy("feed").agg(F.max("updated_at").alias("last"))
    joined = feeds.join(last, "feed", "left")
    empty = F.when(F.col("planned").isNotNull(), "planned").otherwise("stale")
    status = F.when(F.col("last").isNull(), empty).when(now - F.col("last") > window, "stale").otherwise("live")
    at = F.coalesce("last", F.when(F.col("planned").isNotNull(), F.timestamp_micros(F.unix_micros(now) - F.col("planned").cast("long") * 60_000_000)).otherwise(now))
    text = lambda i: F.coalesce(*[F.when(F.col("feed") == f, t[i]) for f, t in FEED_TEXTS.items()])
    message = F.when(F.col("last").isNull(), text(0)).when(now - F.col("last") > window, OUTSIDE).otherwise(text(1))
    return joined.select("feed", "name", "kind", status.alias("status"), at.alias("last_event_at"), message.alias("message"))


def summary(views: dict[str, DataFrame], feeds: DataFrame) -> DataFrame:
    """H3: the size of each view, stale ones included, and how many feeds are stale."""
    out = feeds.agg(F.count_if(F.col("status") == "stale").alias("n_stale_feeds"))
    for name, view in views.items():
        out = out.join(view.agg(F.count("*").alias(f"n_{name}")), F.lit(True))
    return out


def ordered(view: DataFrame, *by: str) -> DataFrame:
    """A view in order of its ids (or of ``by``): a sort by ranges, by the bytes of the text."""
    return view.orderBy(*(by or ("subject",)))


def map_bounds(points: DataFrame) -> DataFrame:
    """T4: the box around points (lon, lat) with its pads and centre; without any, the default box."""
    box = points.agg(*[f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))])
    lon, lat = CENTRE
    edge = lambda c, pad, default: F.coalesce(F.col(c) + pad, F.lit(default))
    sides = box.select(
        edge("min_lon", -0.01, lon - 0.02).alias("west"), edge("min_lat", -0.008, lat - 0.02).alias("south"), edge("max_lon", 0.01, lon + 0.02).alias("east"), edge("max_lat", 0.008, lat + 0.02).alias("north"),
    )
    return sides.select("*", ((F.col("west") + F.col("east")) / 2).alias("lon"), ((F.col("south") + F.col("north")) / 2).alias("lat"))


def nearest(points: DataFrame, lon: float, lat: float, k: int) -> DataFrame:
    """The k points (subject, lon, lat) nearest to a place, by great circle; a top-k, so no point is gathered."""
    a = F.pow(F.sin(F.radians(F.col("lat") - lat) / 2), 2) + F.cos(F.radians(F.col("lat"))) * F.cos(F.radians(F.lit(lat))) * F.pow(F.sin(F.radians(F.col("lon") - lon) / 2), 2)
    return points.withColumn("km", 2 * 6371.0088 * F.asin(F.sqrt(a))).orderBy("km", "subject").limit(k)


def positions_by_window(points: DataFrame, length: str = "1 hour") -> DataFrame:
    """How many positions each object has in each time window, and the last of them."""
    return points.groupBy("subject", F.window("timestamp", length).alias("w")).agg(F.count("*").alias("n"), F.max_by("object", "timestamp").alias("last_position")).select("subject", F.col("w.start").alias("window_start"), "n", "last_position")


TASK_COLUMNS = {n: f"cop.task.{n}" for n in ("name", "kind", "status", "position", "description", "native_id")}
ADVISORY_COLUMNS = {n: f"cop.advisory.{n}" for n in ("text", "kind", "status", "sender", "position", "native_id")}
PROVENANCE_COLUMNS = {"provenance": "cop.provenance.source", "source_ref": "cop.provenance.source_ref", "provenance_confidence": "cop.provenance.confidence", "observed_at": "cop.provenance.observed_at"}


def of_type(rows: DataFrame, kind: str) -> DataFrame:
    """Rows whose subject is an entity of a type."""
    return rows.filter(F.split_part("subject", F.lit("."), F.lit(5)) == kind)


def _common(now: Column, window: Column) -> list[Column]:
    """Source, status with freshness and optional position of a wide entity."""
    status = freshness_status(F.coalesce("status", F.lit("unknown")), now, F.col("updated_at"), window)
    return [F.coalesce("provenance", source_of(F.col("subject"))).alias("source"), status.alias("status"), wkt_lon(F.col("position")).alias("lon"), wkt_lat(F.col("position")).alias("lat"), F.col("confidence"), F.col("updated_at"), F.col("source_ref")]


def tasks(wide: DataFrame, now: Column, window: Column) -> DataFrame:
    """V3: every task, also without a position; ``wide`` has TASK_COLUMNS and PROVENANCE_COLUMNS."""
    label = F.coalesce("name", "native_id", F.split_part("subject", F.lit("."), F.lit(6)))
    return of_type(wide, "task").select("subject", label.alias("label"), F.coalesce("kind", F.lit("task")).alias("kind"), F.coalesce("description", F.lit("")).alias("description"), *_common(now, window))


def advisories(wide: DataFrame, now: Column, window: Column) -> DataFrame:
    """V4: advisories with a text; ``wide`` has ADVISORY_COLUMNS and PROVENANCE_COLUMNS."""
    label = F.when(F.col("sender").isNotNull(), F.concat(F.lit("GeoChat "), F.col("sender"))).otherwise(F.col("text"))
    return of_type(wide, "advisory").filter(F.col("text").isNotNull()).select("subject", label.alias("label"), F.coalesce("kind", F.lit("advisory")).alias("kind"), "text", F.coalesce("sender", F.lit("")).alias("sender"), *_common(now, window))


def point_layer(**layers: DataFrame) -> DataFrame:
    """Named views (subject, label, lon, lat) as one list with their kind; filter on lon for those on the map."""
    parts = [view.select(F.lit(kind).alias("kind"), "subject", "label", "lon", "lat") for kind, view in layers.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def polygon_layer(hazards: DataFrame) -> DataFrame:
    """Hazards of three points or more as rings of (lon, lat)."""
    return hazards.filter(F.size("geometry") >= 3).select("subject", "label", F.transform("geometry", lambda p: F.array(p["lon"], p["lat"])).alias("polygon"))


def hazard_labels(hazards: DataFrame) -> DataFrame:
    """The label of each hazard at the mean of its vertices."""
    mean = lambda c: F.aggregate("geometry", F.lit(0.0), lambda acc, p: acc + p[c]) / F.size("geometry")
    return hazards.filter(F.size("geometry") >= 3).select("subject", "label", mean("lon").alias("lon"), mean("lat").alias("lat"))


def stale_track_alerts(tracks_view: DataFrame) -> DataFrame:
    """One alert for each stale track."""
    old = (F.col("status") == "stale") | F.startswith("status", F.lit("stale."))
    return tracks_view.filter(old).select(F.concat(F.lit("alert.stale."), F.col("subject")).alias("id"), F.col("subject").alias("entity_id"), F.lit("warning").alias("severity"), "updated_at")


def low_battery_alerts(state: DataFrame, below: int) -> DataFrame:
    """One alert for each vehicle whose current battery is under a threshold."""
    level = F.col("object").try_cast("int")
    return state.filter((F.col("predicate") == "cop.track.battery_remaining") & (level < below)).select(F.concat(F.lit("alert.battery."), F.col("subject")).alias("id"), F.col("subject").alias("entity_id"), F.lit("warning").alias("severity"), level.alias("battery"))


def associate(left: DataFrame, right: DataFrame, within: str = "1 hour", owner: str = "fusion.structural") -> DataFrame:
    """E5: evidence that two entities are one: rows (subject, stable_id, at) of two sources with equal ids, seen within a time of each other.

    Ids are compared by their letters and digits, in upper case; one without any matches nothing. Give each side one row
    for each entity (its last): then an id meets only the entities that bear it. The evidence is the fusion owner's.
    """
    bare = F.nullif(F.regexp_replace(F.upper("stable_id"), r"[^\p{L}\p{Nd}]", ""), F.lit(""))
    one, other = [side.select(F.col("subject").alias(f"{n}_subject"), F.col("at").alias(f"{n}_at"), bare.alias("id")) for n, side in (("left", left), ("right", right))]
    apart = F.abs(F.unix_micros("left_at") - F.unix_micros("right_at"))
    limit = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {within}"))
    met = one.join(other, "id").filter((F.col("left_subject") != F.col("right_subject")) & (apart <= limit))
    return met.select(F.col("left_subject").alias("subject"), F.lit("cop.association.same_as").alias("predicate"), F.col("right_subject").alias("object"), F.lit(owner).alias("owner"), F.greatest("left_at", "right_at").alias("timestamp"))


def snapshot_fallback(views: dict[str, DataFrame], fixture: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Q7: the rows of ``fixture`` where all views are empty, else the views; decided on Spark, from one row a view at most."""
    seen = None
    for view in views.values():
        some = view.limit(1).select(F.lit(1).alias("__one"))
        seen = some if seen is None else seen.unionByName(some)
    empty = seen.agg((F.count("*") == 0).alias("__empty"))
    out = {}
    for name, view in views.items():
        stored = fixture[name].join(F.broadcast(empty), F.lit(True)).filter("__empty").drop("__empty")
        out[name] = view.unionByName(stored.select(*view.columns))
    return out


def inside(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point lies in a ring of (lat, lon), by the parity of the edges to its east."""

    def crosses(a: Column, b: Column) -> Column:
        slope = F.try_divide((b["lon"] - a["lon"]) * (lat - a["lat"]), b["lat"] - a["lat"])
        return F.coalesce(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < slope + a["lon"]), F.lit(False))

    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: crosses(a, b).cast("int"))
    return F.aggregate(edges, F.lit(0), lambda acc, x: acc + x) % 2 == 1


#: Sides of the cells that points and hazards meet in, in degrees; a hazard takes the least that covers its box with few of them.
CELL_SIDES = (1 / 16, 1 / 4, 1, 4, 16, 64, 256)
FEW = 4


def hazard_intersections(points: DataFrame, hazards: DataFrame) -> DataFrame:
    """(entity_id, hazard_id) of points (subject, lon, lat) in hazards, met on cells as large as each hazard needs.

    A hazard has one row for each cell of its box, at most (FEW + 1) ** 2 whatever its size; a point has one for each
    size of cell. So small hazards meet only points close by, and a hazard over half the globe is not copied to every degree.
    """
    side = lambda f, c: f(F.transform("geometry", lambda p: p[c]))
    boxed = hazards.filter(F.size("geometry") >= 3).select(F.col("subject").alias("hazard_id"), "geometry", *[side(f, c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("min", F.array_min), ("max", F.array_max))])
    wide = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
    size = F.lit(float(CELL_SIDES[-1]))
    for s in reversed(CELL_SIDES[:-1]):
        size = F.when(wide <= s * FEW, float(s)).otherwise(size)
    cells = boxed.withColumn("cell", size)
    for c, at in (("lon", "x"), ("lat", "y")):
        cells = cells.withColumn(at, F.explode(F.sequence(F.floor(F.col(f"min_{c}") / F.col("cell")), F.floor(F.col(f"max_{c}") / F.col("cell")))))
    cells = cells.select("hazard_id", "geometry", "cell", "x", "y")
    placed = points.filter("lon is not null and lat is not null").select(F.col("subject").alias("entity_id"), "lon", "lat", F.explode(F.array(*[F.lit(float(s)) for s in CELL_SIDES])).alias("cell"))
    placed = placed.withColumns({"x": F.floor(F.col("lon") / F.col("cell")), "y": F.floor(F.col("lat") / F.col("cell"))})
    return placed.join(cells, ["cell", "x", "y"]).filter(inside(F.col("lon"), F.col("lat"), F.col("geometry"))).select("entity_id", "hazard_id")
