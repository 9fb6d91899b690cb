"""One document of the whole picture, with ordered nested collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.text import owner_of

SCENARIO = "phase-1-live-graph"
#: The collections in the order of the document, and the name of their size in the summary.
COLLECTIONS = {"discovery": None, "feeds": None, "assets": None, "tracks": "active_tracks", "tasks": "active_tasks", "advisories": "active_advisories", "hazards": None, "alerts": "active_alerts"}


def rfc3339(at: Column) -> Column:
    """A time as text, with no more digits of a second than it needs."""
    return F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"\.?0*Z$", "Z")


def _item(kind: str, columns: list[str]) -> tuple[Column, Column]:
    """The order key of a collection's rows, and the JSON object of one; what is null is left out."""
    col, text = F.col, lambda c: F.coalesce(c, F.lit("")).alias(c)
    filled = lambda c: F.nullif(c, F.lit("")).alias(c)
    if kind == "discovery":
        order = F.format_string("%s.%s.%08d", "org", "platform", "position")
        return order, F.struct("org", "platform", "source", "family", "entity_type", "prefix", col("n").alias("count"), col("lim").alias("limit"), "at_limit", filled("error"))
    if kind == "feeds":
        rank = F.when(col("feed") == "feed.mavlink", "0").when(col("feed") == "feed.tak", "1").when(col("feed") == "feed.cap", "2").when(col("feed") == "feed.adsb", "3").otherwise(F.concat(F.lit("4"), col("feed")))
        return rank, F.struct(col("feed").alias("id"), "name", "kind", "status", rfc3339(col("last_event_at")).alias("last_event_at"), "message")
    if kind == "alerts":
        return col("place"), F.struct("id", "label", "severity", "status", "entity_id", "reason", rfc3339(col("updated_at")).alias("updated_at"))
    point = F.when(col("lon").isNotNull() & col("lat").isNotNull(), F.struct("lat", "lon")).alias("position") if "lon" in columns else None
    owner = F.lit("feed.asset") if kind == "assets" else F.lit("feed.cap") if kind == "hazards" else owner_of(col("source"))
    provenance = F.struct(owner.alias("owner"), text("source_ref"), rfc3339(col("updated_at")).alias("observed_at")).alias("provenance")
    tail = ["confidence", rfc3339(col("updated_at")).alias("updated_at"), provenance]
    own = {
        "assets": [col("name").alias("label"), "kind", "source", point],
        "tracks": ["label", "source", "status", point, "velocity"],
        "tasks": ["label", "kind", "source", "status", point, filled("description")],
        "advisories": ["label", "kind", "source", "status", "text", filled("sender"), point],
        "hazards": ["label", "kind", "severity", "status", "geometry", F.lit("cap").alias("source")],
    }[kind]
    return col("subject"), F.struct(col("subject").alias("id"), *own, *tail)


def document(views: dict[str, DataFrame], now: Column, scenario: str = SCENARIO) -> DataFrame:
    """One row with ``snapshot``: the views by collection (see COLLECTIONS; all optional), each in order of its ids.

    The rows of all collections are dealt out by ranges of (collection, order); each range is made one text, and the
    texts of a collection, one for each range, are joined in order. No collection is sorted in one task. Equal ids
    stand in order of their JSON.
    """
    rows = None
    for name in COLLECTIONS:
        if name in views:
            order, item = _item(name, views[name].columns)
            stale = (F.col("status") == "stale") if name == "feeds" else F.lit(False)
            part = views[name].select(F.lit(name).alias("c"), order.alias("key"), F.to_json(item).alias("json"), stale.alias("stale"))
            rows = part if rows is None else rows.unionByName(part)
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, "c", "key", "json").withColumn("part", F.spark_partition_id())
    texts = lambda inner, of: F.array_join(F.transform(F.sort_array(F.collect_list(inner)), lambda x: x[of]), ",")
    ranged = dealt.groupBy("c", "part").agg(texts(F.struct("key", "json"), "json").alias("text"), F.count("*").alias("n"), F.count_if("stale").alias("stale"))
    whole = ranged.groupBy("c").agg(texts(F.struct("part", "text"), "text").alias("text"), F.sum("n").alias("n"), F.sum("stale").alias("stale"))
    of = lambda name, what: F.max(F.when(F.col("c") == name, F.col(what)))
    one = whole.agg(*[of(n, "text").alias(n) for n in COLLECTIONS], *[F.coalesce(of(n, "n"), F.lit(0)).alias(size) for n, size in COLLECTIONS.items() if size], F.coalesce(of("feeds", "stale"), F.lit(0)).alias("stale_feeds"))
    summary = F.to_json(F.struct(*[size for size in COLLECTIONS.values() if size], "stale_feeds"))
    array = lambda name: F.concat(F.lit("["), F.coalesce(name, F.lit("")), F.lit("]"))
    pieces = [F.lit('{"generated_at":"'), rfc3339(now), F.lit('","scenario":'), F.to_json(F.array(F.lit(scenario))), F.lit(',"summary":'), summary, F.lit(',"diagnostics":{"discovery":'), array("discovery"), F.lit("}")]
    pieces[3] = F.regexp_extract(pieces[3], r"^\[(.*)\]$", 1)
    for name in list(COLLECTIONS)[1:]:
        pieces += [F.lit(f',"{name}":'), array(name)]
    return one.select(F.concat(*pieces, F.lit("}")).alias("snapshot"))
