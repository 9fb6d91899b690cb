"""Births, mutations and current state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

#: The columns of a state; place is where in the order of writing the object stands.
STATE = StructType([
    *[StructField(c, StringType()) for c in ("subject", "predicate", "object", "object_type")],
    StructField("timestamp", TimestampType()), StructField("confidence", DoubleType()), StructField("source", StringType()),
    StructField("place", StructType([StructField(c, LongType()) for c in ("batch", "arrival", "idx")])),
])
STATE_PREDICATES = {
    "position": "cop.track.position",
    "velocity": "cop.track.velocity",
    "status": "cop.track.status",
    "track_source": "cop.track.source",
    "native_id": "cop.track.native_id",
    "observed_at": "cop.track.observed_at",
    "name": "cop.asset.name",
    "kind": "cop.asset.kind",
    "asset_source": "cop.asset.source",
    "provenance": "cop.provenance.source",
    "source_ref": "cop.provenance.source_ref",
    "provenance_confidence": "cop.provenance.confidence",
}


def plan_births(sightings: DataFrame, existing: DataFrame | None = None, order: tuple[str, ...] = ("batch", "arrival")) -> DataFrame:
    """``sightings`` (subject, *order) with kind: create for the first one of an entity that is not in ``existing``.

    The first one is a minimum by entity, so no entity's sightings meet in one window.
    """
    first = sightings.groupBy("subject").agg(F.min(F.struct(*order)).alias("__first"))
    if existing is not None:
        first = first.join(existing.select("subject").distinct(), "subject", "left_anti")
    joined = sightings.join(first, "subject", "left")
    return joined.withColumn("kind", F.when(F.struct(*order).eqNullSafe(F.col("__first")), "create").otherwise("update")).drop("__first")


def whole_batches(items: DataFrame, batch: str, bad: str = "error") -> DataFrame:
    """The batches without any bad item."""
    spoiled = items.filter(F.col(bad).isNotNull()).select(batch).distinct()
    return items.join(spoiled, batch, "left_anti")


def mutation_log(planned: DataFrame, profile: str, owner: str) -> DataFrame:
    """One row per mutation in order of (batch, arrival), with its message type, request id and, as trace id, the raw reference."""
    name = F.split_part("subject", F.lit("."), F.lit(5))
    request = F.concat_ws("-", "kind", name, F.split_part("subject", F.lit("."), F.lit(6)), F.col("arrival").cast("string"))
    message = F.when(F.col("kind") == "create", "entity.create").otherwise("entity.update")
    return planned.select("batch", "arrival", "kind", message.alias("message_type"), "subject", name.alias("entity_type"), F.lit(profile).alias("indexing_profile"), F.lit(owner).alias("owner"), F.col("ref").alias("trace_id"), request.alias("request_id"))


def mutations(planned: DataFrame, token: Column, rules: DataFrame, asset: Column | None = None) -> DataFrame:
    """All mutations of ``planned`` sightings (batch, arrival, kind, subject, ref) in order of (batch, arrival, sub), with owner and profile by contract.

    Where ``asset`` is not null, a create is preceded by that of its source asset. ``token`` names the entity in request
    ids. Evidence of hazards is appended, not updated.
    """
    created, kind = F.col("kind") == "create", F.split_part("subject", F.lit("."), F.lit(5))
    name = F.when(kind == "hazard_area", "hazard-evidence").otherwise(kind)
    verb = F.when(created, "create").when(kind == "hazard_area", "append").otherwise("update")
    own = F.struct(F.lit(1).alias("sub"), "kind", F.col("subject").alias("id"), F.concat_ws("-", verb, name, token).alias("request_id"))
    before = F.struct(F.lit(0).alias("sub"), F.lit("create").alias("kind"), asset.alias("id"), F.concat(F.lit("create-source-asset-"), token).alias("request_id")) if asset is not None else None
    each = F.array_compact(F.array(F.when(created & asset.isNotNull(), before), own)) if asset is not None else F.array(own)
    rows = planned.select("batch", "arrival", F.col("ref").alias("trace_id"), F.explode(each).alias("m")).select("batch", "arrival", "m.sub", "m.kind", F.col("m.id").alias("subject"), "m.request_id", "trace_id")
    held = rules.select("owner", F.col("profile").alias("indexing_profile"), F.col("system").alias("__system"), F.col("entity_type").alias("__type"))
    fits = (F.split_part("subject", F.lit("."), F.lit(5)) == F.col("__type")) & ((F.col("__system") == "*") | (F.split_part("subject", F.lit("."), F.lit(4)) == F.col("__system")))
    return rows.join(F.broadcast(held), fits, "left").drop("__system").withColumnRenamed("__type", "entity_type")


def append_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """M2: every triple is kept, equal ones too."""
    return old.unionByName(new)


def current_state(triples: DataFrame, order: tuple[str, ...] = ("batch", "arrival", "idx")) -> DataFrame:
    """M1: the last written object by entity and predicate; a maximum by key, combined before the shuffle."""
    value = F.struct("object", "object_type", "timestamp", "confidence", "source")
    place = F.struct(*order)
    return triples.groupBy("subject", "predicate").agg(F.max_by(value, place).alias("v"), F.max(place).alias("place")).select("subject", "predicate", "v.*", "place")


def latest_property(evidence: DataFrame) -> DataFrame:
    """M3: for appended evidence: the object of the greatest time, ties by later position."""
    return evidence.groupBy("subject", "predicate").agg(F.max_by("object", F.struct("timestamp", "batch", "arrival", "idx")).alias("object"))


def entities(triples: DataFrame) -> DataFrame:
    """M4: the ids with type, first batch and last update."""
    return triples.groupBy("subject").agg(F.max("timestamp").alias("updated_at"), F.count("*").alias("n_triples")).withColumn("entity_type", F.split_part("subject", F.lit("."), F.lit(5)))


def wide(state: DataFrame, columns: dict[str, str] | None = None, observed: tuple[str, ...] = ("observed_at",), now: Column | None = None) -> DataFrame:
    """M5-M8: chosen predicates as columns; empty text counts as missing, with confidence (the stated one, else the first above 0 in order of writing) and update time resolved.

    The update time is the first of the columns ``observed`` that can be read, else the last time of all triples, else ``now``.
    """
    columns = columns or STATE_PREDICATES
    object_ = F.nullif("object", F.lit(""))
    picked = [F.max(F.when(F.col("predicate") == p, object_)).alias(n) for n, p in columns.items()]
    some = F.min_by(F.when(F.col("confidence") > 0, F.col("confidence")), F.when(F.col("confidence") > 0, F.col("place")))
    out = state.groupBy("subject").agg(*picked, F.max("timestamp").alias("__last"), some.alias("__some"))
    named = [F.try_to_timestamp(c) for c in observed if c in columns]
    out = out.withColumn("updated_at", F.coalesce(*named, F.col("__last"), *([now] if now is not None else [])))
    stated = F.col("provenance_confidence").try_cast("double") if "provenance_confidence" in columns else F.lit(None).cast("double")
    return out.withColumn("confidence", F.coalesce(stated, "__some", F.lit(1.0))).drop("__last", "__some")


def running_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """M9: a state and the triples (or the state) of a new batch, merged; re-running a batch, or an old one, changes nothing."""
    new = new if "place" in new.columns else current_state(new)
    columns = STATE.names
    both = old.select(*columns).unionByName(new.select(*columns))
    return both.groupBy("subject", "predicate").agg(F.max_by(F.struct(*columns[2:]), "place").alias("v")).select("subject", "predicate", "v.*")


def stop_at_first_error(steps: DataFrame, order: str) -> DataFrame:
    """The steps up to and with the first failure."""
    first = steps.filter(F.col("error").isNotNull()).agg(F.min(order).alias("__stop"))
    return steps.join(F.broadcast(first), F.lit(True)).filter(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop"))).drop("__stop")


def run_summary(steps: DataFrame) -> DataFrame:
    """``steps`` (feed, error) to inputs, completed and failed steps and the state of each feed's run."""
    failed = F.count_if(F.col("error").isNotNull())
    out = steps.groupBy("feed").agg(F.count("*").alias("inputs"), failed.alias("failed"))
    return out.select("feed", "inputs", (F.col("inputs") - F.col("failed")).alias("completed"), "failed", F.when(F.col("failed") > 0, "failed").otherwise("succeeded").alias("state"))
