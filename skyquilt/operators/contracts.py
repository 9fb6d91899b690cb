"""Governance: which owner may write which predicates of which entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (name, owner, system or *, entity type, indexing profile, write mode, predicates, source names).
_PROV = ["cop.provenance.source", "cop.provenance.confidence", "cop.provenance.observed_at", "cop.provenance.source_ref"]
_T = lambda *n: [f"cop.track.{x}" for x in n]
CONTRACTS = (
    ("asset-current-state", "feed.asset", "*", "asset", "control", "replace", [f"cop.asset.{x}" for x in ("name", "kind", "source", "native_id")] + _PROV),
    ("mavlink-track", "feed.mavlink", "mavlink", "track", "signal", "replace", _T("position", "velocity", "status", "observed_at", "native_id", "source", "roll", "pitch", "yaw", "battery_remaining") + _PROV),
    ("tak-track", "feed.tak", "tak", "track", "signal", "replace", _T("position", "velocity", "status", "observed_at", "native_id", "source") + _PROV),
    ("tak-task", "feed.tak", "tak", "task", "control", "replace", [f"cop.task.{x}" for x in ("name", "kind", "status", "position", "description", "native_id")] + _PROV),
    ("tak-advisory", "feed.tak", "tak", "advisory", "content", "replace", [f"cop.advisory.{x}" for x in ("text", "kind", "status", "sender", "position", "native_id")] + _PROV),
    ("cap-evidence", "feed.cap", "cap", "hazard_area", "content", "append", [f"cop.hazard.{x}" for x in ("advisory_text", "evidence", "source")] + _PROV),
    ("fusion-alert", "fusion.structural", "fusion", "alert", "control", "replace", [f"cop.alert.{x}" for x in ("severity", "status", "reason", "affected_entity", "source")] + _PROV),
)
# The source names that each owner writes under.
SOURCES = {"feed.asset": ["mavlink", "tak-cot", "adsb"], "feed.mavlink": ["mavlink"], "feed.tak": ["tak-cot"], "feed.cap": ["cap"], "feed.adsb": ["adsb"], "fusion.structural": ["fusion"]}
ADSB = ("adsb-track", "feed.adsb", "adsb", "track", "signal", "replace", _T("position", "velocity", "status", "observed_at", "native_id") + _PROV)


def contracts(spark: SparkSession, adsb: bool = True) -> DataFrame:
    """G1: one row per contract."""
    rows = [*CONTRACTS, *([ADSB] if adsb else [])]
    rows = [(*r, SOURCES[r[1]]) for r in rows]
    return spark.createDataFrame(rows, "contract string, owner string, system string, entity_type string, profile string, mode string, predicates array<string>, sources array<string>")


def _part(n: int) -> Column:
    return F.split_part("subject", F.lit("."), F.lit(n))


def match_contract(triples: DataFrame, rules: DataFrame) -> DataFrame:
    """Triples with the contract of their entity; null where there is none. The rules are a fixed small table."""
    narrow = rules.select("contract", "owner", "profile", "mode", "predicates", "sources", F.col("system").alias("__system"), F.col("entity_type").alias("__type"))
    fits = (_part(5) == F.col("__type")) & ((F.col("__system") == "*") | (_part(4) == F.col("__system")))
    return triples.join(F.broadcast(narrow), fits, "left").drop("__system", "__type")


def _fault() -> Column:
    uncovered = F.col("contract").isNull() | ~F.array_contains("predicates", F.col("predicate"))
    return F.when(uncovered, "unowned").when(~F.array_contains("sources", F.col("source")), "owner mismatch")


def find_unowned(triples: DataFrame, rules: DataFrame) -> DataFrame:
    """Writes that no contract covers, or whose source is not the owner's, with the reason."""
    matched = match_contract(triples, rules)
    return matched.withColumn("reason", _fault()).filter("reason is not null")


def find_overlaps(rules: DataFrame) -> DataFrame:
    """Pairs of contracts that both replace one predicate on entities that both cover."""
    one = rules.filter("mode = 'replace'").select("contract", "system", "entity_type", F.explode("predicates").alias("predicate"))
    two = one.select(F.col("contract").alias("other"), F.col("system").alias("other_system"), "entity_type", "predicate")
    meet = (F.col("system") == "*") | (F.col("other_system") == "*") | (F.col("system") == F.col("other_system"))
    return one.join(F.broadcast(two), ["entity_type", "predicate"]).filter((F.col("contract") < F.col("other")) & meet).select("contract", "other", "entity_type", "predicate")


def find_dangling_edges(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Source edges whose target is no known entity, or none that the target pattern takes: six parts, none blank, an asset of the domain ``cop``."""
    edges = triples.filter(F.col("predicate") == "cop.track.source").select("subject", F.col("object").alias("target"))
    fits = F.col("subject").rlike(r"^[^.]+\.[^.]+\.cop\.[^.]+\.asset\.[^.]+$")
    known = entities.filter(fits).select(F.col("subject").alias("target")).distinct()
    return edges.join(known, "target", "left_anti")


def route_by_profile(triples: DataFrame, rules: DataFrame) -> DataFrame:
    """Triples and entities by indexing profile."""
    return match_contract(triples, rules).groupBy(F.coalesce("profile", F.lit("none")).alias("profile")).agg(F.count("*").alias("n_triples"), F.countDistinct("subject").alias("n_entities"))


def violation_counters(triples: DataFrame, entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Counts that stay 0 on good data: unowned writes, writes under another owner's source, edges without a target, writes without a profile."""
    matched = match_contract(triples, rules).withColumn("reason", _fault())
    counts = matched.agg(F.count_if(F.col("reason") == "unowned").alias("n_unowned"), F.count_if(F.col("reason") == "owner mismatch").alias("n_mismatched"), F.count_if(F.col("profile").isNull()).alias("n_unprofiled"))
    dangling = find_dangling_edges(triples, entities).agg(F.count("*").alias("n_dangling"))
    return counts.join(dangling, F.lit(True))
