"""Replay runs over the feeds: one order of steps, cut at the first error before anything is born."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.folders import cut
from skyquilt.operators.order import numbered
from skyquilt.operators.state import plan_births

STEP = ("feed_rank", "position")


@dataclass
class Feed:
    """Inputs of a feed in a run.

    ``inputs``: (position, name, raw_ref, error), one row for each. ``sightings``: (position, sub, subject) of entities
    that a good input shows, ``sub`` their order in it, and ``also``: how many more mutations come with a create.
    """

    name: str
    inputs: DataFrame
    sightings: DataFrame
    also: Column | int = 0


def steps_of(feeds: list[Feed]) -> DataFrame:
    """The inputs of all feeds, feed by feed, each in the order given."""
    out = None
    for rank, feed in enumerate(feeds):
        part = feed.inputs.select(F.lit(rank).alias("feed_rank"), F.lit(feed.name).alias("feed"), F.col("position").cast("long").alias("position"), "name", "raw_ref", "error")
        out = part if out is None else out.unionByName(part)
    return out


def until_first_error(steps: DataFrame) -> DataFrame:
    """The steps up to and with the first that fails in the order of all feeds; the bound is one row."""
    stop = steps.filter(F.col("error").isNotNull()).agg(F.min(F.struct(*STEP)).alias("__stop"))
    return steps.join(F.broadcast(stop), F.lit(True)).filter(F.col("__stop").isNull() | (F.struct(*STEP) <= F.col("__stop"))).drop("__stop")


def replay_run(feeds: list[Feed], existing: DataFrame | None = None, stop: bool = True) -> DataFrame:
    """The step report (step, feed, position, name, raw_ref, mutations, error) of a run.

    Births are planned over what the run reaches only: an entity that a later step would show first is not born.
    """
    steps = cut(steps_of(feeds))  # narrow rows, read for the stop, the births and the report
    ran = until_first_error(steps) if stop else steps
    seen = None
    for rank, feed in enumerate(feeds):
        also = F.lit(feed.also) if isinstance(feed.also, int) else feed.also
        part = feed.sightings.select(F.lit(rank).alias("feed_rank"), F.col("position").cast("long").alias("position"), F.col("sub").cast("long").alias("sub"), "subject", also.cast("long").alias("also"))
        seen = part if seen is None else seen.unionByName(part)
    reached = cut(seen).join(ran.filter(F.col("error").isNull()).select(*STEP), list(STEP), "left_semi")
    planned = plan_births(reached, existing, (*STEP, "sub"))
    written = planned.groupBy(*STEP).agg(F.sum(F.lit(1) + F.when(F.col("kind") == "create", F.col("also")).otherwise(0)).alias("mutations"))
    report = ran.join(written, list(STEP), "left").withColumn("mutations", F.coalesce("mutations", F.lit(0)))
    return numbered(report, *STEP, name="step").select("step", "feed", "position", "name", "raw_ref", "mutations", "error")


def run_report(report: DataFrame, feeds: list[str]) -> DataFrame:
    """One row: inputs by feed, mutations, errors, completed and failed steps, last error and state of a step report; a run without steps is idle."""
    failed = F.col("error").isNotNull()
    inputs = [F.count_if(F.col("feed") == f).alias(f"n_{f}") for f in feeds]
    out = report.agg(*inputs, F.coalesce(F.sum("mutations"), F.lit(0)).alias("mutations"), F.count_if(failed).alias("failed"), F.count_if(~failed).alias("completed"), F.max_by("error", F.when(failed, F.col("step"))).alias("last_error"))
    state = F.when(F.col("failed") > 0, "failed").when(F.col("completed") > 0, "succeeded").otherwise("idle")
    return out.withColumn("state", state)
