"""Health of adapters and flows: what came in, what became of it, how fast, and who has fallen silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds between polls, and after how many polls without anything fresh a feed is stale.
POLLS = {"cap": (300, 3), "adsb": (30, 4), "sapient": (30, 4)}
REFUSED = "not captured"


def adapter_health(inputs: DataFrame, by: str, order: str, headline: list[str] | None = None) -> DataFrame:
    """H5, H6: by feed or source: counters, whether it is ready, and what was seen last.

    ``inputs``: ``by``, ``order``, at, ref, error (REFUSED for what the lane did not take) and mutations (null counts as
    none). A good input without mutations is a projection drop. Ready: the last input has no error; ``last_error`` is
    its error, blank after a good one; the ``headline`` columns are those of the last good input. One row a group.
    """
    good, taken = F.col("error").isNull(), F.coalesce(F.col("error") != REFUSED, F.lit(True))
    written = F.coalesce("mutations", F.lit(0))
    last = lambda value, when: F.max_by(value, F.when(when, F.col(order)))
    return inputs.groupBy(by).agg(
        F.count("*").alias("received"), F.count_if(taken).alias("captured"), F.count_if(~taken).alias("capture_errors"), F.count_if(good).alias("decoded"), F.count_if(~good & taken).alias("parse_errors"),
        F.sum(written).cast("long").alias("mutations"), F.count_if(good & (written == 0)).alias("projection_drops"), F.max_by(good, order).alias("ready"), F.coalesce(F.max_by("error", order), F.lit("")).alias("last_error"),
        last(F.col("ref"), taken).alias("last_ref"), F.max("at").alias("last_event_at"), F.max(F.when(written > 0, F.col("at"))).alias("last_write_at"), *[last(F.col(c), good).alias(f"last_{c}") for c in headline or []],
    )


def flow_rates(messages: DataFrame, by: str, at: str, size: Column, error: Column, now: Column) -> DataFrame:
    """H7: messages, bytes and errors a second from the first message of each group to ``now`` (no time counts as a second), and the last activity.

    An input with an error is no message and has no bytes.
    """
    good = error.isNull()
    begun = F.min(F.when(good, F.col(at)))
    elapsed = F.unix_micros(now) / 1e6 - F.unix_micros(begun) / 1e6
    seconds = F.when(elapsed > 0, elapsed).otherwise(1.0)
    rate = lambda x: F.coalesce(x, F.lit(0)) / seconds
    return messages.groupBy(by).agg(rate(F.count_if(good)).alias("messages_per_second"), rate(F.sum(F.when(good, size))).alias("bytes_per_second"), rate(F.count_if(~good)).alias("errors_per_second"), F.max(at).alias("last_activity"))


def source_staleness(responses: DataFrame, now: Column, feed: str = "feed", polls: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """H8: (feed, source, status, fresh_at, contact_at) of polled ``responses`` (feed, source, at, status_code): stale without a fresh payload for so many polls.

    An answer of 304 is a contact, not freshness; a source that never had anything fresh is stale; so is one of a feed
    without a poll interval once it has nothing.
    """
    polls = POLLS if polls is None else polls
    limit = F.lit(None).cast("double")
    for name, (seconds, times) in polls.items():
        limit = F.when(F.col(feed) == name, float(seconds * times)).otherwise(limit)
    fresh = F.max(F.when(F.col("status_code").between(200, 299), F.col("at")))
    contact = F.max(F.when(F.col("status_code").between(200, 299) | (F.col("status_code") == 304), F.col("at")))
    rows = responses.groupBy(feed, "source").agg(fresh.alias("fresh_at"), contact.alias("contact_at"))
    old = F.unix_micros(now) / 1e6 - F.unix_micros("fresh_at") / 1e6 > limit
    return rows.select(feed, "source", F.when(F.col("fresh_at").isNull() | F.coalesce(old, F.lit(False)), "stale").otherwise("healthy").alias("status"), "fresh_at", "contact_at")
