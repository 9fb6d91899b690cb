"""Restartable streams: stops in mid-stream, replays, late rows and crashes between the writes of a batch."""

import pytest
from pyspark.sql import functions as F

from skyquilt.operators import state
from skyquilt.streaming import ingest
from skyquilt.streaming.tables import KeyedTable

TRIPLES = "subject string, predicate string, object string, object_type string, source string, timestamp timestamp, confidence double, batch long, arrival long, idx long"


def triples(spark, n=120, shift=0):
    rows = [(f"s{i % 11}", f"p{i % 3}", str(i + shift), "long", f"f{i % 2}", 0.5 + i % 3 / 10, i % 2, i + shift, 0) for i in range(n)]
    return spark.createDataFrame(rows, "subject string, predicate string, object string, object_type string, source string, confidence double, batch long, arrival long, idx long").withColumn("timestamp", F.timestamp_seconds("arrival"))


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_state_over_restarts_equals_batch(spark, tmp_path):
    every = triples(spark)
    parts = [every.filter(F.col("arrival") % 3 == i).select(*[c.split()[0] for c in TRIPLES.split(", ")]) for i in (2, 0, 1)]  # late rows in the second and third run
    for part in parts:
        part.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(TRIPLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest.StreamState(spark, str(tmp_path / "out"), buckets=5).run(stream)
    held = ingest.StreamState(spark, str(tmp_path / "out"), buckets=5)
    assert rows(held.read(spark)) == rows(state.current_state(every))
    last, versions = held.table.versions(spark)
    assert last == 5 and set(versions) <= set(range(5))
    held.each(triples(spark, shift=1000), last)  # a replay of the last batch, even with other rows, changes nothing
    assert rows(held.read(spark)) == rows(state.current_state(every))
    held.each(every, last + 1)  # so do rows that are there already, in a new batch
    assert rows(held.read(spark)) == rows(state.current_state(every))
    assert held.table.vacuum(spark) > 0 and rows(held.read(spark)) == rows(state.current_state(every))


def test_only_touched_buckets_are_rewritten_and_a_crash_leaves_the_table(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), state.STATE, buckets=8)
    table.update(0, state.current_state(triples(spark)), state.running_state)
    before, (_, held) = rows(table.read(spark)), table.versions(spark)
    one = triples(spark, shift=500).filter("subject = 's3'")
    entered = KeyedTable._enter
    monkeypatch.setattr(KeyedTable, "_enter", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.update(1, state.current_state(one), state.running_state)
    assert rows(table.read(spark)) == before  # written, not entered
    monkeypatch.setattr(KeyedTable, "_enter", entered)
    assert table.update(1, state.current_state(one), state.running_state) and not table.update(1, state.current_state(one), state.running_state)
    _, now = table.versions(spark)
    changed = {b for b in now if now[b] != held.get(b)}
    assert changed == table.touched(one) and len(changed) == 1
    assert rows(table.read(spark)) == rows(state.current_state(triples(spark).unionByName(one)))
    assert table.update(2, state.current_state(one.limit(0)), state.running_state) and table.versions(spark) == (2, now)


def test_running_state_takes_a_state_and_triples(spark):
    every = triples(spark)
    old = state.current_state(every.filter("arrival % 2 = 0"))
    assert rows(state.running_state(old, every.filter("arrival % 2 = 1"))) == rows(state.current_state(every))
    assert rows(state.running_state(state.running_state(old, every), every)) == rows(state.current_state(every))


def project(planned):
    made = F.array(F.lit("seen"), F.when(F.col("kind") == "create", "edge"))
    return planned.select("subject", "arrival", F.explode(F.array_compact(made)).alias("predicate"))


def test_births_over_gaps_restarts_and_seeds(spark, tmp_path, monkeypatch):
    seen = [("a", 0, 1, 0), ("b", 0, 2, 0), ("a", 0, 3, 3 * 86400), ("c", 1, 4, 3 * 86400), ("b", 1, 5, 9 * 86400), ("d", 1, 6, 9 * 86400), ("old", 1, 7, 9 * 86400), ("d", 1, 8, 9 * 86400), (None, 1, 9, 0), (None, 1, 10, 0)]
    df = spark.createDataFrame(seen, "subject string, batch long, arrival long, at long").withColumn("timestamp", F.timestamp_seconds("at")).drop("at")
    folder = str(tmp_path / "b")
    for low, high in ((0, 2), (2, 5), (5, 11)):
        df.filter((F.col("arrival") > low) & (F.col("arrival") <= high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        births = ingest.StreamBirths(spark, folder, project, buckets=3)
        births.seed(df.filter("subject = 'old'"))
        births.run(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    made = ingest.StreamBirths(spark, folder, project, buckets=3).triples(spark)
    assert {r.subject: r.arrival for r in made.filter("predicate = 'edge'").collect()} == {"a": 1, "b": 2, "c": 4, "d": 6}  # no entity, no create
    assert made.filter("predicate = 'edge'").count() == 4 and made.filter("predicate = 'seen'").count() == len(seen)
    births.each(df, births.table.versions(spark)[0] - 1)  # a replay
    more = spark.createDataFrame([("e", 2, 11)], "subject string, batch long, arrival long")
    update = KeyedTable.update
    monkeypatch.setattr(KeyedTable, "update", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        births.each(more, 7)
    assert births.triples(spark).filter("subject = 'e'").count() == 0  # written, but its entities are not entered
    monkeypatch.setattr(KeyedTable, "update", update)
    births.each(more, 7)
    births.each(more, 7)
    assert births.triples(spark).filter("subject = 'e'").count() == 2


def test_lane_numbers_go_on(spark, tmp_path):
    raw = spark.createDataFrame([("a" if i % 3 else None, i, bytearray(b"x" if i % 5 else b"")) for i in range(60)], "source string, at long, payload binary")
    lane = ingest.StreamLane(spark, str(tmp_path / "l"), "cot", F.col("payload"), ["at"])
    for n in range(3):
        part = raw.filter((F.col("at") >= n * 20) & (F.col("at") < n * 20 + 20))
        lane.each(part, n)
        lane.each(part, n)
    from skyquilt.operators.lane import assign_refs

    whole = assign_refs(raw, "cot", F.col("payload"), ["at"])
    assert sorted((r.at, r.ref) for r in lane.read(spark).collect()) == sorted((r.at, r.ref) for r in whole.collect())


def test_silence_is_told_without_a_new_event(spark, tmp_path):
    import time

    from skyquilt.streaming.freshness import freshness_changes

    told = []
    shape = "source string, at timestamp, status int"

    def land(*rows):
        spark.createDataFrame(rows, "source string, status int").withColumn("at", F.current_timestamp()).select("source", "at", "status").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def until(n, seconds=60):
        end = time.time() + seconds
        while len(told) < n and time.time() < end:
            time.sleep(0.2)

    def start():
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        changes = freshness_changes(stream, F.col("source"), F.col("at"), F.col("status") == 200, 6)
        return changes.writeStream.outputMode("update").foreachBatch(lambda df, _: told.extend((r.id, r.status, r.since is None) for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()

    land(("a", 200), ("b", 304))
    query = start()
    until(2)  # a at its timer, without any further row
    assert told[:2] == [("b", "stale", True), ("a", "stale", False)]
    query.stop()
    land(("a", 304), ("c", 200))  # a contact does not renew; known again after a restart
    query = start()
    until(3)
    land(("a", 200))
    until(4)
    until(5)
    query.stop()
    assert sorted(told[2:4]) == [("a", "live", False), ("c", "stale", False)] and told[4] == ("a", "stale", False)


def test_mutations_apply_in_order_until_the_first_failure(spark, tmp_path):
    from skyquilt.sources import store

    rows = [("create", "a", 1), ("update", "a", 2), ("update", "old", 3), ("create", "b", 4), ("update", "x", 5), ("update", "b", 6), ("create", "a", 7), ("create", "old", 8), ("update", " ", 9), ("create", None, 10)]
    df = spark.createDataFrame([(k, s, 0, n) for k, s, n in rows], "kind string, subject string, batch int, arrival int").repartition(3)
    old = spark.createDataFrame([("old",)], "subject string")
    got = {r.arrival: (r.error, r.applied) for r in store.judged(df, old).collect()}
    assert got == {1: (None, True), 2: (None, True), 3: (None, True), 4: (None, True), 5: ("not found", False), 6: (None, False), 7: ("already exists", False), 8: ("already exists", False), 9: ("blank id", False), 10: ("blank id", False)}
    assert store.judged(df.limit(0)).count() == 0
    path = str(tmp_path / "t")
    made = spark.createDataFrame([(f"o.p.cop.{s}.{t}.{i}", "p", str(i)) for s in ("tak", "mavlink") for t in ("track", "asset") for i in range(5)], "subject string, predicate string, object string")
    store.write_triples(made, path, 0)
    store.write_triples(made.filter("object = '1'"), path, 1)
    store.write_triples(made.filter("object = '1'"), path, 1)
    assert store.scan_triples(spark, path).count() == 24
    some = store.scan_triples(spark, path, "o.p.cop.tak.track")
    assert some.count() == 6 and some.columns == made.columns
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(system" in plan and "tak" in plan.split("PartitionFilters")[1]
    store.write_triples(made, str(tmp_path / "u"))
    store.write_triples(made, str(tmp_path / "u"))
    assert store.scan_triples(spark, str(tmp_path / "u")).count() == 40
