"""Orders by ranges, frame scans of cut captures, replay runs, joins in space and time, and the snapshot document, by brute force."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from skyquilt.operators import order, runs, snapshot, spatial, views
from skyquilt.streaming import incremental
from test_feeds import BEAT, POSITION, frame


@pytest.mark.parametrize("ranges", [1, 7, 23])
def test_before_equals_a_plain_scan(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["hot"] * 5 + ["b", "c", None]), i, rng.choice([None, rng.randrange(50)])) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(5)
    got = order.before(df, ["k"], ["at"], ranges, last=(F.col("v"), "last"), most=(F.col("v"), "max"), total=(F.col("v"), "sum"))
    state, want = {}, {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        want[at] = state.get(k, (None, None, None))
        if v is not None:
            last, most, total = want[at]
            state[k] = (v, v if most is None else max(v, most), v + (total or 0))
    assert {r.at: (r.last, r.most, r.total) for r in got.collect()} == want
    numbers = order.numbered(df, "at", name="n")
    assert {r.at: r.n for r in numbers.collect()} == {i: i + 1 for i in range(300)}
    assert order.before(df.limit(0), ["k"], ["at"], ranges, last=(F.col("v"), "last")).count() == 0 and order.numbered(df.limit(0), "at").count() == 0


def reader(blob):
    """Frames and bad bytes as a reader finds them, byte by byte."""
    starts = dict(incremental._candidates(blob, len(blob))) if blob else {}
    at, bad, out = 0, 0, []
    while at < len(blob):
        if at in starts:
            out.append((at, starts[at], bad))
            at, bad = at + len(starts[at]), 0
        else:
            at, bad = at + 1, bad + 1
    return out


def test_frames_of_a_capture_cut_anywhere(spark):
    rng = random.Random(8)
    inner = frame(0, BEAT, 50)
    nested = frame(33, b"\x00\x01" + inner + b"\x02" * 5, 104)  # a valid frame inside a valid frame
    made = [frame(33, POSITION, 104), frame(0, BEAT, 50, 1), frame(0, BEAT, 50, 2, True), nested, nested[3:], b"\xfd", b"\xfe\xff", b"zz", frame(0, BEAT, 51), frame(9999, b"abc", 0)[:-2] + b"xx"]
    blob = b"".join(rng.choice(made) for _ in range(400)) + b"\xfd\xff\x00"
    want = reader(blob)
    assert len(want) > 100 and any(f == inner for _, f, _ in want)
    scanned = lambda rows, shape, chunk: sorted((r.offset, bytes(r.frame), r.n_bad) for r in incremental.frame_scan(spark.createDataFrame(rows, shape), chunk).collect())
    assert scanned([("a", blob)], "path string, content binary", 1 << 20) == want
    assert scanned([("a", blob)], "path string, content binary", 700) == want
    cuts = sorted(rng.sample(range(1, len(blob)), 60))
    parts = [("a", i, blob[a:b]) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(blob)]))] + [("b", 0, b""), ("c", 0, None), ("d", 0, inner)]
    rng.shuffle(parts)
    found = incremental.frame_scan(spark.createDataFrame(parts, "path string, part int, content binary"), 1000).collect()
    assert sorted((r.offset, bytes(r.frame), r.n_bad) for r in found if r.path == "a") == want
    assert [(r.path, r.offset) for r in found if r.path != "a"] == [("d", 0)]


@pytest.mark.parametrize("stop", [True, False])
def test_runs_stop_before_births(spark, stop):
    inputs = lambda rows: spark.createDataFrame(rows, "position long, name string, raw_ref string, error string")
    seen = lambda rows: spark.createDataFrame(rows, "position long, sub int, subject string")
    one = runs.Feed("one", inputs([(5, "e", "r5", None), (2, "b", "r2", None)]), seen([(2, 0, "s"), (5, 0, "s")]), 1)
    two = runs.Feed("two", inputs([(1, "a", "r1", None), (3, "c", "r3", "bad"), (4, "d", "r4", None)]), seen([(1, 0, "t"), (1, 1, "t"), (4, 0, "u")]))
    three = runs.Feed("three", inputs([(1, "z", "r9", "worse")]), seen([]))
    report = runs.replay_run([one, two, three], stop=stop)
    got = [(r.step, r.feed, r.position, r.mutations, r.error) for r in report.orderBy("step").collect()]
    want = [(1, "one", 2, 2, None), (2, "one", 5, 1, None), (3, "two", 1, 2, None), (4, "two", 3, 0, "bad")]
    assert got == (want if stop else [*want, (5, "two", 4, 1, None), (6, "three", 1, 0, "worse")])
    total = runs.run_report(report, ["one", "two"]).first()
    assert (total.n_one, total.n_two, total.mutations, total.failed, total.last_error, total.state) == ((2, 2, 5, 1, "bad", "failed") if stop else (2, 3, 6, 2, "worse", "failed"))
    assert runs.run_report(report.limit(0), ["one"]).first().state == "idle"
    known = spark.createDataFrame([("s",)], "subject string")
    assert runs.replay_run([one], known).agg(F.sum("mutations")).first()[0] == 2


def km(a, b):
    (lon, lat), (lon2, lat2) = (map(math.radians, p) for p in (a, b))
    h = math.sin((lat2 - lat) / 2) ** 2 + math.cos(lat) * math.cos(lat2) * math.sin((lon2 - lon) / 2) ** 2
    return 2 * spatial.RADIUS_KM * math.asin(min(1, math.sqrt(h)))


def test_nearest_of_many_dense_and_far(spark):
    rng = random.Random(3)
    tracks = [(f"t{i:04}", 10 + rng.random() / 100, 50 + rng.random() / 100) for i in range(700)] + [(f"same{i}", 10.0, 50.0) for i in range(90)]
    tracks += [(f"far{i}", rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(25)] + [("line", 179.999, 1.0), ("pole", 30.0, 89.999), ("none", None, 1.0)]
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(60)] + [(100, -179.999, 1.0), (101, -150.0, 89.999), (102, 10.0, 50.0), (103, -170.0, -50.0), (104, None, 0.0)]
    got = {}
    for r in spatial.nearest_of_many(spark.createDataFrame(points, "id int, lon double, lat double"), spark.createDataFrame(tracks, "subject string, lon double, lat double"), 5, leaf=8).collect():
        got.setdefault(r.id, []).append((r["rank"], r.subject, r.km))
    assert set(got) == {p[0] for p in points if p[1] is not None}
    for i, lon, lat in points:
        if lon is not None:
            want = sorted((km((lon, lat), t[1:]), t[0]) for t in tracks if t[1] is not None)[:5]
            assert [x[1] for x in sorted(got[i])] == [s for _, s in want] and all(abs(a[2] - b[0]) < 1e-6 for a, b in zip(sorted(got[i]), want))
    few = spatial.nearest_of_many(spark.createDataFrame([(1, 0.0, 0.0)], "id int, lon double, lat double"), spark.createDataFrame(tracks[:2], "subject string, lon double, lat double"), 5)
    assert few.count() == 2
    assert spatial.nearest_of_many(spark.createDataFrame([(1, 0.0, 0.0)], "id int, lon double, lat double"), spark.createDataFrame([], "subject string, lon double, lat double"), 5).count() == 0


def test_moving_together(spark):
    rng = random.Random(6)
    path = [(rng.uniform(-180, 180), rng.uniform(-80, 80)) for _ in range(12)]
    left = [(f"v{j}", 100 * i, (lon + j * 5 + 180) % 360 - 180, lat) for j in range(4) for i, (lon, lat) in enumerate(path)] + [("edge", 50, 180.0, 0.0), ("edge", 500, -180.0, 0.0), ("nil", 1, None, None)]
    right = [(f"c{j}", 100 * i + 7, (lon + j * 5 + 180.01) % 360 - 180, lat) for j in range(3) for i, (lon, lat) in enumerate(path)] + [("over", 52, -179.99, 0.0), ("over", 490, 179.99, 0.0), ("once", 100, path[1][0], path[1][1])]
    shape = "subject string, s int, lon double, lat double"
    sides = [spark.createDataFrame(rows, shape).withColumn("at", F.timestamp_seconds("s")).repartition(3) for rows in (left, right)]
    got = {(r.subject, r.object): r.met for r in spatial.moving_together(*sides, km=1.3, seconds=20).collect()}
    want = {}
    for a in left:
        for b in right:
            if a[2] is not None and abs(a[1] - b[1]) <= 20 and km(a[2:], b[2:]) <= 1.3:
                want.setdefault((a[0], b[0]), set()).add(a[1] // 20)
    slots = {a[0]: len({x[1] // 20 for x in left if x[0] == a[0]}) for a in left}
    assert got == {p: len(s) for p, s in want.items() if len(s) >= 2 and len(s) >= slots[p[0]] / 2}
    assert ("edge", "over") in got and ("v0", "c0") in got and ("v1", "once") not in got


def test_snapshot_is_ordered_whole_and_valid(spark):
    now = F.lit("2024-01-31T00:00:00.25Z").cast("timestamp")
    rng = random.Random(1)
    tracks = [(f"o.p.cop.mavlink.track.{i}", f'UAS "{i}"', "mavlink", "active", i / 7, 1.0, "", 0.9, "r") for i in range(300)] + [("o.p.cop.tak.track.same", x, "tak-cot", "stale", 1.0, 2.0, "v", 1.0, None) for x in ("b", "a", "a")]
    rng.shuffle(tracks)
    view = spark.createDataFrame(tracks, "subject string, label string, source string, status string, lon double, lat double, velocity string, confidence double, source_ref string").withColumn("updated_at", now).repartition(7)
    feeds = views.feed_health(spark, view.select(F.lit("feed.mavlink").alias("feed"), "updated_at").limit(1), now, F.expr("interval 2 minutes"))
    text = snapshot.document({"tracks": view, "feeds": feeds, "tasks": view.limit(0).withColumns({"kind": F.lit(""), "description": F.lit("")})}, now).first().snapshot
    got = json.loads(text)
    assert list(got) == ["generated_at", "scenario", "summary", "diagnostics", "feeds", "assets", "tracks", "tasks", "advisories", "hazards", "alerts"]
    assert got["generated_at"] == "2024-01-31T00:00:00.25Z" and got["summary"] == {"active_tracks": 303, "active_tasks": 0, "active_advisories": 0, "active_alerts": 0, "stale_feeds": 1}
    assert [t["id"] for t in got["tracks"]] == sorted(t[0] for t in tracks) and [t["label"] for t in got["tracks"][-3:]] == ["a", "a", "b"]
    assert [(f["id"], f["status"]) for f in got["feeds"]] == [("feed.mavlink", "live"), ("feed.tak", "stale"), ("feed.cap", "planned"), ("feed.adsb", "planned")]
    assert got["tracks"][-1]["provenance"] == {"owner": "feed.tak", "source_ref": "", "observed_at": "2024-01-31T00:00:00.25Z"} and got["tasks"] == [] and "error" not in text
    assert [r.subject for r in views.ordered(view).collect()] == sorted(t[0] for t in tracks)
    empty = json.loads(snapshot.document({"tracks": view.limit(0)}, now).first().snapshot)
    assert empty["tracks"] == [] and empty["summary"]["active_tracks"] == 0
