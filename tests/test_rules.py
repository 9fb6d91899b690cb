"""Small rules: sources, lane reads, names, health, warnings in full and discovery alerts, on their edge cases."""

import json

from pyspark.sql import functions as F

from skyquilt.functions import text as tx
from skyquilt.operators import cap, contracts, health, lane, state, views
from skyquilt.sources import replay


def values(spark, column, rows, shape="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], shape).select(column).collect()]


def test_reference_segments(spark):
    given = ["A b", "  --x--  ", "Ünïx", "", None, " - ", "a.b_c-d", "\té\n", "日本1"]
    assert values(spark, tx.ref_segment(F.col("v")), given) == ["a-b", "x", "n-x", "unknown", "unknown", "unknown", "a.b_c-d", "unknown", "1"]


def test_raw_stream_marks_what_is_not_whole(spark, tmp_path):
    rows = [("s", "2024-01-01T00:00:00Z", 200, "json", "x"), (" ", "2024-01-01T00:00:00Z", 200, None, "x"), ("s", None, 200, None, "x"), ("s", "2024-01-01T00:00:00Z", 99, None, "x"), ("s", "2024-01-01T00:00:00Z", None, None, "x"), ("s", "2024-01-01T00:00:00Z", 200, "xml", "x"), ("s", "2024-01-01T00:00:00Z", 200, "json", "")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("source", "received_at", "status_code", "encoding", "payload"), r)) | {"n": i}) for i, r in enumerate(rows)))
    stream = replay.read_raw_stream(spark, str(tmp_path / "in"), "n int")
    run = stream.writeStream.format("memory").queryName("raw_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {r.n: r.valid for r in spark.table("raw_rows").collect()} == {0: True, 1: False, 2: False, 3: False, 4: True, 5: False, 6: False}


def test_event_lines_and_captured_records(spark, tmp_path):
    (tmp_path / "lines").write_text("<event/>\n\n  \n<event>" + "x" * 50 + "</event>\n")
    lines = replay.read_cot_lines(spark, str(tmp_path / "lines"), 40).collect()
    assert [(r.raw_xml[:8], r.error) for r in lines] == [("<event/>", None), ("<event>x", "oversize")]
    decoded = spark.createDataFrame([("a", None), ("b", "bad")], "ref string, error string")
    good, bad = replay.split_rejects(decoded)
    assert [r.ref for r in good.collect()] == ["a"] and [r.ref for r in bad.collect()] == ["b"]
    assert replay.captured(decoded, "cap").count() == 1 and replay.captured(decoded, "cot").count() == 2
    assert lane.lane_get(decoded, "b").first().error == "bad" and lane.lane_get(decoded, "z").count() == 0


def test_fallback_and_alerts_of_discovery(spark):
    ids = spark.createDataFrame([(f"o.p.cop.tak.track.{i}",) for i in range(4)] + [("o.p.cop.cap.hazard_area.h",), ("x.y.cop.mavlink.asset.a",)], "subject string")
    targets = views.discovery_targets(spark, [("o", "p"), ("Q R", "")])
    errors = spark.createDataFrame([("o.p.cop.adsb.track", "timeout"), ("o.p.cop.tak.task", "")], "prefix string, error string")
    d = views.discovery_diagnostics(ids, targets, 3, errors)
    assert d.count() == 16 and {r.prefix: r.n for r in d.filter("n > 0").collect()} == {"o.p.cop.tak.track": 3, "o.p.cop.cap.hazard_area": 1}
    alerts = {r.id: (r.label, r.entity_id, r.reason) for r in views.discovery_alerts(d, F.current_timestamp()).collect()}
    assert set(alerts) == {"alert.discovery.o.p.tak.track.limit", "alert.discovery.o.p.adsb.track.error"}
    assert alerts["alert.discovery.o.p.adsb.track.error"] == ("ADS-B track discovery error", "feed.adsb", "Prefix query for o.p.cop.adsb.track returned an error: timeout")
    both = views.discovery_alerts(d.withColumn("error", F.lit("e")), F.current_timestamp()).orderBy("place").filter("id like 'alert.discovery.o.p.tak.track%' or id like '%q-r.unknown.mavlink.asset%'")
    assert [r.id for r in both.collect()] == ["alert.discovery.q-r.unknown.mavlink.asset.error", "alert.discovery.o.p.tak.track.error", "alert.discovery.o.p.tak.track.limit"]
    configured = spark.createDataFrame([("mavlink", "x.y.cop.mavlink.asset.a"), ("cot", "o.p.cop.tak.track.1"), ("cap", "missing"), ("adsb", "x.y.cop.mavlink.asset.a")], "family string, subject string")
    assert [tuple(r) for r in views.family_fallback(configured, d, ids).select("family", "subject").collect()] == [("mavlink", "x.y.cop.mavlink.asset.a")]


def test_bounds_and_edges(spark):
    points = spark.createDataFrame([(10.0, 20.0), (12.0, 24.0)], "lon double, lat double")
    assert [round(x, 3) for x in views.map_bounds(points).first()] == [9.99, 19.992, 12.01, 24.008, 11.0, 22.0]
    assert [round(x, 4) for x in views.map_bounds(points.limit(0)).first()] == [-77.0202, 38.8801, -76.9802, 38.9201, -77.0002, 38.9001]
    edges = [("a", "o.p.cop.tak.asset.x"), ("b", "o.p.cop.tak.asset.y"), ("c", "o.p.cop.tak.track.z"), ("d", "o.p.other.tak.asset.w"), ("e", "o..cop.tak.asset.v"), ("f", "o.p.cop.tak.asset.x.more")]
    t = spark.createDataFrame([(s, "cop.track.source", o) for s, o in edges], "subject string, predicate string, object string")
    known = spark.createDataFrame([(o,) for _, o in edges if not o.endswith(".y")], "subject string")
    assert sorted(r.subject for r in contracts.find_dangling_edges(t, known).collect()) == ["b", "c", "d", "e", "f"]


def test_health_counters(spark):
    rows = [("a", 1, "r1", None, 2, "u1"), ("a", 2, "r2", "bad", None, "u2"), ("a", 3, "r3", None, 0, "u3"), ("a", 4, None, health.REFUSED, None, None), ("b", 1, "q1", "bad", None, None), ("b", 2, "q2", None, 1, "w")]
    df = spark.createDataFrame(rows, "feed string, n int, ref string, error string, mutations int, uid string").withColumn("at", F.timestamp_seconds("n"))
    got = {r.feed: r for r in health.adapter_health(df, "feed", "n", ["uid"]).collect()}
    a, b = got["a"], got["b"]
    assert (a.received, a.captured, a.capture_errors, a.decoded, a.parse_errors, a.mutations, a.projection_drops, a.ready, a.last_error, a.last_ref, a.last_uid) == (4, 3, 1, 2, 1, 2, 1, False, health.REFUSED, "r3", "u3")
    assert (b.ready, b.last_error, b.last_uid, b.last_write_at.second) == (True, "", "w", 2)
    flow = {r.feed: r for r in health.flow_rates(df, "feed", "at", F.lit(10), F.col("error"), F.timestamp_seconds(F.lit(5))).collect()}
    assert (flow["a"].messages_per_second, flow["a"].bytes_per_second, flow["a"].errors_per_second) == (0.5, 5.0, 0.5)
    late = health.flow_rates(df, "feed", "at", F.lit(10), F.col("error"), F.timestamp_seconds(F.lit(0))).filter("feed = 'b'").first()
    assert (late.messages_per_second, late.bytes_per_second) == (1.0, 10.0)
    polls = spark.createDataFrame([("cap", "x", 0, 200), ("cap", "x", 890, 304), ("adsb", "x", 0, 200), ("adsb", "y", 500, 304), ("other", "z", 0, 200)], "feed string, source string, s int, status_code int").withColumn("at", F.timestamp_seconds("s"))
    shown = {(r.feed, r.source): r.status for r in health.source_staleness(polls, F.timestamp_seconds(F.lit(900))).collect()}
    assert shown == {("cap", "x"): "healthy", ("adsb", "x"): "stale", ("adsb", "y"): "stale", ("other", "z"): "healthy"}


ALERT = "<alert><identifier>{id}</identifier><sender>s</sender><sent>{sent}</sent><status>Actual</status><msgType>{kind}</msgType><scope>Public</scope>{infos}</alert>"
INFO = "<info><category> Met </category><category/><event>{event}</event><effective>{at}</effective>{more}</info>"
RING = "<polygon>1,1 1,2 2,2</polygon>"


def test_warnings_in_full_and_ties_of_evidence(spark):
    area = f"<area><areaDesc>A</areaDesc>{RING}<circle>3,4 5</circle><geocode><valueName/><value/></geocode><geocode><valueName>n</valueName><value/></geocode></area>"
    two = INFO.format(event="One", at="", more=area + f"<area><areaDesc> B </areaDesc>{RING}{RING}</area><resource><uri>u</uri></resource>") + INFO.format(event="Two", at="2024-01-02T00:00:00+02:00", more="")
    make = lambda id, kind, infos, sent="2024-01-01T00:00:00Z": ALERT.format(id=id, kind=kind, infos=infos, sent=sent)
    info = lambda event, at, more=f"<area>{RING}</area>": INFO.format(event=event, at=at, more=more)
    cases = [
        make("w", "Alert", two), make("w", "Update", info("Tie", "2024-01-01T00:00:00Z")), make("w", "Alert", info("Old", "2023-01-01T00:00:00Z")), make("v", "Alert", info("None", "2024-01-01T00:00:00Z", "")),
        make("x", "Alert", two.replace("2024-01-02T00:00:00+02:00", "soon")), make("x", "Alert", two + info("Bad", "", "<area><polygon>1,1 2,2</polygon></area>")), make("x", "Alert", ""), "<alert>",
    ]
    raw = spark.createDataFrame([(i, f"r{i}", c) for i, c in enumerate(cases)], "arrival int, ref string, raw_xml string").withColumn("batch", F.lit(0))
    decoded = cap.decode(raw)
    got = {r.arrival: r for r in decoded.collect()}
    assert [got[i].error for i in range(8)] == [None, None, None, None, "bad time", "bad shape", "no info", "malformed"]
    first, second = got[0].infos
    assert first.categories == ["Met"] and [a.area_desc for a in first.areas] == ["A", "B"] and len(first.areas[1].polygons) == 2 and first.areas[0].circles[0].radius_km == 5 and [tuple(g) for g in first.areas[0].geocodes] == [("n", "")]
    assert second.event == "Two" and second.effective.hour == 22 and second.areas == [] and first.effective is None and got[4].infos is None
    t = cap.project(decoded, "o", "p", 0.5, ["batch", "arrival"])
    document = json.loads(t.filter("arrival = 0 and predicate = 'cop.hazard.evidence'").first().object)
    assert document["circles"] == [{"center": {"lat": 3.0, "lon": 4.0}, "radius_km": 5.0}] and document["effective"] == "2024-01-01T00:00:00Z" and "expires" not in document and document["resources"] == [{"description": "", "mime_type": "", "uri": "u"}]
    far = F.expr("interval 10000 days")
    hazards = {r.subject: r for r in cap.hazards_of_evidence(state.append_evidence(t, t), F.current_timestamp(), far).collect()}
    h = hazards["o.p.cop.cap.hazard_area.w"]
    assert set(hazards) == {"o.p.cop.cap.hazard_area.w"} and (h.label, h.status, h.source_ref, h.confidence, len(h.geometry)) == ("Tie", "active.update", "r1", 0.5, 3)
    assert cap.hazards_of_evidence(t.limit(0), F.current_timestamp(), far).count() == 0


def test_mutations_with_assets_and_evidence(spark):
    rules = contracts.contracts(spark)
    planned = spark.createDataFrame([(0, 2, "update", "o.p.cop.tak.track.a", "r2", "a"), (0, 1, "create", "o.p.cop.tak.track.a", "r1", "a"), (0, 3, "update", "o.p.cop.cap.hazard_area.h", "r3", "h"), (0, 4, "create", "o.p.cop.none.thing.t", "r4", "t")], "batch int, arrival int, kind string, subject string, ref string, token string")
    asset = F.when(F.col("subject").contains(".track."), F.regexp_replace("subject", "track", "asset"))
    got = [tuple(r) for r in state.mutations(planned, F.col("token"), rules, asset).orderBy("batch", "arrival", "sub").select("arrival", "sub", "kind", "request_id", "owner", "indexing_profile", "trace_id").collect()]
    assert got == [
        (1, 0, "create", "create-source-asset-a", "feed.asset", "control", "r1"), (1, 1, "create", "create-track-a", "feed.tak", "signal", "r1"), (2, 1, "update", "update-track-a", "feed.tak", "signal", "r2"),
        (3, 1, "update", "append-hazard-evidence-h", "feed.cap", "content", "r3"), (4, 1, "create", "create-thing-t", None, None, "r4"),
    ]


def test_positions_of_bad_replay_records(spark, tmp_path):
    good = json.dumps({"Ref": "r", "Source": "s", "RawXML": "PGEvPg=="})
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text("\n".join([good, json.dumps({"Ref": " ", "RawXML": "PGEvPg=="}), good, "{broken", json.dumps({"Ref": "r5"})]))
    (tmp_path / "p" / "b.json").write_text(good + "\n" + json.dumps({"RawXML": ""}))
    assert {r.position: r.error for r in replay.replay_rejects(spark, "cot", str(tmp_path / "p")).collect()} == {2: "no ref", 4: "malformed", 5: "no payload", 7: "no ref"}


def test_hazards_of_all_sizes_meet_points_once(spark):
    import random

    rng = random.Random(2)
    boxes = [(0.01, 0.01), (0.3, 0.05), (1, 1), (9, 2), (50, 20), (300, 120)]
    hazards = [(f"h{i}", "l", [(y, x), (y, x + w), (y + h, x + w), (y + h, x)]) for i, (w, h) in enumerate(boxes * 3) for x, y in [(rng.uniform(-170, 170 - w) if w < 300 else -150.0, rng.uniform(-60, 60 - h))]]
    points = [(f"p{n}", rng.uniform(-180, 180), rng.uniform(-90, 90)) for n in range(200)]
    points += [(f"q{i}", ring[0][1] + 0.5 * (ring[1][1] - ring[0][1]), ring[0][0] + 0.25 * (ring[2][0] - ring[0][0])) for i, (_, _, ring) in enumerate(hazards)]
    got = [(r.entity_id, r.hazard_id) for r in views.hazard_intersections(spark.createDataFrame(points, "subject string, lon double, lat double"), spark.createDataFrame(hazards, "subject string, label string, geometry array<struct<lat double, lon double>>")).collect()]
    want = [(p, h) for p, x, y in points for h, _, ring in hazards if ring[0][1] < x < ring[1][1] and ring[0][0] < y < ring[2][0]]
    assert sorted(got) == sorted(want) and len(want) > 50


def test_update_time_of_a_wide_entity(spark):
    rows = [("a", "p.one", "2024-01-02T00:00:00Z"), ("a", "p.two", "2024-01-05T00:00:00Z"), ("b", "p.one", "soon"), ("b", "p.two", "2024-01-05T00:00:00Z"), ("c", "p.one", "")]
    t = spark.createDataFrame([(s, p, o, "time", "x", 0.5, 0, i, 0) for i, (s, p, o) in enumerate(rows)], "subject string, predicate string, object string, object_type string, source string, confidence double, batch int, arrival int, idx int")
    held = state.current_state(t.withColumn("timestamp", F.when(F.col("subject") != "c", F.timestamp_seconds("arrival"))))
    w = state.wide(held, {"one": "p.one", "two": "p.two"}, observed=("one", "two"), now=F.timestamp_seconds(F.lit(99)))
    assert {r.subject: r.updated_at.isoformat() for r in w.collect()} == {"a": "2024-01-02T00:00:00", "b": "2024-01-05T00:00:00", "c": "1970-01-01T00:01:39"}
