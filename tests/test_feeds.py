"""Operators of the operating picture on small cases."""

import struct

import pytest
from pyspark.sql import functions as F

from skyquilt.functions import text as tx
from skyquilt.operators import adsb, cap, contracts, cot, lane, mavlink, state, views
from skyquilt.sources import replay
from skyquilt.streaming import incremental


def crc(data, extra):
    acc = 0xFFFF
    for b in data + bytes([extra]):
        t = (b ^ acc) & 0xFF
        t = (t ^ (t << 4)) & 0xFF
        acc = (acc >> 8) ^ (t << 8) ^ (t << 3) ^ (t >> 4)
    return struct.pack("<H", acc & 0xFFFF)


def frame(number, payload, extra, version=2, signed=False):
    if version == 1:
        body = bytes([len(payload), 3, 42, 7, number]) + payload
        return b"\xfe" + body + crc(body, extra)
    body = bytes([len(payload), int(signed), 0, 3, 42, 7]) + number.to_bytes(3, "little") + payload
    return b"\xfd" + body + crc(body, extra) + (b"s" * 13 if signed else b"")


POSITION = struct.pack("<IiiiihhhH", 1, 389000001, -770000002, 5, 6, 321, -12, 7, 0)
BEAT = struct.pack("<IBBBBB", 0, 2, 3, 128, 4, 3)


def test_frames(spark):
    rows = [(1, frame(33, POSITION, 104)), (2, frame(0, BEAT, 50, 1)), (3, frame(0, BEAT, 50, 2, True)), (4, frame(0, BEAT, 51)), (5, b""), (6, None), (7, frame(0, BEAT, 50) + b"x"), (8, frame(30, struct.pack("<I2f", 1, -1.5, 0.1), 39)), (9, b"hello world")]
    raw = spark.createDataFrame(rows, "n int, frame binary").withColumn("received_at", F.lit("2026-01-01T00:00:00Z").cast("timestamp")).withColumn("ref", F.lit("r")).withColumn("batch", F.lit(0)).withColumn("arrival", F.col("n"))
    decoded = mavlink.decode(raw)
    got = {r.n: r for r in decoded.collect()}
    assert [got[i].error for i in range(1, 10)] == [None, None, None, "bad checksum", "empty frame", "empty frame", "wrong length", None, "no start byte"]
    assert got[1].system_id == 42 and got[1].global_position_int.lat == 389000001 and got[1].global_position_int.vy == -12
    assert got[8].attitude.roll == -1.5 and got[8].attitude.pitch == struct.unpack("<f", struct.pack("<f", 0.1))[0] and got[8].attitude.yaw is None
    triples = {(r.arrival, r.predicate): r.object for r in mavlink.project(decoded, "o", "p", 0.9, ["batch", "arrival"]).collect()}
    assert triples[1, "cop.track.position"] == "POINT(-77.0000002 38.9000001)" and triples[1, "cop.track.velocity"] == "NED_CMPS(321 -12 7)"
    assert triples[2, "cop.track.status"] == "active.armed" and triples[8, "cop.track.roll"] == "-1.5"
    blob = b"zz" + rows[0][1] + b"\xfd\x01" + rows[1][1] + rows[3][1]
    found = incremental.frame_scan(spark.createDataFrame([("a", blob)], "path string, content binary")).collect()
    assert [bytes(r.frame) for r in found] == [rows[0][1], rows[1][1]] and [r.n_bad for r in found] == [2, 2]


EVENT = '<event uid="{uid}" type="{type}" how="m" time="{time}" start="2026-01-01T00:00:00Z" stale="2026-01-01T00:05:00Z"><point lat="{lat}" lon="-77.0350" hae="0" ce="1" le="1"/><detail><contact callsign="ALPHA"/>{more}</detail></event>'


@pytest.mark.parametrize(
    "values, error, route",
    [
        ({}, None, "track"),
        ({"type": "u-d-p"}, None, "task"),
        ({"type": "b-t-f", "more": "<remarks> hold </remarks>"}, None, "advisory"),
        ({"type": "b-a-o"}, None, None),
        ({"uid": " "}, "no uid", "track"),
        ({"type": ""}, "no type", None),
        ({"time": "soon"}, "bad time", "track"),
        ({"lat": "north"}, "bad number", "track"),
    ],
)
def test_events(spark, values, error, route):
    xml = EVENT.format(**{"uid": "A", "type": "a-f-G-U-C", "time": "2026-01-01T00:00:01.5Z", "lat": "38.8920", "more": ""} | values)
    raw = spark.createDataFrame([(xml,)], "raw_xml string").withColumn("received_at", F.current_timestamp())
    row = cot.route(cot.decode(raw)).first()
    assert row.error == error and row.route == route
    if route == "advisory":
        assert row.chat_text == "hold"


def test_snapshots_are_all_or_nothing(spark):
    good = '["a1b2c3"," N123AB ","US",null,1700000000,-77.0,38.9,null,false,71.5,180.25,-1.2,null,null,null,false,0]'
    texts = [f'{{"time":1,"states":[{good},{good.replace("a1b2c3", "d4")}]}}', f'{{"time":1,"states":[{good},{good.replace("false,0", "false")}]}}', f'{{"time":1,"states":[{good.replace("-77.0", chr(34) + "-77.0" + chr(34))}]}}', '{"states":[]}', '{"time":1}', "x", '{"time":1,"states":[]}']
    raw = spark.createDataFrame(list(enumerate(texts)), "key int, raw_json string").withColumn("ref", F.lit(""))
    rows = adsb.decode(raw, "key").collect()
    assert sorted(r.icao24 for r in rows if r.error is None) == ["a1b2c3", "d4"]
    assert {r.key: r.error for r in rows if r.error} == {1: "bad state", 2: "bad state", 3: "no time", 4: "no states", 5: "malformed"}
    triples = {r.predicate: r.object for r in adsb.project(adsb.decode(raw, "key"), "o", "p", 0.85, ["key"]).filter("subject like '%a1b2c3'").collect()}
    assert triples["cop.track.native_id"] == "adsb.icao24.a1b2c3.callsign.n123ab.source.ads-b"
    assert triples["cop.track.velocity"] == "AIR_MOTION_MPS(71.50 180.25 -1.20)"


ALERT = "<alert><identifier>I</identifier><sender>s</sender><sent>2026-01-01T00:00:00Z</sent><status>Actual</status><msgType>Alert</msgType><scope>Public</scope><info><event>Fire</event><certainty>Observed</certainty><area><areaDesc>North</areaDesc>{}</area></info></alert>"


def test_warnings(spark):
    shapes = ["<polygon>38.895,-77.012 38.907,-77.011 38.908,-76.992</polygon>", "<polygon>1,2 3,4</polygon>", "<circle>38.9,-77.01 7.5</circle>", "<circle>38.9,-77.01 far</circle>"]
    texts = [ALERT.format(s) for s in shapes] + [ALERT.format("").replace("<identifier>I</identifier>", ""), "<alert", "<other/>"]
    raw = spark.createDataFrame(list(enumerate(texts)), "n int, raw_xml string")
    got = {r.n: r for r in cap.decode(raw).withColumn("shape", cap.hazard_geometry(F.filter("polygons", lambda p: p.isNotNull()), F.col("circles"))).collect()}
    assert [got[i].error for i in range(7)] == [None, "bad shape", None, "bad shape", "missing header", "malformed", "malformed"]
    assert len(got[0].shape) == 3 and len(got[2].shape) == 24 and abs(got[2].shape[6].lat - (38.9 + 7.5 / 111.32)) < 1e-9


def test_scalars(spark):
    df = spark.createDataFrame([(" Ab-C#d ", "stale", "active.armed")], "a string, b string, c string")
    now, old, window = F.lit("2026-01-01T01:00:00Z").cast("timestamp"), F.lit("2026-01-01T00:00:00Z").cast("timestamp"), F.expr("interval 2 minutes")
    row = df.select(tx.entity_token(F.col("a")), tx.entity_token(F.lit("##")), tx.freshness_status(F.col("b"), now, old, window), tx.freshness_status(F.col("c"), now, old, window), tx.age_label(now, old), tx.age_label(old, now), tx.wkt_lat(F.lit("POINT(1 x)"))).first()
    assert tuple(row) == ("ab-c-d", "unknown", "stale", "stale.armed", "1h", "0s", None)


def test_lane_keeps_the_longest_suffix(spark):
    sizes = [5, 1, 9, 2, 2, 7, 1]
    rows = [("S rc", i, b"x" * n) for i, n in enumerate(sizes)] + [("S rc", 99, b"")]
    refs = lane.assign_refs(spark.createDataFrame(rows, "source string, at int, payload binary"), "cot", F.col("payload"), ["at"])
    assert {r.ref for r in refs.collect()} == {f"cot://raw/s-rc/{i + 1:08d}" for i in range(7)}
    for most, room in ((3, 100), (10, 10), (10, 8), (1, 1)):
        held = []
        for i, n in enumerate(sizes):
            held.append(i)
            while len(held) > most or sum(sizes[j] for j in held) > room:
                held.pop(0)
        kept = lane.retain(refs, F.octet_length("payload"), ["number"], most, room)
        assert sorted(r.at for r in kept.collect()) == held


def test_births_state_and_governance(spark):
    rows = [("o.p.cop.mavlink.track.a", 0, 1), ("o.p.cop.mavlink.track.a", 0, 2), ("o.p.cop.mavlink.track.b", 0, 3)]
    seen = spark.createDataFrame(rows, "subject string, batch int, arrival int")
    assert sorted(r.kind for r in state.plan_births(seen).collect()) == ["create", "create", "update"]
    assert sorted(r.kind for r in state.plan_births(seen, seen.filter("arrival = 1")).collect()) == ["create", "update", "update"]
    triples = spark.createDataFrame([(s, "cop.track.battery_remaining", str(n), "long", "mavlink", 0.9, b, n, 0) for s, b, n in rows] + [("o.p.cop.tak.track.x", "cop.track.roll", "1", "double", "tak", 0.9, 0, 4, 0), ("o.p.cop.mavlink.track.a", "cop.track.source", "o.p.cop.mavlink.asset.a", "entity", "mavlink", 0.9, 0, 5, 1)], "subject string, predicate string, object string, object_type string, source string, confidence double, batch int, arrival int, idx int").withColumn("timestamp", F.timestamp_seconds("arrival"))
    now = {(r.subject, r.predicate): r.object for r in state.current_state(triples).collect()}
    assert now["o.p.cop.mavlink.track.a", "cop.track.battery_remaining"] == "2"
    rules = contracts.contracts(spark)
    assert tuple(contracts.violation_counters(triples, triples, rules).first()) == (1, 0, 0, 1)
    assert contracts.find_overlaps(rules).count() == 0
    assert contracts.find_overlaps(rules.unionByName(rules.filter("contract = 'tak-task'").withColumn("contract", F.lit("zz")))).count() == 10


def test_stream_equals_batch(spark, tmp_path):
    triples = spark.createDataFrame([(f"s{i % 5}", f"p{i % 3}", str(i), 0, i, 0) for i in range(60)], "subject string, predicate string, object string, batch int, arrival int, idx int").withColumn("timestamp", F.timestamp_seconds("arrival"))
    triples.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(triples.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = incremental.streaming_state(stream).writeStream.outputMode("complete").format("memory").queryName("state_now").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = incremental.streaming_state(triples)
    assert sorted(map(tuple, spark.table("state_now").collect())) == sorted(map(tuple, batch.collect()))


def test_replay_round_trip(spark, tmp_path):
    path = str(tmp_path / "replay")
    assert replay.scan_replay(spark, "cot", path).count() == 0
    rows = spark.createDataFrame([("r1", "s", bytearray(b"<event/>"))], "Ref string, Source string, RawXML binary")
    replay.append_replay(rows, "cot", path)
    replay.append_replay(rows, "cot", path)
    assert [bytes(r.RawXML) for r in replay.scan_replay(spark, "cot", path).collect()] == [b"<event/>"] * 2
    with pytest.raises(Exception, match="without ref or payload"):
        replay.append_replay(rows.withColumn("Ref", F.lit("")), "cot", path)


def test_prefix_scan_and_bounds(spark):
    ids = spark.createDataFrame([(f"o.p.cop.tak.track.{i}",) for i in range(7)] + [("o.p.cop.tak.tracker.1",)], "subject string")
    found = views.prefix_scan(ids, "o.p.cop.tak.track", 5).collect()
    assert len(found) == 5 and all(r.truncated for r in found)
    assert not views.prefix_scan(ids, "o.p.cop.tak.track", 7).first().truncated


def test_sensor_messages(spark):
    from skyquilt.operators import sapient

    node, ulid = "00000000-0000-4000-8000-00000000000a", "0" * 25 + "Z"
    head = f'{{"timestamp":"2024-01-01T00:00:00Z","nodeId":"{node}",'
    place = '"location":{"x":"1.5","y":2,"coordinateSystem":"A","datum":"B"}'
    detection = lambda more: head + f'"detectionReport":{{"reportId":"{ulid}","objectId":"{ulid}",{place}{more}}}}}'
    deep = '{"type":"t","level":1}'
    for _ in range(sapient.DEPTH):
        deep = '{"type":"t","level":1,"subClass":[%s]}' % deep
    cases = [
        (None, "malformed"),
        ("[1]", "malformed"),
        ('{"nodeId":"x"}', "bad time"),
        (head.replace(node, "x") + '"task":{}}', "bad node id"),
        (head + '"other":1}', "no content"),
        (head + '"task":{}}', "no decoder"),
        (detection(""), None),
        (detection(',"detectionConfidence":true'), "bad confidence"),
        (detection(',"classification":null'), "bad class"),
        (detection(',"classification":[{"type":"a","subClass":[{"type":"b","level":"2"}]}]'), None),
        (detection(f',"classification":[{{"type":"a","subClass":[{deep}]}}]'), None),
        (detection(f',"associatedDetection":[{{"nodeId":"{node}","objectId":"{ulid}","associationType":"X_UNSPECIFIED"}}]'), "bad reference"),
        (detection(',"colour":7'), "bad text"),
        (detection(',"enuVelocity":{}'), None),
        (head + f'"taskAck":{{"taskId":"{ulid}","taskStatus":"OK","reason":["a"," b "]}}}}', None),
        (head + f'"taskAck":{{"taskId":"{ulid}","taskStatus":"OK","reason":[1]}}}}', "bad text"),
    ]
    raw = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "n int, raw_payload string")
    decoded = sapient.decode(raw)
    got = {r.n: r for r in decoded.collect()}
    assert [got[i].error for i in range(len(cases))] == [c[1] for c in cases]
    assert (got[6].detection.x, got[6].detection.z, got[6].detection.has_enu_velocity, got[13].detection.has_enu_velocity) == (1.5, None, False, True)
    assert got[14].task_ack.reason == ["a", "b"]
    classes = sorted((r.n, r.path, r.type, r.level) for r in sapient.classifications(decoded, ["n"]).collect())
    assert [c for c in classes if c[0] == 9] == [(9, "0", "a", None), (9, "0.0", "b", 2)]
    assert [c[1:] for c in classes if c[0] == 10] == [("0" + ".0" * i, "t" if i else "a", 1 if i else None) for i in range(sapient.DEPTH + 2)]
    assert decoded.limit(0).count() == 0 and sapient.decode(raw.limit(0)).count() == 0


def test_hazards_meet_points(spark):
    square = [(0.0, 0.0), (0.0, 2.5), (2.5, 2.5), (2.5, 0.0)]
    notch = [(-1.0, -1.0), (-1.0, -5.0), (-3.0, -3.0), (-5.0, -5.0), (-5.0, -1.0)]
    hazards = spark.createDataFrame([("sq", "a", square), ("no", "b", notch), ("line", "c", square[:2])], "subject string, label string, geometry array<struct<lat double, lon double>>")
    points = spark.createDataFrame([("in", 1.2, 2.3), ("out", 2.6, 1.0), ("in2", -1.5, -3.0), ("gap", -4.5, -3.0), ("none", None, 1.0), ("in", 1.2, 2.3)], "subject string, lon double, lat double")
    got = sorted((r.entity_id, r.hazard_id) for r in views.hazard_intersections(points, hazards).collect())
    assert got == [("in", "sq"), ("in", "sq"), ("in2", "no")]
    layer = {r.subject: r.polygon for r in views.polygon_layer(hazards).collect()}
    assert set(layer) == {"sq", "no"} and layer["sq"][1] == [2.5, 0.0]
    label = {r.subject: (r.lon, r.lat) for r in views.hazard_labels(hazards).collect()}
    assert label["sq"] == (1.25, 1.25)
    assert views.hazard_intersections(points.limit(0), hazards).count() == 0
    steps = spark.createDataFrame([("a", None), ("a", "x"), ("b", None)], "feed string, error string")
    assert sorted(tuple(r) for r in state.run_summary(steps).collect()) == [("a", 2, 1, 1, "failed"), ("b", 1, 1, 0, "succeeded")]


def test_lane_by_ranges_equals_one_window(spark):
    """A hot source, a null source, null and equal order values, an empty table: numbers run from 1 and eviction is exact."""
    rows = [("hot" if i % 3 else None if i % 2 else "cold", None if i < 2 else i // 4, i, bytearray(1 + i % 5)) for i in range(400)]
    schema = "source string, at int, tie int, payload binary"
    refs = lane.assign_refs(spark.createDataFrame(rows, schema), "cot", F.col("payload"), ["at", "tie"], ranges=7)
    want = {}
    for source, at, tie, _ in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2])):
        want[tie] = sum(1 for s, n in want.values() if s == source) + 1
        want[tie] = (source, want[tie])
    assert {r.tie: (r.source, r.number) for r in refs.collect()} == want
    for most, room in ((50, 10**6), (10**6, 90), (1, 1), (10**6, 10**6)):
        kept = {r.tie for r in lane.retain(refs, F.octet_length("payload"), ["number"], most, room, ranges=7).collect()}
        expected = set()
        for source in ("hot", "cold", None):
            n = size = 0
            for tie in sorted((t for t, v in want.items() if v[0] == source), key=lambda t: -want[t][1]):
                n, size = n + 1, size + 1 + tie % 5
                if n > most or size > room:
                    break
                expected.add(tie)
        assert kept == expected
    none = lane.assign_refs(spark.createDataFrame([], schema), "cot", F.col("payload"), ["at"])
    assert none.count() == 0 and lane.retain(none, F.octet_length("payload"), ["number"]).count() == 0


def test_headlines_association_fallback(spark):
    decoded = spark.createDataFrame([("r1", None, 7, 1, 33), ("r2", "bad checksum", 8, 1, 0)], "ref string, error string, system_id int, component_id int, message_id int")
    assert [tuple(r) for r in lane.headlines(decoded, "mavlink").orderBy("ref").collect()] == [("r1", 7, 1, 33), ("r2", None, None, None)]
    side = "subject string, stable_id string, at string"
    left = spark.createDataFrame([("a", "ab-12", "2024-01-01 00:00:00"), ("b", None, "2024-01-01 00:00:00"), ("c", "--", "2024-01-01 00:00:00"), ("x", "AB12", "2024-01-01 00:00:00")], side)
    right = spark.createDataFrame([("x", "AB 12", "2024-01-01 00:30:00"), ("y", "ab12", "2024-01-01 02:00:00"), ("z", "", "2024-01-01 00:00:00")], side)
    got = views.associate(left.withColumn("at", F.col("at").cast("timestamp")), right.withColumn("at", F.col("at").cast("timestamp")))
    assert [(r.subject, r.object, r.owner) for r in got.collect()] == [("a", "x", "fusion.structural")]
    some, none = left.select("subject"), left.select("subject").limit(0)
    stored = {"track": right.select("subject"), "task": none}
    shown = views.snapshot_fallback({"track": none, "task": none}, stored)
    assert shown["track"].count() == 3 and shown["task"].count() == 0
    shown = views.snapshot_fallback({"track": none, "task": some}, stored)
    assert shown["track"].count() == 0 and shown["task"].count() == 4
