"""Registered queries against their SQL on small made tables, and how they get their work done."""

from datetime import datetime, timedelta
from decimal import Decimal

import __spark_entry__ as entry
import duckdb
from pyspark.sql import functions as F

from skyquilt.plans import lenses
from skyquilt.streaming import incremental

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events_in(spark, folder, rows):
    """A folder with a table of events (event_id, user_id, event_type, k)."""
    made = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), user, kind, 1.0, f'{{"k": {k}}}') for i, user, kind, k in rows]
    spark.createDataFrame(made, EVENTS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def both(spark, name, sf_dir, tables):
    """Sorted rows of a query and of its SQL."""
    got = entry.queries()[name](spark, sf_dir)
    with duckdb.connect() as con:
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted(str(tuple(float(v) if isinstance(v, Decimal) else v for v in r)) for r in rows)
    return plain(got.collect()), plain(want)


def test_broken_frames_of_captures_begin_no_other_frame(spark, tmp_path):
    """The checksum of the first, noise and the head of the second would be a valid frame of an unknown message."""
    sf_dir = events_in(spark, tmp_path / "t", [(18, 38, "error", 39), (74, 0, "view", 5), (75, 2, "click", 5), (90, 1, "purchase", 7), (254, 3, "error", 1), (509, 3, "error", 0), (510, 3, "signup", 0)])
    noisy = {r.event_id: bytes(r.frame) for r in lenses.frames(spark, sf_dir).collect()}
    scanned = incremental.frame_scan(spark.createDataFrame([("a", noisy[18] + b"\x11\x22" + noisy[74])], "path string, content binary")).collect()
    assert [(r.offset, len(r.frame)) for r in scanned] == [(19, 9)]  # what a reader of any such stream takes
    quiet = lenses.frames(spark, sf_dir, quiet=True)
    assert all(not set(r.frame[1:]) & {0xFD, 0xFE} for r in quiet.filter("event_type = 'error'").collect())
    same = {r.event_id: bytes(r.frame) for r in quiet.filter("event_type <> 'error'").collect()}
    assert same == {i: f for i, f in noisy.items() if i in same}
    got, want = both(spark, "d21_frame_scan", sf_dir, ["events"])
    assert got == want and len(got) == 4


def test_quiet_frames_stay_broken(spark):
    """Every pair of checksum bytes becomes another one without a start byte."""
    ends = [(a, b) for a in (0, 1, 0x7C, 0x7D, 0x7E, 0x7F, 0xFC, 0xFD, 0xFE, 0xFF) for b in (0, 0x7D, 0x7E, 0xFC, 0xFD, 0xFE, 0xFF)]
    made = spark.createDataFrame([(bytes([1, 2, a, b]),) for a, b in ends], "frame binary").select(lenses.without_start(F.col("frame")).alias("f"))
    for (a, b), r in zip(ends, made.collect()):
        assert bytes(r.f[:2]) == b"\x01\x02" and bytes(r.f[2:]) != bytes([a, b]) and not set(r.f[2:]) & {0xFD, 0xFE}


def test_deep_classes_are_walked_through_once(spark, monkeypatch):
    """One look for deep messages, whatever their depth, and the same rows and errors as by expressions."""
    from skyquilt.operators import sapient

    node, ulid = "00000000-0000-4000-8000-00000000000a", "0" * 25 + "Z"
    message = lambda classes: f'{{"timestamp":"2024-01-01T00:00:00Z","nodeId":"{node}","detectionReport":{{"reportId":"{ulid}","objectId":"{ulid}","rangeBearing":{{"coordinateSystem":"A","datum":"B"}},"classification":{classes}}}}}'
    chain = lambda n, last='"level":1': '[{"type":"t","level":0,"subClass":' * n + '[{"type":"e",%s}]' % last + "}]" * n
    odd = ["[]", "null", "7", "{}", "[1]", "[null]", '["a"]', '[{"type":" "}]', '[{"type":3}]', '[{"type":" a ","confidence":"0.5"}]', '[{"type":"a","confidence":"x"}]', '[{"type":"a","confidence":true}]', '[{"type":"a","confidence":null}]', '[{"type":"a","confidence":1e-1}]',
           '[{"type":"a","confidence":[1]}]', '[{"type":"a","level":"9"}]', '[{"type":"a","level":1.5}]', '[{"type":"a","subClass":null}]', '[{"type":"a","subClass":{}}]', '[{"type":"a","subClass":[]}]', '[{"type":"a","subClass":[{"type":"b"}]}]', '[{"type":"a","subClass":[{"type":"b","level":"1.0"}]}]',
           '[{"type":"a","subClass":[{"type":"b","level":1.5}]}]', '[{"type":"a","subClass":[{"type":"b","level":true}]}]', '[{"type":"a","subClass":[{"type":"b","level":" 2 "},{"type":"c","level":-3,"subClass":[{"type":"d","level":12345678901}]}]},{"type":"z"}]',
           '[{"type":"a","subClass":[{"type":"b","level":"NaN"}]}]', chain(4), chain(4, '"level":"x"'), chain(3, '"level":1,"subClass":3')]
    shape = "n int, raw_payload string"
    shown = lambda d: sorted((r.n, r.error, r.detection and [tuple(c) for c in r.detection.classes]) for r in d.collect())
    plain = spark.createDataFrame(list(enumerate(map(message, odd))), shape)
    want = shown(sapient.decode(plain))
    assert sum(e is None for _, e, _ in want) >= 9 and sum(e == "bad class" for _, e, _ in want) >= 15
    deep = spark.createDataFrame([(100, message(chain(60))), (101, message(chain(60, '"level":0.5'))), (102, None)], shape)
    spark.sparkContext.setJobGroup("deep", "")
    decoded = sapient.decode(plain.unionByName(deep))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("deep")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = shown(decoded)
    assert got[:-3] == want and [g[1] for g in got[-3:]] == [None, "bad class", "malformed"] and len(jobs) <= 3
    assert got[-3][2] == [("0" + ".0" * i, "t" if i < 60 else "e", None, int(i == 60)) for i in range(61)]


def test_one_row_group_is_dealt_out(spark, tmp_path):
    """What is made of each row costs more than the row, so the file does not set the number of tasks."""
    rows = [(k, k % 7, 20 * k + 1, k + 2) for k in range(200)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/t/lineitem.parquet")
    busy = lenses.nested_messages(spark, f"{tmp_path}/t").select(F.spark_partition_id().alias("p")).distinct().count()
    assert busy == 4
    got, want = both(spark, "d14_nested_classes", f"{tmp_path}/t", ["lineitem"])
    assert got == want and len(got) > 1000


def small_tables(spark, folder, n=60):
    sf_dir = events_in(spark, folder, [(k, 5 * k % 37, ("view", "click", "purchase", "signup", "error")[k % 5], k * 7 % 30) for k in range(n)])
    rows = [(k, k % 9, "FOP"[k % 3], datetime(1995, 1 + k % 12, 3), "1-URGENT") for k in range(n)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return sf_dir


def test_births_do_not_decode_again(spark, tmp_path):
    """What is read twice for births has been decoded and stored before: the plan of the result neither parses XML nor reads frames."""
    sf_dir = small_tables(spark, tmp_path / "t")
    planned = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower()
    plan = planned(entry.queries()["p21_all_mutations"](spark, sf_dir))
    assert "from_xml" not in plan and "fromxml" not in plan and "xmltostructs" not in plan and "mapinarrow" not in plan
    got, want = both(spark, "p21_all_mutations", sf_dir, ["events", "orders"])
    assert got == want and len(got) > 100


def test_states_do_not_carry_their_snapshot(spark):
    """The bytes that decoding stores grow with the states of a snapshot, not with their square."""
    from skyquilt.operators import adsb

    state = '["a1b2c3","Call","Land",null,1704067200,-77.25,10.5,null,false,5.125,180.5,null,null,null,null,false,1]'
    made = lambda n: spark.createDataFrame([(1, '{"time":1704067200,"states":[%s]}' % ",".join([state] * n)), (2, '{"time":1704067200,"states":[%s,[]]}' % state)], "slot int, raw_json string")
    decoded = adsb.decode(made(300), "slot")
    assert "raw_json" not in decoded.columns and "parse_json" not in decoded._jdf.queryExecution().optimizedPlan().toString().lower()
    rows = decoded.collect()
    assert sorted((r.slot, r.state_no) for r in rows if r.error is None) == [(1, i) for i in range(300)]
    assert [(r.slot, r.state_no, r.error, r.icao24) for r in rows if r.error] == [(2, None, "bad state", None)]


def test_triples_of_births_are_made_of_stored_sightings(spark, tmp_path):
    from skyquilt.plans import catalog

    sf_dir = small_tables(spark, tmp_path / "t")
    for triples in (catalog.vehicle_triples(spark, sf_dir), catalog.operator_triples(spark, sf_dir)):
        plan = triples._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "mapinarrow" not in plan and "from_xml" not in plan and "xmltostructs" not in plan and triples.count() > 50
    got, want = both(spark, "t1_all_feeds", sf_dir, ["events", "orders"])
    assert got == want and len(got) > 20


def test_evidence_is_read_once(spark, tmp_path):
    """One JSON reader for all parts of the documents; warnings are dealt out to the two parts of v5 before they are decoded."""
    sf_dir = small_tables(spark, tmp_path / "t")
    plan = lambda name: entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower()
    read = plan("p15_evidence_triples")
    assert read.count("from_json") + read.count("jsontostructs") == 1
    lines = plan("v5_hazards_of_evidence").splitlines()
    xml = [i for i, x in enumerate(lines) if "from_xml" in x or "xmltostructs" in x]
    halves = [i for i, x in enumerate(lines) if x.strip(" :+-").startswith("filter") and " % 2" in x]
    assert len(xml) == len(halves) == 2 and xml[0] < halves[0] < xml[1] < halves[1]
    got, want = both(spark, "p15_evidence_triples", sf_dir, ["orders"])
    assert got == want and len(got) == 7 * 60
