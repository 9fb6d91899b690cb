"""Feed-shaped inputs derived from the given tables, one raw record per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.operators.lane import assign_refs
from skyquilt.operators.mavlink import MESSAGES, sealed
from skyquilt.operators.triples import settled

ROLLS = ("0000003f", "0000803f", "000000c0", "0000803e")  # 0.5, 1, -2 and 0.25 as singles


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    """Chosen columns of a given table, dealt out by hash to all cores: its few row groups are read by few tasks, and what is made of a row costs far more than to send it."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *rows.columns[:2])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("received_at"), "user_id", "event_type", "value", k.alias("k"))


def little(n: Column, size: int) -> Column:
    """A number as little-endian hex text."""
    h = F.lpad(F.hex(n.cast("long").bitwiseAND((1 << (8 * size)) - 1)), 2 * size, "0")
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])


def without_start(frame: Column) -> Column:
    """A whole frame with a wrong checksum, of which no byte is a start byte."""
    size = F.octet_length(frame)
    low, high = [F.conv(F.hex(F.substring(frame, size - i, F.lit(1))), 16, 10).cast("long") for i in (1, 0)]
    flipped = lambda b, by: F.when(b.bitwiseXOR(by).isin(0xFD, 0xFE), b.bitwiseXOR(by ^ 0x80)).otherwise(b.bitwiseXOR(by))
    return F.concat(F.substring(frame, F.lit(1), size - 2), F.unhex(F.concat(little(flipped(low, 1), 1), little(flipped(high, 0), 1))))


def frames(spark: SparkSession, sf_dir: str, broken: bool = True, quiet: bool = False) -> DataFrame:
    """L1: one telemetry frame per event; error events carry a broken checksum, unless ``broken`` is false.

    ``quiet``: no byte of a broken frame but its first is a start byte, so none begins another frame by chance.
    """
    df = events(spark, sf_dir)
    e, k, zero = F.col("event_id"), F.col("k"), F.lit(0)
    kind = F.col("event_type")
    byte = lambda c: F.when((kind == "error") & F.lit(quiet), c % 128).otherwise(c % 256)
    position = F.concat(little(e, 4), little((e * 7919) % 1000000000 - 500000000, 4), little((e * 104729) % 2000000000 - 1000000000, 4), little(k * 1000, 4), little(k * 10, 4), little(k * 10 - 500, 2), little(-k, 2), little(e % 100, 2), little(zero, 2))
    beat = F.concat(little(zero, 4), little(k % 4, 1), little(F.lit(3), 1), little(byte(k * 5), 1), little(k % 6, 1), little(F.lit(3), 1))
    battery = F.concat(little(k, 4), little(k, 4), little(k, 2), *[little(zero, 2)] * 10, little(-k, 2), little(zero, 1), little(zero, 1), little(zero, 1), little(k, 1))
    roll = F.element_at(F.array(*[F.lit(r.upper()) for r in ROLLS]), (k % 4 + 1).cast("int"))
    attitude = F.concat(little(e, 4), roll, F.lit(ROLLS[0].upper()), F.lit(ROLLS[2].upper()), *[F.lit(ROLLS[1].upper())] * 3)
    number = F.when(kind == "view", 33).when(kind == "purchase", 147).when(kind == "signup", 30).otherwise(0)
    payload = F.when(kind == "view", position).when(kind == "purchase", battery).when(kind == "signup", attitude).otherwise(beat)
    df = settled(df.withColumn("__number", number).withColumn("__payload", payload))
    body = F.concat(little(F.length("__payload") / 2, 1), little(zero, 1), little(zero, 1), little(byte(e), 1), little(F.col("user_id") % 150 + 1, 1), little(F.lit(1), 1), little(F.col("__number"), 3), F.col("__payload"))
    df = settled(df.withColumn("__body", body))
    extra = F.when(F.col("__number") == 33, MESSAGES[33][1]).when(F.col("__number") == 147, MESSAGES[147][1]).when(F.col("__number") == 30, MESSAGES[30][1]).otherwise(MESSAGES[0][1])
    made = settled(df.withColumn("__extra", extra).withColumn("__off", F.when((kind == "error") & F.lit(broken and not quiet), 1).otherwise(0)).withColumn("__body", F.unhex("__body")))
    made = sealed(made.drop("__number", "__payload"), "__body", "__extra", "__off", "frame").drop("__body", "__extra", "__off")
    if broken and quiet:
        made = settled(made).withColumn("frame", F.when(kind == "error", without_start(F.col("frame"))).otherwise(F.col("frame")))
    made = made.withColumn("source", F.concat(F.lit("uav-"), (F.col("user_id") % 4).cast("string")))
    return assign_refs(made, "mavlink", F.col("frame"), ["event_id"]).withColumn("batch", F.lit(0)).withColumn("arrival", F.col("event_id"))


def command_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: commands and their replies: version 2 commands, version 1 replies, every second of those cut behind its result."""
    df = events(spark, sf_dir)
    e, k = F.col("event_id"), F.col("k")
    param = F.element_at(F.array(*[F.lit(r.upper()) for r in ROLLS]), (k % 4 + 1).cast("int"))
    command = F.concat(param, *[F.lit("00000000")] * 6, little(k * 4, 2), little(e % 250, 1), little(F.lit(1), 1), little(k % 3, 1))
    reply = F.concat(little(k * 4, 2), little(k % 8, 1), F.when(e % 4 == 1, F.concat(little(k, 1), little(-k * 1000, 4), little(F.lit(9), 1), little(F.lit(8), 1))).otherwise(""))
    asked = e % 2 == 0
    payload = F.when(asked, command).otherwise(reply)
    made = settled(df.withColumn("__payload", payload))
    size = F.length("__payload") / 2
    two = F.concat(little(size, 1), F.lit("0000"), little(e, 1), F.lit("0701"), little(F.lit(76), 3), F.col("__payload"))
    one = F.concat(little(size, 1), little(e, 1), F.lit("0701"), little(F.lit(77), 1), F.col("__payload"))
    made = settled(made.withColumn("__body", F.unhex(F.when(asked, two).otherwise(one))).withColumn("__extra", F.when(asked, MESSAGES[76][1]).otherwise(MESSAGES[77][1])).withColumn("__off", F.lit(0)).drop("__payload"))
    parts = [sealed(made.filter(asked), "__body", "__extra", "__off", "frame"), sealed(made.filter(~asked), "__body", "__extra", "__off", "frame", b"\xfe")]
    return parts[0].unionByName(parts[1]).drop("__body", "__extra", "__off")


def cot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: one XML event per event."""
    df = events(spark, sf_dir)
    kind = F.col("event_type")
    cot_type = F.when(kind == "view", "a-f-G-U-C").when(kind == "click", "u-d-p").when(kind == "signup", "b-t-f").when(kind == "purchase", "a-f-A-M").otherwise("b-a-o")
    time = lambda seconds: F.date_format(F.timestamp_micros(F.unix_micros("received_at") + seconds * 1_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uid = F.concat(F.lit("U-"), F.col("user_id").cast("string"))
    stale = F.when(F.col("k") % 5 == 0, time(F.lit(-60))).otherwise(time(F.lit(300)))
    point = F.format_string('<point lat="%.3f" lon="%.3f" hae="0" ce="1" le="1"/>', (F.col("event_id") % 90) / 1.0, -(F.col("event_id") % 180) / 1.0)
    chat = F.when(kind == "signup", F.format_string('<__chat message="hold %d" senderUid="S-%d"/>', "k", "user_id")).otherwise("")
    track = F.when(kind == "purchase", F.format_string('<track course="%d.5" speed="%d.25"/>', "k", F.col("k") % 30)).otherwise("")
    bad_uid = F.when(F.col("k") == 0, "").otherwise(uid)
    xml = F.concat(F.lit('<event version="2.0" uid="'), bad_uid, F.lit('" type="'), cot_type, F.lit('" how="m-g" time="'), time(F.lit(0)), F.lit('" start="'), time(F.lit(0)), F.lit('" stale="'), stale, F.lit('">'), point, F.lit('<detail><contact callsign=" C'), F.col("k").cast("string"), F.lit('"/>'), track, chat, F.lit("<remarks> note </remarks></detail></event>"))
    made = settled(df.withColumn("raw_xml", xml)).withColumn("source", F.lit("tak main"))
    return assign_refs(made, "cot", F.col("raw_xml"), ["event_id"]).withColumn("batch", F.lit(1)).withColumn("arrival", F.col("event_id"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: events of ten minutes as one JSON snapshot of aircraft; a snapshot with an event of k = 99 has a bad row."""
    df = events(spark, sf_dir)
    slot = F.floor(F.unix_seconds("received_at") / 600)
    k, u = F.col("k"), F.col("user_id")
    null = F.lit("null")
    call = F.when(k % 3 == 0, null).otherwise(F.concat(F.lit('" Call'), u.cast("string"), F.lit(' "')))
    lat = F.when(k % 4 == 0, null).otherwise(F.format_string("%d.5", k - 50))
    ground = F.when(k == 99, '"false"').otherwise(F.when(k % 2 == 0, "true").otherwise("false"))
    state = F.concat(F.lit('["'), F.lower(F.lpad(F.hex(u), 6, "0")), F.lit('",'), call, F.lit(',"Land",'), null, F.lit(","), F.unix_seconds("received_at").cast("string"), F.lit(",-77.25,"), lat, F.lit(",null,"), ground, F.lit(","), F.when(k % 7 == 0, null).otherwise(F.format_string("%d.125", k)), F.lit(",180.5,null,null,null,null,false,"), (k % 5).cast("string"), F.lit("]"))
    grouped = df.groupBy(slot.alias("slot")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", state.alias("x")))), lambda x: x["x"]), ",").alias("rows"))
    made = grouped.select("slot", F.timestamp_seconds(F.col("slot") * 600 + 600).alias("received_at"), F.lit("sky").alias("source"), F.concat(F.lit('{"time":'), (F.col("slot") * 600).cast("string"), F.lit(',"states":['), F.col("rows"), F.lit("]}")).alias("raw_json"))
    return assign_refs(made, "adsb", F.col("raw_json"), ["slot"]).withColumn("batch", F.lit(2)).withColumn("arrival", F.col("slot"))


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: one XML warning per order."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey")
    lat, lon = (key % 80).cast("string"), (key % 170).cast("string")
    ring = F.concat_ws(" ", *[F.concat(lat, F.lit(a), F.lit(","), lon, F.lit(b)) for a, b in ((".0", ".0"), (".5", ".0"), (".5", ".5"))])
    shape = F.when(key % 3 == 0, F.concat(F.lit("<circle>"), lat, F.lit(","), lon, F.lit(" 7.5</circle>"))).when(key % 50 == 1, F.lit("<polygon>1,2 3,4</polygon>")).otherwise(F.concat(F.lit("<polygon>"), ring, F.lit("</polygon>")))
    kind = F.when(F.col("o_orderstatus") == "F", "Alert").when(F.col("o_orderstatus") == "O", "Update").otherwise("Cancel")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    xml = F.concat(
        F.lit("<alert><identifier>W-"), key.cast("string"), F.lit("</identifier><sender>desk</sender><sent>"), day, F.lit("T00:00:00Z</sent><status>"), F.when(key % 10 == 0, "Test").otherwise("Actual"), F.lit("</status><msgType>"), kind,
        F.lit("</msgType><scope>Public</scope><info><event>High Wind</event><urgency>Expected</urgency><severity>"), F.substring("o_orderpriority", 3, 20), F.lit("</severity><certainty>Likely</certainty><headline> Wind </headline><description>Strong</description><area><areaDesc>Zone "), (key % 7).cast("string"), F.lit("</areaDesc>"), shape, F.lit("</area></info></alert>"),
    )
    return settled(o.select("o_orderkey", "o_orderdate", xml.alias("raw_xml")))


def sensor_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON sensor message per line item; the line number picks the content, the keys pick faults."""
    li = table(spark, sf_dir, "lineitem", F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_partkey").cast("long").alias("l_partkey"), F.col("l_suppkey").cast("long").alias("l_suppkey"))
    o, n, p, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    ulid = lambda c: quoted(F.lpad(c.cast("string"), 26, "0"))
    node = F.format_string('"%08x-0000-4000-8000-%012x"', s, o)
    where = F.format_string('"location":{"x":"%d.5","y":%d,"coordinateSystem":"LAT_LNG","datum":"WGS84"}', p % 180, s % 90)
    both = F.when((n == 3) & (o % 5 == 0), F.concat(where, F.lit(',"rangeBearing":{"coordinateSystem":"A","datum":"B"}'))).when(n == 2, F.format_string('"rangeBearing":{"azimuth":%d,"coordinateSystem":"A","datum":"B"}', p % 360)).otherwise(where)
    sure = F.when(p % 11 == 0, F.lit("1.5")).otherwise(F.format_string("0.%02d", p % 100))
    classes = F.format_string('"classification":[{"type":"Class %d","confidence":"0.5","subClass":[{"type":"Sub","level":%s}]}]', p % 7, F.when(s % 13 == 0, F.lit('"1.5"')).otherwise("1"))
    refs = F.concat(F.lit('"derivedDetection":[{"nodeId":'), node, F.lit(',"objectId":'), ulid(s), F.lit("}]"))
    detection = F.concat(F.lit('"detectionReport":{"reportId":'), ulid(o), F.lit(',"objectId":'), ulid(p), F.lit(","), both, F.lit(',"detectionConfidence":'), sure, F.lit(","), classes, F.lit(","), refs, F.lit("}"))
    mode = '{"modeName":"m","modeType":"PERMANENT","settleTime":{"units":"S","value":1},"task":{"regionDefinition":{}}}'
    version = F.when(o % 4 == 0, "v1").otherwise("BSI Flex 335 v2.0")
    registration = F.concat(F.lit('"registration":{"icdVersion":'), quoted(version), F.format_string(',"nodeDefinition":[{"nodeType":"RADAR"}],"capabilities":[{"category":"c","type":"t%d"}],"statusDefinition":{"statusInterval":{"units":"S","value":"5"}},', p % 9), F.lit(f'"modeDefinition":[{mode}],"configData":[{{"manufacturer":"a","model":"b"}}]}}'))
    status = F.concat(F.lit('"statusReport":{"reportId":'), ulid(o), F.when(o % 4 == 0, ',"system":"SYSTEM_UNSPECIFIED"').otherwise(',"system":"SYSTEM_OK"'), F.lit(',"info":"INFO_NEW","mode":" default "}'))
    reply = F.concat(F.lit('"taskAck":{"taskId":'), ulid(p), F.lit(',"taskStatus":"DONE","reason":["r"]}'))
    body = F.when(n <= 4, detection).when(n == 5, registration).when(n == 6, status).when(o % 3 == 0, F.concat(reply, F.lit(","), status)).when(o % 3 == 1, F.lit('"alert":{}')).otherwise(reply)
    return li.withColumn("raw_payload", F.concat(F.lit('{"timestamp":"2024-01-01T00:00:00.5Z","nodeId":'), node, F.lit(","), body, F.lit("}")))


def nested_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection per line item, whose sub-classes nest l_partkey % 13 levels, two at each; the lowest level of some is no whole number."""
    li = table(spark, sf_dir, "lineitem", F.col("l_orderkey").cast("long").alias("o"), F.col("l_linenumber").cast("int").alias("n"), F.col("l_partkey").cast("long").alias("p"), F.col("l_suppkey").cast("long").alias("s"))
    depth = (F.col("p") % 13).cast("int")
    low = F.when(F.col("s") % 11 == 0, F.concat(depth.cast("string"), F.lit(".5"))).otherwise(depth.cast("string"))

    def around(inner, level):
        shown = F.when(level == depth, low).otherwise(level.cast("string"))
        below = F.when(inner == "", "").otherwise(F.concat(F.lit(',"subClass":['), inner, F.lit("]")))
        return F.concat(F.lit('{"type":"Leaf","level":0},{"type":"L'), level.cast("string"), F.lit('","level":"'), shown, F.lit('"'), below, F.lit("}"))

    levels = F.when(depth > 0, F.reverse(F.sequence(F.lit(1), depth))).otherwise(F.array().cast("array<int>"))
    inner = F.aggregate(levels, F.lit(""), around)
    below = F.when(inner == "", "").otherwise(F.concat(F.lit(',"subClass":['), inner, F.lit("]")))
    head = F.format_string('{"timestamp":"2024-01-01T00:00:00Z","nodeId":"%08x-0000-4000-8000-%012x","detectionReport":{"reportId":"%026d","objectId":"%026d","rangeBearing":{"coordinateSystem":"A","datum":"B"},"classification":[{"type":"Top"', "s", "o", "o", "p")
    return li.withColumn("raw_payload", F.concat(head, below, F.lit("}]}}")))


def warning_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: one XML warning per order with two infos, up to three areas, resources and blank parts; the orders of a customer are messages of one warning, in order of their key, with times that tie."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    month = F.date_format(F.date_trunc("quarter", "o_orderdate"), "yyyy-MM-dd")
    ring = lambda n: F.concat_ws(" ", *[F.concat(s(k % 60 + n), F.lit(a), F.lit(","), s(c % 100), F.lit(b)) for a, b in ((".0", ".0"), (".25", ".0"), (".25", ".5"), (".0", ".5"))])
    first = F.when(k % 7 == 0, "").when(k % 5 == 0, F.concat(F.lit("<circle> "), s(k % 60), F.lit(".5,"), s(c % 100), F.lit(" 12.5 </circle>"))).otherwise(F.concat(F.lit("<polygon>"), ring(0), F.lit("</polygon><polygon>"), ring(1), F.lit("</polygon>")))
    kind = F.when(F.col("o_orderstatus") == "P", "Cancel").when(k % 2 == 0, "Update").otherwise("Alert")
    xml = F.concat(
        F.lit("<alert><identifier> C-"), s(c), F.lit(" </identifier><sender>desk</sender><sent>"), month, F.lit("T00:00:00Z</sent><status>Actual</status><msgType>"), kind, F.lit("</msgType><source> hq </source><scope>Public</scope><references>r"), s(k), F.lit("</references><info><language>en-US</language><category>Met</category><category> </category><category> Geo </category><event>Flood "), s(k % 4),
        F.lit("</event><urgency>Expected</urgency><severity>"), F.when(k % 6 == 0, "").otherwise("Severe"), F.lit("</severity><certainty>"), F.when(k % 3 == 0, "Observed").otherwise("Likely"), F.lit("</certainty><effective>"), month, F.lit("T06:00:00Z</effective><expires>"), F.when(k % 11 == 0, F.concat(month, F.lit("T07:00:00Z"))).otherwise("2099-01-01T00:00:00Z"), F.lit("</expires><senderName>Desk</senderName><headline> Rise "), s(k),
        F.lit("</headline><description></description><instruction>Leave</instruction><web>http://w/"), s(k), F.lit("</web><contact>c</contact><parameter><valueName>level</valueName><value>"), s(k % 9), F.lit("</value></parameter><parameter><valueName> </valueName><value></value></parameter><resource><resourceDesc>map</resourceDesc><mimeType>image/png</mimeType><uri>u"), s(k), F.lit("</uri><digest>"), F.when(k % 2 == 0, s(k)).otherwise(""),
        F.lit("</digest></resource><area><areaDesc>Bank "), s(c % 5), F.lit("</areaDesc>"), first, F.lit("<geocode><valueName>SAME</valueName><value>0"), s(c), F.lit("</value></geocode></area>"), F.when(k % 3 == 1, F.concat(F.lit("<area><areaDesc>Far</areaDesc><circle>1,2 3</circle></area><area><areaDesc>Off</areaDesc><polygon>"), ring(2), F.lit("</polygon></area>"))).otherwise(""),
        F.lit("</info><info><event>Wind</event><urgency>U</urgency><severity>Minor</severity><certainty>Possible</certainty><resource><uri>a</uri></resource><resource><uri>b</uri></resource></info></alert>"),
    )
    made = o.select("o_orderkey", "o_custkey", F.lit(3).alias("batch"), k.cast("long").alias("arrival"), F.concat(F.lit("cap://raw/desk/"), s(k)).alias("ref"), xml.alias("raw_xml"))
    return settled(made)
