"""Drone telemetry frames: decoding, checks, statistics and projection.

Bytes are read in Arrow batches, a whole batch at a time with NumPy; everything after that is expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from skyquilt.functions.text import entity_id, wkt_point
from skyquilt.operators.triples import provenance, time_text, to_triples, to_triples_of

# Message id -> (name, extra byte of the checksum, fields as (name, type, offset)).
MESSAGES = {
    0: ("HEARTBEAT", 50, [("custom_mode", "u4", 0), ("type", "u1", 4), ("autopilot", "u1", 5), ("base_mode", "u1", 6), ("system_status", "u1", 7), ("mavlink_version", "u1", 8)]),
    30: ("ATTITUDE", 39, [("time_boot_ms", "u4", 0), ("roll", "f4", 4), ("pitch", "f4", 8), ("yaw", "f4", 12), ("rollspeed", "f4", 16), ("pitchspeed", "f4", 20), ("yawspeed", "f4", 24)]),
    33: ("GLOBAL_POSITION_INT", 104, [("time_boot_ms", "u4", 0), ("lat", "i4", 4), ("lon", "i4", 8), ("alt", "i4", 12), ("relative_alt", "i4", 16), ("vx", "i2", 20), ("vy", "i2", 22), ("vz", "i2", 24), ("hdg", "u2", 26)]),
    76: ("COMMAND_LONG", 152, [*[(f"param{i + 1}", "f4", 4 * i) for i in range(7)], ("command", "u2", 28), ("target_system", "u1", 30), ("target_component", "u1", 31), ("confirmation", "u1", 32)]),
    77: ("COMMAND_ACK", 143, [("command", "u2", 0), ("result", "u1", 2), ("progress", "u1", 3), ("result_param2", "i4", 4), ("target_system", "u1", 8), ("target_component", "u1", 9)]),
    147: ("BATTERY_STATUS", 154, [("current_consumed", "i4", 0), ("energy_consumed", "i4", 4), ("temperature", "i2", 8), *[(f"voltage{i + 1}", "u2", 10 + 2 * i) for i in range(10)], ("current_battery", "i2", 30), ("id", "u1", 32), ("battery_function", "u1", 33), ("battery_type", "u1", 34), ("battery_remaining", "i1", 35)]),
}
# Names of command results and flight modes.
RESULTS = {0: "accepted", 1: "temporarily_rejected", 2: "denied", 3: "unsupported", 4: "failed", 5: "in_progress", 6: "cancelled"}
MODES = {0: "STABILIZE", 1: "ACRO", 2: "ALT_HOLD", 3: "AUTO", 4: "GUIDED", 5: "LOITER", 6: "RTL", 7: "CIRCLE", 9: "LAND", 11: "DRIFT", 13: "SPORT", 14: "FLIP", 15: "AUTOTUNE", 16: "POSHOLD", 17: "BRAKE", 18: "THROW", 19: "AVOID_ADSB", 20: "GUIDED_NOGPS", 21: "SMART_RTL", 22: "FLOWHOLD", 23: "FOLLOW", 24: "ZIGZAG", 25: "SYSTEMID", 26: "AUTOROTATE"}


def _checksum_table() -> np.ndarray:
    """The X.25 checksum of each byte: eight steps of the reflected polynomial."""
    table = np.arange(256, dtype=np.uint16)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ 0x8408, table >> 1).astype(np.uint16)
    return table


CHECKSUMS = _checksum_table()


class Bytes:
    """A column of byte strings, read by place in all rows at once."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        self.data = self.data if len(self.data) else np.zeros(1, np.uint8)
        self.start, self.size = offsets[:-1], np.diff(offsets)

    def at(self, rows: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """The byte at a place of each of some rows; zero past the end."""
        inside = place < self.size[rows]
        return np.where(inside, self.data[np.where(inside, self.start[rows] + place, 0)], 0).astype(np.int64)

    def number(self, rows: np.ndarray, place: np.ndarray | int, size: int) -> np.ndarray:
        """A little-endian unsigned number."""
        return sum(self.at(rows, place + i) << (8 * i) for i in range(size))

    def checksum(self, rows: np.ndarray, start: int, stop: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """The X.25 checksum of bytes start to stop, then the extra byte where it is not negative."""
        acc = np.full(len(rows), 0xFFFF, np.uint16)
        for i in range(start, int(stop.max(initial=start))):
            here = i < stop
            acc[here] = CHECKSUMS[(acc[here] ^ self.at(rows[here], i)) & 0xFF] ^ (acc[here] >> 8)
        here = extra >= 0
        acc[here] = CHECKSUMS[(acc[here] ^ extra[here]) & 0xFF] ^ (acc[here] >> 8)
        return acc.astype(np.int64)


def _field(frames: Bytes, rows: np.ndarray, head: np.ndarray, kind: str, offset: int, most: int) -> pa.Array:
    """One field of the rows of a message; null past the end of the payload, and for singles that are no number."""
    size = int(kind[1])
    raw = frames.number(rows, head + offset, size)
    short = offset + size > most
    if kind[0] == "f":
        value = raw.astype(np.uint32).view(np.float32).astype(np.float64)
        return pa.array(value, mask=short | ~np.isfinite(value))
    return pa.array(np.where((kind[0] == "i") & (raw >= 1 << (8 * size - 1)), raw - (1 << (8 * size)), raw), mask=short)


def _decoded(column: pa.Array) -> list[pa.Array]:
    """The columns of DECODED for a column of frames."""
    frames, n = Bytes(column.fill_null(b"")), len(column)
    rows = np.arange(n)
    first = frames.at(rows, 0)
    one, two = first == 0xFE, first == 0xFD
    known = (one | two) & (frames.size > 0)
    head, length = np.where(one, 6, 10), frames.at(rows, 1)
    message = np.where(one, frames.at(rows, 5), frames.number(rows, 7, 3))
    signature = np.where(two & (frames.at(rows, 2) & 1 == 1), 13, 0)
    whole = known & (frames.size == head + length + 2 + signature)
    checksum = frames.number(rows, head + length, 2)
    extra = np.full(n, -1, np.int64)
    for k, (_, byte, _) in MESSAGES.items():
        extra[message == k] = byte
    good = np.zeros(n, bool)
    at = rows[whole]
    good[at] = frames.checksum(at, 1, (head + length)[at], extra[at]) == checksum[at]
    error = np.full(n, None, object)
    error[~good] = "bad checksum"
    error[~whole] = "wrong length"
    error[~known] = "no start byte"
    error[frames.size == 0] = "empty frame"
    begin = frames.start + head
    payload = [frames.data[b : b + m].tobytes().hex().upper() if w else None for b, m, w in zip(begin, length, whole)]
    reject = ~whole
    numbers = (np.where(one, 1, 2).astype(np.int32), np.where(one, frames.at(rows, 2), frames.at(rows, 4)), np.where(one, frames.at(rows, 3), frames.at(rows, 5)), np.where(one, frames.at(rows, 4), frames.at(rows, 6)), message)
    out = [pa.array(numbers[0], mask=~known), *[pa.array(v, mask=reject) for v in numbers[1:]], pa.array(payload, pa.string()), pa.array(checksum, mask=reject), pa.array(error, pa.string())]
    for k, (_, _, fields) in MESSAGES.items():
        here = np.flatnonzero(good & (message == k))
        made = [_field(frames, here, head[here], t, o, length[here]) for _, t, o in fields]
        take = np.zeros(n, np.int64)
        take[here] = np.arange(len(here))
        absent = np.ones(n, bool)
        absent[here] = False
        spread = [m.take(pa.array(take, mask=absent)) for m in made]
        out.append(pa.StructArray.from_arrays(spread, [f[0] for f in fields], mask=pa.array(absent)))
    return out


DECODED = [
    StructField("version", IntegerType()),
    *[StructField(c, LongType()) for c in ("sequence", "system_id", "component_id", "message_id")],
    StructField("payload_hex", StringType()),
    StructField("checksum", LongType()),
    StructField("error", StringType()),
    *[StructField(name.lower(), StructType([StructField(f, DoubleType() if t[0] == "f" else LongType()) for f, t, _ in fields])) for name, _, fields in MESSAGES.values()],
]


def decode(raw: DataFrame, frame: str = "frame") -> DataFrame:
    """The input with version, sequence, ids, payload_hex, checksum, decoded (a field struct by message) and error.

    One datagram is one frame; anything else is a reject, whose numbers are null. A field past the end of the payload
    is null. An Arrow batch is decoded at once, and only the fields of messages that it holds are read.
    """
    place = raw.columns.index(frame)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_decoded(batch.column(place))], [*batch.schema.names, *[f.name for f in DECODED]])

    return raw.mapInArrow(decoded, StructType([*raw.schema.fields, *DECODED]))


def sealed(bodies: DataFrame, body: str, extra: str, off: str, frame: str, start: bytes = b"\xfd") -> DataFrame:
    """Adds ``frame``: version 2 frames (1 with a ``start`` of fe) of bodies without start and checksum. off is added to the checksum: faults, for tests."""
    places = [bodies.columns.index(c) for c in (body, extra, off)]

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, more, wrong = (batch.column(i) for i in places)
            read = Bytes(column)
            check = (read.checksum(np.arange(len(column)), 0, read.size, more.to_numpy().astype(np.int64)) + wrong.to_numpy()) & 0xFFFF
            made = [start + b.as_py() + int(c).to_bytes(2, "little") for b, c in zip(column, check)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, frame])

    return bodies.mapInArrow(closed, StructType([*bodies.schema.fields, StructField(frame, BinaryType())]))


def parse_stats(decoded: DataFrame, by: str = "source") -> DataFrame:
    """Frames by source: total (those that are valid packets), valid, invalid, with a bad checksum, with an unknown message id."""
    good = F.col("error").isNull()
    return decoded.groupBy(by).agg(F.count_if(good).alias("total"), F.count_if(good).alias("valid"), F.count_if(~good).alias("invalid"), F.count_if(F.col("error") == "bad checksum").alias("checksum_errors"), F.count_if(good & ~F.col("message_id").isin(*MESSAGES)).alias("unknown_ids"))


def named(code: Column, names: dict[int, str], unknown: str = "unknown(%d)") -> Column:
    """The name of a code."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.format_string(unknown, code))


def heartbeat_status(status: Column, base_mode: Column) -> Column:
    """P2."""
    name = F.when(status == 3, "standby").when(status == 4, "active").otherwise("unknown")
    return F.when(status.isNotNull(), F.when(base_mode.bitwiseAND(128) != 0, F.concat(name, F.lit(".armed"))).otherwise(name))


def _track_pairs() -> tuple[Column, list, Column]:
    """Subject and pairs of a vehicle's track, and whether a row has any usable field."""
    fields = {"h": "heartbeat", "p": "global_position_int", "a": "attitude", "b": "battery_status"}
    h, p, a, b = (lambda f, r=r: F.col(f"{r}.{f}") for r in fields.values())
    position = F.when(p("lat").isNotNull() & p("lon").isNotNull(), wkt_point(p("lon") / 1e7, p("lat") / 1e7))
    velocity = F.when(p("vx").isNotNull() & p("vy").isNotNull() & p("vz").isNotNull(), F.format_string("NED_CMPS(%d %d %d)", p("vx"), p("vy"), p("vz")))
    specific = [
        ("cop.track.status", "string", heartbeat_status(h("system_status"), h("base_mode"))),
        ("cop.track.position", "string", position),
        ("cop.track.velocity", "string", velocity),
        *[(f"cop.track.{n}", "double", F.round(a(n) * 100) / 100) for n in ("roll", "pitch", "yaw")],
        ("cop.track.battery_remaining", "long", b("battery_remaining")),
    ]
    parts = [h("system_status"), p("lat"), p("vx"), a("roll"), a("pitch"), a("yaw"), b("battery_remaining")]
    return specific, F.col("error").isNull() & reduce(lambda x, y: x | y, [o.isNotNull() for o in parts])


def _named_track(confidence: float) -> list:
    native = F.format_string("mavlink.system.%d.component.%d", "system_id", "component_id")
    return [("cop.track.native_id", "string", native), ("cop.track.observed_at", "time", time_text(F.col("received_at"))), *provenance("mavlink", F.col("received_at"), F.lit(confidence), F.col("ref"))]


def _asset_pairs(confidence: float) -> list:
    return [
        ("cop.asset.name", "string", F.format_string("MAVLink system %d", "system_id")),
        ("cop.asset.kind", "string", F.lit("mavlink-system")),
        ("cop.asset.source", "string", F.lit("mavlink")),
        ("cop.asset.native_id", "string", F.format_string("mavlink.system.%d", "system_id")),
        *provenance("mavlink", F.col("received_at"), F.lit(confidence), F.col("ref")),
    ]


def subject_of(org: str, platform: str, kind: str) -> Column:
    return entity_id(F.lit(org), F.lit(platform), "mavlink", kind, F.format_string("system-%d", "system_id"))


def usable(decoded: DataFrame) -> DataFrame:
    """Frames that say something of a vehicle: no rejects, no unknown messages, none without a usable field."""
    return decoded.filter(_track_pairs()[1])


def project(decoded: DataFrame, org: str, platform: str, confidence: float, keep: list[str]) -> DataFrame:
    """Triples of vehicle tracks. Rows that are rejects, unknown, or without a usable field give none."""
    return to_triples(usable(decoded), subject_of(org, platform, "track"), _named_track(confidence) + _track_pairs()[0], keep, F.col("received_at"), F.lit("mavlink"), F.lit(confidence))


def project_assets(births: DataFrame, org: str, platform: str, confidence: float, keep: list[str]) -> DataFrame:
    """P5: triples of the source asset of each vehicle, from the rows that first show it."""
    return to_triples(births, subject_of(org, platform, "asset"), _asset_pairs(confidence), keep, F.col("received_at"), F.lit("mavlink"), F.lit(confidence))


def project_planned(planned: DataFrame, org: str, platform: str, confidence: float, keep: list[str]) -> DataFrame:
    """P1-P5 in one pass over usable frames with their ``kind``: tracks, and on a create the asset and the edge to it."""
    track, asset = subject_of(org, platform, "track"), subject_of(org, platform, "asset")
    created = F.col("kind") == "create"
    parts = [
        (track, _named_track(confidence) + _track_pairs()[0], None),
        (asset, _asset_pairs(confidence), created),
        (track, [("cop.track.source", "entity", asset)], created),
    ]
    return to_triples_of(planned, parts, keep, F.col("received_at"), F.lit("mavlink"), F.lit(confidence))
