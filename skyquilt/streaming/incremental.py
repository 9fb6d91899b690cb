"""State inside one streaming run, and frames in captures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.folders import cut
from skyquilt.operators.mavlink import MESSAGES, Bytes
from skyquilt.operators.order import before


def streaming_state(triples: DataFrame) -> DataFrame:
    """M9 inside one run: current objects as a streaming aggregation (complete or update mode); across runs see ``ingest.StreamState``."""
    value = F.struct("object", "timestamp")
    return triples.groupBy("subject", "predicate").agg(F.max_by(value, F.struct("batch", "arrival", "idx")).alias("v")).select("subject", "predicate", "v.*")


CHUNK = 1 << 20
LONGEST = 10 + 255 + 2 + 13


def _candidates(data: bytes, most: int) -> list[tuple[int, bytes]]:
    """(offset, frame) of everything in ``data`` that begins before ``most`` and is a valid frame by itself; all starts are checked at once."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((raw[:most] == 0xFE) | (raw[:most] == 0xFD))
    byte = lambda place: raw[np.minimum(at + place, len(raw) - 1)].astype(np.int64)
    one = raw[at] == 0xFE
    head = np.where(one, 6, 10)
    check = head + byte(1)  # where the checksum stands
    size = check + 2 + np.where(~one & (byte(2) & 1 == 1), 13, 0)
    fits = (at + head <= len(raw)) & (at + size <= len(raw))
    at, one, check, size, number = at[fits], one[fits], check[fits], size[fits], np.where(one, byte(5), byte(7) | byte(8) << 8 | byte(9) << 16)[fits]
    extra = np.full(len(at), -1, np.int64)
    for k, (_, value, _) in MESSAGES.items():
        extra[number == k] = value
    frames = [data[a : a + n] for a, n in zip(at.tolist(), size.tolist())]
    read = Bytes(pa.array(frames, pa.binary()))
    rows = np.arange(len(at))
    good = read.checksum(rows, 1, check, extra) == read.number(rows, check, 2)
    return [(int(at[i]), frames[i]) for i in np.flatnonzero(good)]


def frame_candidates(captures: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(path, offset, frame) of the valid frames of captures (path, content and, if a capture comes in parts, ``part``), overlapping ones too.

    The bytes of a capture are dealt out in chunks with as much of the next one as a frame can be long, so one capture
    uses all cores, and where it is cut into parts makes no difference.
    """
    if "part" in captures.columns:
        parts = before(captures.select("path", "part", "content"), ["path"], ["part"], base=(F.octet_length("content").cast("long"), "sum"))
    else:
        parts = captures.select("path", "content").withColumn("base", F.lit(0).cast("long"))
    begin = F.coalesce("base", F.lit(0))
    parts = parts.select("path", begin.alias("begin"), (begin + F.octet_length("content")).alias("end"), "content").filter("end > begin")
    touched = F.sequence(F.greatest(F.lit(0), F.floor((F.col("begin") - LONGEST) / chunk)), F.floor((F.col("end") - 1) / chunk))
    pieces = parts.withColumn("n", F.explode(touched))
    low, high = F.greatest("begin", F.col("n") * chunk), F.least("end", (F.col("n") + 1) * chunk + LONGEST)
    pieces = pieces.select("path", "n", low.alias("at"), F.substring("content", (low - F.col("begin") + 1).cast("int"), (high - low).cast("int")).alias("bytes")).filter(F.octet_length("bytes") > 0)
    whole = pieces.groupBy("path", "n").agg(F.sort_array(F.collect_list(F.struct("at", "bytes"))).alias("pieces"))

    def scanned(batches):
        for batch in batches:
            found = []
            for path, n, held in zip(*(batch.column(c).to_pylist() for c in ("path", "n", "pieces"))):
                found += [(path, n * chunk + at, frame) for at, frame in _candidates(b"".join(p["bytes"] for p in held), chunk)]
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()))], ["path", "offset", "frame"])

    return whole.mapInArrow(scanned, "path string, offset long, frame binary")


def frame_scan(captures: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(path, offset, frame, n_bad) of noisy captures: the frames that a reader takes who goes on one byte after a bad start and behind a good frame; n_bad: the bytes passed over before each.

    A candidate that begins behind all earlier ones is taken whatever came before, so the others, which overlap, form
    short clusters with it, and only those are walked through one by one.
    """
    found = before(frame_candidates(captures, chunk).withColumn("end", F.col("offset") + F.octet_length("frame")), ["path"], ["offset"], reach=(F.col("end"), "max"))
    opens = F.coalesce(F.col("reach") <= F.col("offset"), F.lit(True))
    led = before(found.withColumn("lead", F.when(opens, F.col("offset"))), ["path"], ["offset"], __cluster=(F.col("lead"), "last"))
    led = led.withColumn("cluster", F.coalesce("lead", "__cluster")).drop("__cluster", "lead", "reach")
    sizes = led.groupBy("path", "cluster").agg(F.count("*").alias("__n"))
    some = cut(led.join(sizes, ["path", "cluster"]))
    alone = some.filter("__n = 1").select("path", "offset", "frame", "end")

    def walked(key: tuple, group: pa.Table) -> pa.Table:
        rows, to, keep = group.sort_by("offset"), -1, []
        for i, (at, end) in enumerate(zip(rows.column("offset").to_pylist(), rows.column("end").to_pylist())):
            if at >= to:
                keep.append(i)
                to = end
        return rows.take(keep).select(["path", "offset", "frame", "end"])

    taken = alone.unionByName(some.filter("__n > 1").groupBy("path", "cluster").applyInArrow(walked, "path string, offset long, frame binary, end long"))
    told = before(taken, ["path"], ["offset"], __to=(F.col("end"), "max"))
    return told.select("path", "offset", "frame", (F.col("offset") - F.coalesce("__to", F.lit(0))).alias("n_bad"))
