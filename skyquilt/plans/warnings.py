"""Registered queries of warnings in full: all blocks, evidence as triples, and hazards read back from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyquilt.functions import text as tx
from skyquilt.operators import cap, state
from skyquilt.operators.triples import settled
from skyquilt.plans import lenses
from skyquilt.plans.catalog import KEEP, ORG, PLATFORM, now, query, window


@query(
    "d4_warning_blocks",
    """SELECT o_orderkey, 0 AS block, 'Flood ' || o_orderkey % 4 AS event, 'en-US' AS language, 'Met/Geo' AS categories, 'level=' || o_orderkey % 9 AS parameters, 'map,image/png,u' || o_orderkey || ',' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE '' END AS resources,
      'Bank ' || o_custkey % 5 || CASE WHEN o_orderkey % 3 = 1 THEN '/Far/Off' ELSE '' END AS areas, (CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 0 ELSE 2 END + CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END)::INT AS n_polygons,
      (CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END)::INT AS n_circles, 'http://w/' || o_orderkey AS web, 'hq r' || o_orderkey AS header FROM orders
    UNION ALL SELECT o_orderkey, 1, 'Wind', '', '', '', ',,a,/,,b,', '', 0, 0, '', 'hq r' || o_orderkey FROM orders""",
)
def d4(spark, sf_dir):
    """Every info block of every warning with its areas, resources and lists."""
    d = cap.decode(lenses.warning_histories(spark, sf_dir)).filter("error is null")
    b = d.select("o_orderkey", "alert_source", "references", F.posexplode("infos").alias("block", "i"))
    i = F.col("i")
    joined = lambda c, f, by="/": F.array_join(F.transform(c, f), by)
    total = lambda c: F.aggregate(i["areas"], F.lit(0), lambda acc, a: acc + F.size(a[c]))
    return b.select(
        "o_orderkey", "block", i["event"].alias("event"), i["language"].alias("language"), F.array_join(i["categories"], "/").alias("categories"), joined(i["parameters"], lambda p: F.concat(p["name"], F.lit("="), p["value"])).alias("parameters"),
        joined(i["resources"], lambda r: F.concat_ws(",", r["description"], r["mime_type"], r["uri"], r["digest"])).alias("resources"), joined(i["areas"], lambda a: a["area_desc"]).alias("areas"),
        total("polygons").alias("n_polygons"), total("circles").alias("n_circles"), i["web"].alias("web"), F.concat_ws(" ", "alert_source", "references").alias("header"),
    )


_WH = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderstatus = 'P' THEN 'Cancel' WHEN o_orderkey % 2 = 0 THEN 'Update' ELSE 'Alert' END AS kind, date_trunc('quarter', o_orderdate::TIMESTAMP) AS q FROM orders) """


@query(
    "p15_evidence_triples",
    _WH + """, t AS (SELECT 'org.edge.cop.cap.hazard_area.c-' || c AS subject, k AS arrival, q, CASE WHEN k % 3 = 0 THEN 0.95 ELSE 0.82 END AS confidence, c, kind FROM o)
    SELECT subject, arrival, predicate, object, confidence FROM (
    SELECT *, 'cop.hazard.advisory_text' AS predicate, 'Rise ' || arrival || chr(10) || chr(10) || 'Leave' AS object FROM t UNION ALL SELECT *, 'cop.hazard.source', 'cap' FROM t UNION ALL SELECT *, 'cop.provenance.source', 'cap' FROM t
    UNION ALL SELECT *, 'cop.provenance.confidence', confidence::VARCHAR FROM t UNION ALL SELECT *, 'cop.provenance.observed_at', strftime(q, '%Y-%m-%d') || 'T06:00:00.000000Z' FROM t UNION ALL SELECT *, 'cop.provenance.source_ref', 'cap://raw/desk/' || arrival FROM t
    UNION ALL SELECT *, 'cop.hazard.evidence', concat_ws('|', 'C-' || c, kind, 'Flood ' || arrival % 4, CASE WHEN arrival % 6 = 0 THEN '' ELSE 'Severe' END, 'Bank ' || c % 5, strftime(q, '%Y-%m-%d') || 'T00:00:00Z', CASE WHEN arrival % 11 = 0 THEN strftime(q, '%Y-%m-%d') || 'T07:00:00Z' ELSE '2099-01-01T00:00:00Z' END,
      CASE WHEN arrival % 7 = 0 THEN 'none' WHEN arrival % 5 = 0 THEN 'circle 12.5' ELSE 'polygon 2' END, 'u' || arrival || ':' || CASE WHEN arrival % 2 = 0 THEN arrival::VARCHAR ELSE 'none' END, '0' || c) FROM t)""",
)
def p15(spark, sf_dir):
    """The evidence triples of every warning; of the document, its parts as they are read back."""
    t = cap.project(cap.decode(lenses.warning_histories(spark, sf_dir)), ORG, PLATFORM, 0.5, KEEP)
    # settled, so that a document is read once and not for each of its parts
    t = settled(t.withColumn("d", F.when(F.col("predicate") == "cop.hazard.evidence", F.from_json("object", cap.DOCUMENT, {"mode": "FAILFAST"}))))
    d = F.col("d")
    shape = F.when(d["polygons"].isNotNull(), F.concat(F.lit("polygon "), F.size(d["polygons"]).cast("string"))).when(d["circles"].isNotNull(), F.concat(F.lit("circle "), d["circles"][0]["radius_km"].cast("string"))).otherwise("none")
    resource = F.concat(d["resources"][0]["uri"], F.lit(":"), F.coalesce(d["resources"][0]["digest"], F.lit("none")))
    said = F.concat_ws("|", d["identifier"], d["message_type"], d["event"], d["severity"], d["area_desc"], d["sent"], d["expires"], shape, resource, d["geocodes"][0]["value"])
    return t.select("subject", "arrival", "predicate", F.when(F.col("predicate") == "cop.hazard.evidence", said).otherwise(F.col("object")).alias("object"), "confidence")


@query(
    "v5_hazards_of_evidence",
    _WH + """, last AS (SELECT c, arg_max(k, epoch_us(q) / 1000000 * 100000000 + k) AS k FROM o GROUP BY c), h AS (SELECT o.* FROM o JOIN last ON o.c = last.c AND o.k = last.k)
    SELECT 'org.edge.cop.cap.hazard_area.c-' || c AS subject, 'Flood ' || k % 4 || ': Bank ' || c % 5 AS label, 'cap-flood-' || k % 4 AS kind, CASE WHEN k % 6 = 0 THEN 'unknown' ELSE 'severe' END AS severity,
    CASE WHEN kind = 'Cancel' THEN 'cancelled' WHEN k % 11 = 0 THEN 'expired' WHEN kind = 'Update' THEN 'stale.update' ELSE 'stale' END AS status, CASE WHEN k % 5 = 0 THEN 24 ELSE 4 END::INT AS n_points,
    strftime(q, '%Y-%m-%d') || ' 06:00' AS updated, CASE WHEN k % 3 = 0 THEN 0.95 ELSE 0.82 END::DOUBLE AS confidence, 'cap://raw/desk/' || k AS source_ref FROM h WHERE k % 7 <> 0""",
)
def v5(spark, sf_dir):
    """Hazards from the evidence of all messages, appended in two parts; times tie within a quarter, then the later message wins."""
    raw, odd = lenses.warning_histories(spark, sf_dir), F.col("arrival") % 2 == 1
    old, new = [cap.project(cap.decode(part), ORG, PLATFORM, 0.5, KEEP) for part in (raw.filter(odd), raw.filter(~odd))]
    h = cap.hazards_of_evidence(state.append_evidence(old, new), now(), window())
    return h.select("subject", "label", "kind", "severity", "status", F.size("geometry").alias("n_points"), F.date_format("updated_at", "yyyy-MM-dd HH:mm").alias("updated"), "confidence", "source_ref")


@query(
    "r5_edge_refs",
    """SELECT c_custkey, 'cap://raw/' || CASE c_custkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'caf----' || lower(replace(c_mktsegment, ' ', '-')) WHEN 2 THEN lower(c_mktsegment) WHEN 3 THEN 'unknown' ELSE 'a.b_c' END || '/' || lower(replace(c_name, '#', '-')) || '/' || (c_custkey * 1000000000)::VARCHAR AS ref FROM customer""",
)
def r5(spark, sf_dir):
    """References of names with outer dashes and white space, letters of other alphabets, blanks and nulls."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, " - ").when(k % 5 == 1, F.concat(F.lit("Café/Ω "), F.col("c_mktsegment"))).when(k % 5 == 2, F.concat(F.lit(" -"), F.col("c_mktsegment"), F.lit("-- "))).when(k % 5 == 4, "\tA.b_C\n")
    return c.select("c_custkey", tx.cap_ref(name, F.concat(F.lit("--"), F.col("c_name"), F.lit("é")), F.timestamp_seconds("c_custkey")).alias("ref"))
