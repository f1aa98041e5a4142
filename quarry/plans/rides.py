"""Ride supply-demand study (R dplyr in the reference): parse two timestamp formats,
slot the day, count requests and the gap per slot.  Bound to `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import functions as QF
from quarry.operators import aggs, clean
from quarry.plans.tables import rides, with_ctes

# fixed values: the two request-time formats and the day slots
PATTERNS = ["d-M-yyyy HH:mm:ss", "d/M/yyyy HH:mm"]
SLOT_EDGES = [0, 4, 8, 12, 16, 20, 24]
SLOT_LABELS = ["midnight", "early morning", "morning", "noon", "evening", "late evening"]
SLOT_ORDER = ["early morning", "morning", "noon", "evening", "late evening", "midnight"]
SLOT_SQL = clean.bucket_sql("hour(p)", SLOT_EDGES, SLOT_LABELS)
PARSE_SQL = """coalesce(try_strptime(request_ts, '%d-%m-%Y %H:%M:%S'), try_strptime(request_ts, '%d/%m/%Y %H:%M'))"""


def slotted(spark, sf):
    r = rides(spark, sf).withColumn("request", QF.parse_any("request_ts", PATTERNS))
    r = r.withColumn("request_hour", F.hour("request"))
    return clean.bucketize(r, "request_hour", SLOT_EDGES, SLOT_LABELS, "slot")


SLOTTED_SQL = f"""
, slotted AS (SELECT *, {SLOT_SQL} AS slot, hour(p) AS request_hour
              FROM (SELECT *, {PARSE_SQL} AS p FROM rides))"""


def q_parse_any(spark, sf):
    """Request time in either of two formats, per row; requests per hour of day."""
    r = rides(spark, sf).withColumn("request", QF.parse_any("request_ts", PATTERNS))
    return r.groupBy(F.hour("request").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


SQL_PARSE_ANY = with_ctes(f"SELECT CAST(hour({PARSE_SQL}) AS INTEGER) AS hour, count(*) AS n FROM rides GROUP BY 1",
                          "rides")


def q_gap_by(spark, sf):
    """requests, completed trips and the gap per slot and pickup point, one pass (Q14)."""
    return aggs.gap_by(slotted(spark, sf), ["slot", "pickup_point"], F.col("status") == "Trip Completed")


SQL_GAP_BY = with_ctes(SLOTTED_SQL + """
SELECT slot, pickup_point, count(*) AS requests, count(*) FILTER (WHERE status = 'Trip Completed') AS served,
 count(*) - count(*) FILTER (WHERE status = 'Trip Completed') AS gap FROM slotted GROUP BY slot, pickup_point""",
                       "rides")


def q_status_by_slot(spark, sf):
    """F13 + C17: requests by slot and status, slots in the stated order of the day."""
    c = aggs.crosstab(slotted(spark, sf), "slot", "status")
    return clean.sort_by_levels(c, "slot", SLOT_ORDER, "slot_order")


SQL_STATUS_BY_SLOT = with_ctes(SLOTTED_SQL + """
SELECT slot, status, count(*) AS n, CAST(coalesce(list_position({slots}, slot), {last}) AS BIGINT) AS slot_order FROM slotted GROUP BY slot, status""".replace("{slots}", str(SLOT_ORDER)).replace("{last}", str(len(SLOT_ORDER) + 1)), "rides")


def q_drop_time(spark, sf):
    """D11 + C10: drop times parsed; set to NULL where the trip was not completed; mean ride minutes per point."""
    r = rides(spark, sf).withColumn("request", QF.parse_any("request_ts", PATTERNS)) \
        .withColumn("drop", QF.parse_any("drop_ts", PATTERNS))
    r = clean.set_where(r, "drop", F.col("status") != "Trip Completed", None)
    return r.groupBy("pickup_point").agg(
        F.round(F.avg(QF.elapsed("request", "drop", "minute")), 6).alias("avg_minutes"),
        F.count("drop").alias("completed"))


SQL_DROP_TIME = with_ctes(f"""SELECT pickup_point,
 round(avg((epoch(d) - epoch({PARSE_SQL})) / 60.0), 6) AS avg_minutes, count(d) AS completed FROM (
 SELECT *, CASE WHEN status = 'Trip Completed' THEN coalesce(try_strptime(drop_ts, '%d-%m-%Y %H:%M:%S'),
  try_strptime(drop_ts, '%d/%m/%Y %H:%M')) END AS d FROM rides) GROUP BY pickup_point""", "rides")


QUERIES = {"parse_any": q_parse_any, "gap_by": q_gap_by, "status_by_slot": q_status_by_slot, "drop_time": q_drop_time}
ORACLE = {"parse_any": SQL_PARSE_ANY, "gap_by": SQL_GAP_BY, "status_by_slot": SQL_STATUS_BY_SLOT,
          "drop_time": SQL_DROP_TIME}
