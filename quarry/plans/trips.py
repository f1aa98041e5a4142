"""Taxi-trip study (HiveQL in the reference): stage -> partitioned columnar copy -> rule
scorecard -> cleansed copy -> reports.  Bound to `lineitem` x `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import functions as QF
from quarry import sources
from quarry.operators import aggs, clean, profile
from quarry.plans.tables import trips, with_ctes
from quarry.session import cut_lineage

# fixed values: speed limit of the rule set, in distance units per hour of the bound data
SPEED_LIMIT = 0.05
# fixed values: tip bands (the reference labels 15-20 as 15-25, Q8; ours say what they hold)
TIP_EDGES = [0, 500, 1000, 1500, 2000, float("inf")]
TIP_LABELS = ["0-500", "500-1000", "1000-1500", "1500-2000", ">=2000"]


def trip_rules():
    """B13 rules, TRUE = broken.  Ratios use try_divide (Q11: zero durations give NULL)."""
    speed = QF.rate("distance", "pickup", "dropoff", "hour")
    return {
        "passengers_over_6": F.col("passengers") > 6,
        "pickup_after_dropoff": F.col("pickup") > F.col("dropoff"),
        "same_time_moved": (F.col("pickup") == F.col("dropoff")) & (F.col("distance") > 0),
        "zero_passengers": F.col("passengers") == 0,
        "too_fast": (speed > SPEED_LIMIT) & (F.col("dropoff") > F.col("pickup")) & (F.col("distance") > 0),
        "negative_amount": (F.col("fare") < 0) | (F.col("tip") < 0),
        "cash_tip": (F.col("payment") == "N") & (F.col("tip") != 0),
        "odd_extra": ~F.col("extra").isin(0.0, 0.04, 0.08),
    }


SPEED_SQL = "(distance * 3600.0) / nullif(epoch(dropoff) - epoch(pickup), 0)"
RULES_SQL = {
    "passengers_over_6": "passengers > 6",
    "pickup_after_dropoff": "pickup > dropoff",
    "same_time_moved": "pickup = dropoff AND distance > 0",
    "zero_passengers": "passengers = 0",
    "too_fast": f"(distance * 3600.0) / nullif(epoch(dropoff) - epoch(pickup), 0) > {SPEED_LIMIT} "
                "AND dropoff > pickup AND distance > 0",
    "negative_amount": "fare < 0 OR tip < 0",
    "cash_tip": "payment = 'N' AND tip <> 0",
    "odd_extra": "extra NOT IN (0.0, 0.04, 0.08)",
}


def q_rule_violations(spark, sf):
    """Rows breaking each rule, per vendor, one pass."""
    return profile.rule_violations(trips(spark, sf), trip_rules(), by=["vendor"])


SQL_RULE_VIOLATIONS = with_ctes(" UNION ALL ".join(
    f"SELECT vendor, '{n}' AS rule, count(*) FILTER (WHERE {c}) AS violations FROM trips GROUP BY vendor"
    for n, c in RULES_SQL.items()), "trips")


def q_cleanse(spark, sf):
    """Rows passing every rule, counted per vendor and month."""
    return aggs.count_by(clean.cleanse(trips(spark, sf), trip_rules()), ["vendor", "yr", "mnth"])


SQL_CLEANSE = with_ctes("SELECT vendor, yr, mnth, count(*) AS n FROM trips WHERE " + " AND ".join(
    f"NOT coalesce(({c}), false)" for c in RULES_SQL.values()) + " GROUP BY vendor, yr, mnth", "trips")


def q_mean_by(spark, sf):
    """average fare per month."""
    return aggs.mean_by(trips(spark, sf), ["mnth"], {"avg_fare": "fare"}) \
        .withColumn("avg_fare", F.round("avg_fare", 4))


SQL_MEAN_BY = with_ctes("SELECT mnth, round(avg(fare), 4) AS avg_fare FROM trips GROUP BY mnth", "trips")


def q_approx_percentiles(spark, sf):
    """Tip quartiles by sketch (accuracy above the row count: exact lower quantiles)."""
    return profile.approx_percentiles(trips(spark, sf), "tip", [0.25, 0.5, 0.75], accuracy=1_000_000) \
        .withColumn("value", F.round("value", 6))


SQL_APPROX_PERCENTILES = with_ctes(" UNION ALL ".join(
    f"SELECT {p} AS prob, round(quantile_disc(tip, {p}), 6) AS value FROM trips" for p in (0.25, 0.5, 0.75)),
    "trips")


PROBS = (0.1, 0.25, 0.5, 0.75, 0.9)
RANK_ERROR = 0.002  # about twice the sketch's normalised rank error


def q_sketch_percentiles(spark, sf):
    """Sketches of the tips of each month kept as a table, merged for the year, and whether each
    quantile's true rank lies within the sketch's error."""
    t = trips(spark, sf)
    kept = cut_lineage(profile.quantile_sketches(t, "tip", ["mnth"]), "sketches")
    found = profile.merged_quantiles(kept, PROBS)
    values = [found.where(F.col("prob") == p).select("value").scalar() for p in PROBS]
    n, tip = F.count("tip"), F.col("tip")
    row = t.agg(F.array(*[F.struct(F.lit(p).alias("prob"), (F.count_if(tip < v) / n).alias("low"), (F.count_if(tip <= v) / n).alias("high"))
                          for p, v in zip(PROBS, values, strict=True)]).alias("ranks"))
    within = (F.col("low") - RANK_ERROR <= F.col("prob")) & (F.col("prob") <= F.col("high") + RANK_ERROR)
    return row.select(F.inline("ranks")).select("prob", within.alias("within"))


SQL_SKETCH_PERCENTILES = f"SELECT CAST(unnest({list(PROBS)}) AS DOUBLE) AS prob, true AS within"


def q_share_where(spark, sf):
    """share of trips with an extra levied (> 0, Q9), totals from the data."""
    return aggs.share_where(trips(spark, sf), F.col("extra") > 0)


SQL_SHARE_WHERE = with_ctes("""SELECT count(*) AS rows, count(*) FILTER (WHERE extra > 0) AS hits,
 count(*) FILTER (WHERE extra > 0) / count(*) AS share FROM trips""", "trips")


def q_corr(spark, sf):
    """correlation of passenger count and tip."""
    return aggs.corr(trips(spark, sf), "passengers", "tip").withColumn("r", F.round("r", 8))


SQL_CORR = with_ctes("SELECT round(corr(passengers, tip), 8) AS r FROM trips", "trips")


def q_compare_segments(spark, sf):
    """average tip of solo vs group trips, one pass."""
    segs = {"solo": F.col("passengers") == 1, "group": F.col("passengers") > 1}
    return aggs.compare_segments(trips(spark, sf), segs, "tip").withColumn("value", F.round("value", 6))


SQL_COMPARE_SEGMENTS = with_ctes("""SELECT 'solo' AS segment, count(*) AS rows, round(avg(tip), 6) AS value
FROM trips WHERE passengers = 1 UNION ALL
SELECT 'group', count(*), round(avg(tip), 6) FROM trips WHERE passengers > 1""", "trips")


def q_bucket_share(spark, sf):
    """share of trips per tip band, total from the data (Q2)."""
    return aggs.bucket_share(trips(spark, sf), "tip", TIP_EDGES, TIP_LABELS, "tip_band") \
        .withColumn("share", F.round("share", 8))


SQL_BUCKET_SHARE = with_ctes("""SELECT tip_band, n, round(n / sum(n) OVER (), 8) AS share FROM (
 SELECT CASE WHEN tip >= 0 AND tip < 500 THEN '0-500' WHEN tip >= 500 AND tip < 1000 THEN '500-1000'
  WHEN tip >= 1000 AND tip < 1500 THEN '1000-1500' WHEN tip >= 1500 AND tip < 2000 THEN '1500-2000'
  WHEN tip >= 2000 THEN '>=2000' END AS tip_band, count(*) AS n FROM trips GROUP BY 1)""", "trips")


def q_rate(spark, sf):
    """Average speed per month (zero durations give NULL and are skipped)."""
    t = trips(spark, sf).withColumn("speed", QF.rate("distance", "pickup", "dropoff", "hour"))
    return t.groupBy("yr", "mnth").agg(F.round(F.avg("speed"), 8).alias("avg_speed"))


SQL_RATE = with_ctes(f"SELECT yr, mnth, round(avg({SPEED_SQL}), 8) AS avg_speed FROM trips GROUP BY yr, mnth",
                     "trips")


def q_elapsed(spark, sf):
    """Trip durations in seconds and hours (negative when pickup follows drop-off)."""
    t = trips(spark, sf)
    return t.groupBy("vendor").agg(F.sum(QF.elapsed("pickup", "dropoff")).alias("total_seconds"),
                                   F.round(F.avg(QF.elapsed("pickup", "dropoff", "hour")), 6).alias("avg_hours"))


SQL_ELAPSED = with_ctes("""SELECT vendor, CAST(sum(epoch(dropoff) - epoch(pickup)) AS BIGINT) AS total_seconds,
 round(avg((epoch(dropoff) - epoch(pickup)) / 3600.0), 6) AS avg_hours FROM trips GROUP BY vendor""", "trips")


def q_date_parts_seen(spark, sf):
    """Years seen in the pickup and drop-off columns."""
    return profile.date_parts_seen(trips(spark, sf), ["pickup", "dropoff"], "year")


SQL_DATE_PARTS_SEEN = with_ctes("""SELECT 'pickup' AS column, year(pickup) AS value, count(*) AS rows
FROM trips GROUP BY 2 UNION ALL SELECT 'dropoff', year(dropoff), count(*) FROM trips GROUP BY 2""", "trips")


def q_set_where(spark, sf):
    """Cash tips set to zero, then the average tip per payment type."""
    t = clean.set_where(trips(spark, sf), "tip", F.col("payment") == "N", 0.0)
    return t.groupBy("payment").agg(F.round(F.avg("tip"), 6).alias("avg_tip"))


SQL_SET_WHERE = with_ctes("""SELECT payment, round(avg(CASE WHEN payment = 'N' THEN 0.0 ELSE tip END), 6) AS avg_tip
FROM trips GROUP BY payment""", "trips")


def q_read_partitioned(spark, sf):
    """A4 + A5: dynamic-partition ORC (snappy) write by yr/mnth, then a pruned scan of month 12."""
    path = sources.scratch_path(spark, "trips_orc")
    t = sources.derive_parts(trips(spark, sf).drop("yr", "mnth"), "pickup")
    sources.write_partitioned(t, path, ["yr", "mnth"])
    back = sources.read_partitioned(spark, path, F.col("mnth") == 12)
    return aggs.count_by(back, ["yr", "vendor"])


SQL_READ_PARTITIONED = with_ctes("SELECT yr, vendor, count(*) AS n FROM trips WHERE mnth = 12 GROUP BY yr, vendor",
                                 "trips")

STAGED_SCHEMA = ("vendor string, pickup timestamp, dropoff timestamp, passengers int, distance double, "
                 "fare double, tip double, payment string, extra double")


def q_read_staged(spark, sf):
    """A3 + A6: the trips written as delimited text (header line included), read back with a declared
    schema; the header row parses to NULLs and is dropped by the key rule."""
    path = sources.scratch_path(spark, "trips_csv")
    cols = [c.split()[0] for c in STAGED_SCHEMA.split(", ")]
    sources.write_csv(trips(spark, sf).select(*cols), path, header=True)
    st = sources.read_staged(spark, path, STAGED_SCHEMA, key="passengers")
    return st.groupBy("vendor").agg(F.count(F.lit(1)).alias("n"), F.sum("passengers").alias("passengers"),
                                    F.round(F.sum("fare"), 2).alias("fare"))


SQL_READ_STAGED = with_ctes("""SELECT vendor, count(*) AS n, sum(passengers) AS passengers, round(sum(fare), 2) AS fare
FROM trips GROUP BY vendor""", "trips")


def study(spark, sf, root: str | None = None) -> dict:
    """The whole trip study, end to end:

    staged text (declared schema, lenient) -> partitioned ORC copy by yr/mnth ->
    rule scorecard -> cleansed partitioned ORC copy -> reports.  Intermediate
    tables live under ``root`` (default: a fresh folder under the shared
    checkpoint directory).  Returns the report DataFrames (lazy).
    """
    root = root or sources.scratch_path(spark, "trip_study")
    cols = [c.split()[0] for c in STAGED_SCHEMA.split(", ")]
    sources.write_csv(trips(spark, sf).select(*cols), f"{root}/staging", header=True)
    staged = sources.read_staged(spark, f"{root}/staging", STAGED_SCHEMA, key="passengers")
    sources.write_partitioned(sources.derive_parts(staged, "pickup"), f"{root}/raw", ["yr", "mnth"])
    raw = sources.read_partitioned(spark, f"{root}/raw")
    scorecard = profile.rule_violations(raw, trip_rules(), by=["vendor"])
    clean_t = clean.cleanse(raw, trip_rules()).withColumn("day", F.dayofmonth("pickup"))
    sources.write_partitioned(clean_t, f"{root}/clean", ["yr", "mnth"])
    c = sources.read_partitioned(spark, f"{root}/clean")
    return {
        "scorecard": scorecard,
        "rows": aggs.count_by(c, ["yr", "mnth"]),
        "fare_by_month": aggs.mean_by(c, ["mnth"], {"avg_fare": "fare"}),
        "trips_by_passengers": aggs.count_by(c, ["passengers"]),
        "payment_mix": aggs.count_by(c, ["payment"]),
        "tip_quartiles": profile.approx_percentiles(c, "tip", [0.25, 0.5, 0.75], accuracy=1_000_000),
        "extra_share": aggs.share_where(c, F.col("extra") > 0),
        "tip_vs_passengers": aggs.corr(c, "passengers", "tip"),
        "solo_vs_group": aggs.compare_segments(c, {"solo": F.col("passengers") == 1,
                                                   "group": F.col("passengers") > 1}, "tip"),
        "tip_bands": aggs.bucket_share(c, "tip", TIP_EDGES, TIP_LABELS, "tip_band"),
        "speed_by_month": c.groupBy("mnth").agg(F.avg(QF.rate("distance", "pickup", "dropoff")).alias("avg_speed")),
        "december_days": c.where(F.col("mnth") == 12).groupBy("day").agg(
            F.avg(QF.rate("distance", "pickup", "dropoff")).alias("avg_speed")),
    }


QUERIES = {
    "rule_violations": q_rule_violations, "cleanse": q_cleanse, "mean_by": q_mean_by,
    "approx_percentiles": q_approx_percentiles, "sketch_percentiles": q_sketch_percentiles, "share_where": q_share_where, "corr": q_corr,
    "compare_segments": q_compare_segments, "bucket_share": q_bucket_share, "rate": q_rate,
    "elapsed": q_elapsed, "date_parts_seen": q_date_parts_seen, "set_where": q_set_where,
    "read_partitioned": q_read_partitioned, "read_staged": q_read_staged,
}
ORACLE = {
    "rule_violations": SQL_RULE_VIOLATIONS, "cleanse": SQL_CLEANSE, "mean_by": SQL_MEAN_BY,
    "approx_percentiles": SQL_APPROX_PERCENTILES, "sketch_percentiles": SQL_SKETCH_PERCENTILES, "share_where": SQL_SHARE_WHERE, "corr": SQL_CORR,
    "compare_segments": SQL_COMPARE_SEGMENTS, "bucket_share": SQL_BUCKET_SHARE, "rate": SQL_RATE,
    "elapsed": SQL_ELAPSED, "date_parts_seen": SQL_DATE_PARTS_SEEN, "set_where": SQL_SET_WHERE,
    "read_partitioned": SQL_READ_PARTITIONED, "read_staged": SQL_READ_STAGED,
}
