"""Parking-violation study (SparkR + Spark SQL in the reference) on the `events` / `orders` bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import functions as QF
from quarry.operators import aggs, clean, joins, profile, rank, reshape
from quarry.plans.tables import FINES, tickets, tickets_by_year, violations, with_ctes
from quarry.session import literal_table

# fixed values: 4-hour slots of the day (edges in hours, labels)
SLOT_EDGES = [0, 4, 8, 12, 16, 20, 24]
SLOT_LABELS = ["0-4", "4-8", "8-12", "12-16", "16-20", "20-24"]
SLOT_SQL = clean.bucket_sql("hour", SLOT_EDGES, SLOT_LABELS)

# fixed values: month -> season
SEASONS = {"Fall": [9, 10, 11], "Winter": [12, 1, 2], "Spring": [3, 4, 5], "Summer": [6, 7, 8]}


def timed_violations(v, meridiem: str = "ignore"):
    """Drop NULL times, take the hour from the first two characters (Q1: the A/P
    suffix is ignored for parity, or applied), keep hours < 24, label 4-hour slots."""
    t = clean.drop_nulls(v, ["time_text"])
    hour = QF.to_int(F.substring("time_text", 1, 2))
    if meridiem == "apply":
        pm = F.col("time_text").endswith("P")
        hour = F.when(pm & (hour < 12), hour + 12).when(~pm & (hour == 12), F.lit(0)).otherwise(hour)
    t = t.withColumn("hour", hour).where(F.col("hour") < 24)
    return clean.bucketize(t, "hour", SLOT_EDGES, SLOT_LABELS, "slot")


def q_top_k_by_group(spark, sf):
    """G2 + C4 + C8 + D2 + F1: top 3 codes per 4-hour slot (minimum slice, entry())."""
    return rank.top_k_by(timed_violations(violations(spark, sf)), ["slot"], "code", 3)


SQL_TOP_K_BY_GROUP = with_ctes("""
, t AS (SELECT code, TRY_CAST(substring(time_text, 1, 2) AS INTEGER) AS hour FROM violations
        WHERE time_text IS NOT NULL)
, s AS (SELECT code, hour, """ + SLOT_SQL + """ AS slot FROM t WHERE hour < 24)
, c AS (SELECT slot, code, count(*) AS n FROM s GROUP BY slot, code)
SELECT slot, code, n, rank FROM (
  SELECT slot, code, n, row_number() OVER (PARTITION BY slot ORDER BY n DESC, code) AS rank FROM c)
WHERE rank <= 3""", "violations")


def q_top_k(spark, sf):
    """G1: top 5 precincts by tickets, erroneous precinct 0 excluded."""
    v = violations(spark, sf)
    return rank.top_k(v, "precinct", 5, exclude=F.col("precinct") == 0)


SQL_TOP_K = with_ctes("""SELECT precinct, count(*) AS n FROM violations WHERE NOT coalesce(precinct = 0, false)
GROUP BY precinct ORDER BY n DESC, precinct LIMIT 5""", "violations")


def q_nth_by(spark, sf):
    """The second most common code per precinct."""
    return rank.nth_by(violations(spark, sf), ["precinct"], "code", 2)


SQL_NTH_BY = with_ctes("""SELECT precinct, code, n FROM (
  SELECT precinct, code, n, row_number() OVER (PARTITION BY precinct ORDER BY n DESC, code) AS r
  FROM (SELECT precinct, code, count(*) AS n FROM violations GROUP BY precinct, code)) WHERE r = 2""",
                       "violations")


def q_count_by(spark, sf):
    """tickets per code and precinct."""
    return aggs.count_by(violations(spark, sf), ["code", "precinct"])


SQL_COUNT_BY = with_ctes("SELECT code, precinct, count(*) AS n FROM violations GROUP BY code, precinct", "violations")


def q_length_profile(spark, sf):
    """Lengths of the time text."""
    return profile.length_profile(violations(spark, sf), "time_text")


SQL_LENGTH_PROFILE = with_ctes("""SELECT min(length(time_text)) AS min_len, max(length(time_text)) AS max_len,
 count(DISTINCT length(time_text)) AS n_lengths FROM violations""", "violations")


def q_drop_nulls(spark, sf):
    """Tickets with a time (NULL times dropped)."""
    return clean.drop_nulls(violations(spark, sf), ["time_text"]).select("event_id", "time_text")


SQL_DROP_NULLS = with_ctes("SELECT event_id, time_text FROM violations WHERE time_text IS NOT NULL", "violations")


def q_to_int(spark, sf):
    """D2 + D1: hour text -> int, bad text -> NULL."""
    v = violations(spark, sf)
    return v.select("event_id", QF.to_int(F.substring("time_text", 1, 2)).alias("hour"),
                    QF.to_int(F.substring("time_text", 3, 2)).alias("mins"))


SQL_TO_INT = with_ctes("""SELECT event_id, TRY_CAST(substring(time_text, 1, 2) AS INTEGER) AS hour,
 TRY_CAST(substring(time_text, 3, 2) AS INTEGER) AS mins FROM violations""", "violations")


def q_bucketize(spark, sf):
    """C4: 4-hour slot labels with the A/P suffix applied (Q1 option) -> tickets per slot."""
    return aggs.count_by(timed_violations(violations(spark, sf), meridiem="apply"), ["slot"])


SQL_BUCKETIZE = with_ctes("""
, t AS (SELECT TRY_CAST(substring(time_text, 1, 2) AS INTEGER) AS h0, time_text LIKE '%P' AS pm
        FROM violations WHERE time_text IS NOT NULL)
, u AS (SELECT CASE WHEN pm AND h0 < 12 THEN h0 + 12 WHEN NOT pm AND h0 = 12 THEN 0 ELSE h0 END AS hour FROM t)
SELECT """ + SLOT_SQL + """ AS slot, count(*) AS n FROM u WHERE hour < 24 GROUP BY 1""",
                          "violations")


def q_where(spark, sf):
    """LIKE suffix, IN, NOT BETWEEN, IS NULL, OR / AND / NOT in one predicate."""
    v = violations(spark, sf)
    cond = ((F.col("time_text").like("%P") & F.col("code").isin("click", "view")
             & ~F.col("precinct").between(5, 10)) | F.col("time_text").isNull()
            | (F.col("time_text").like("1%") & (F.col("precinct") != 3)))
    return clean.where(v, cond).select("event_id", "code", "precinct", "time_text")


SQL_WHERE = with_ctes("""SELECT event_id, code, precinct, time_text FROM violations
WHERE (time_text LIKE '%P' AND code IN ('click', 'view') AND precinct NOT BETWEEN 5 AND 10)
   OR time_text IS NULL OR (time_text LIKE '1%' AND precinct <> 3)""", "violations")


def q_replace_value(spark, sf):
    """State code '99' (played by NATION_24) recoded to NATION_0, then tickets per state."""
    return aggs.count_by(clean.replace_value(tickets(spark, sf), "state", "NATION_24", "NATION_0"), ["state"])


SQL_REPLACE_VALUE = with_ctes("""SELECT CASE WHEN state = 'NATION_24' THEN 'NATION_0' ELSE state END AS state,
 count(*) AS n FROM tickets GROUP BY 1""", "tickets")


def q_union_tagged(spark, sf):
    """H3 + C13 + H1: the same projection of every yearly table tagged by year -> tickets per year and code."""
    by_year = tickets_by_year(spark, sf)
    u = reshape.union_tagged(by_year, ["code", "state"], tag="year")
    return aggs.count_by(u, ["year", "code"])


SQL_UNION_TAGGED = with_ctes("SELECT y AS year, code, count(*) AS n FROM tickets GROUP BY y, code", "tickets")


def q_classify(spark, sf):
    """C5 + D10 + D12: issue month (parsed from MM/dd/yyyy text) -> season -> tickets per year and season."""
    u = tickets(spark, sf).withColumn("month", F.month(QF.parse_date("issue_date_text", "MM/dd/yyyy")))
    return aggs.count_by(clean.classify(u, "month", SEASONS, "season"), ["year", "season"])


SQL_CLASSIFY = with_ctes("""SELECT y AS year, CASE WHEN m IN (12, 1, 2) THEN 'Winter' WHEN m IN (3, 4, 5) THEN 'Spring'
 WHEN m IN (6, 7, 8) THEN 'Summer' WHEN m IN (9, 10, 11) THEN 'Fall' END AS season, count(*) AS n
FROM (SELECT y, month(strptime(issue_date_text, '%m/%d/%Y')) AS m FROM tickets)
GROUP BY 1, 2""", "tickets")


def q_weight_by(spark, sf):
    """E5 + G1: top 5 codes per year with their fine totals (count x fine, broadcast rate table)."""
    fines = literal_table(spark, FINES, "code string, fine double")
    top = rank.top_k_by(tickets(spark, sf), ["year"], "code", 5)
    return joins.weight_by(top, fines, "code", "fine", "n", "collected").drop("rank")


SQL_WEIGHT_BY = with_ctes("""SELECT year, c.code, n, n * fine AS collected FROM (
  SELECT y AS year, code, count(*) AS n, row_number() OVER (PARTITION BY y ORDER BY count(*) DESC, code) AS r
  FROM tickets GROUP BY y, code) c JOIN fines f ON c.code = f.code
WHERE r <= 5""", "tickets", "fines")


def q_distinct_values(spark, sf):
    """Distinct codes (first seen in the reference as the list of states)."""
    return profile.distinct_values(violations(spark, sf), "code")


SQL_DISTINCT_VALUES = with_ctes("SELECT DISTINCT code FROM violations", "violations")


def q_n_distinct(spark, sf):
    """Distinct time texts, NULL ignored (SQL) and NULL counted (R)."""
    v = violations(spark, sf)
    a = profile.n_distinct(v, "time_text").withColumnRenamed("n_distinct", "n_sql")
    b = profile.n_distinct(v, "time_text", count_null=True).select("n_distinct").scalar()
    return a.withColumn("n_with_null", b)


SQL_N_DISTINCT = with_ctes("""SELECT count(DISTINCT time_text) AS n_sql,
 count(DISTINCT time_text) + max(CAST(time_text IS NULL AS BIGINT)) AS n_with_null FROM violations""", "violations")


def q_append_rows(spark, sf):
    """H2: rows appended by column name when one input lacks columns (51 vs 43 in the reference):
    missing columns come in as NULL.  The first year has all columns, the later ones lack the precinct."""
    whole, first = tickets(spark, sf), tickets(spark, sf).agg(F.min("year")).scalar()
    full = whole.where(F.col("year") == first).select("ticket", "code", "state", "precinct")
    narrow = whole.where(F.col("year") != first).select("ticket", "code", "state")
    u = reshape.union_all([full, narrow], allow_missing=True)
    return u.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count("precinct").alias("with_precinct"))


SQL_APPEND_ROWS = with_ctes("""SELECT code, count(*) AS n, count(precinct) AS with_precinct FROM (
 SELECT ticket, code, state, precinct FROM tickets WHERE y = (SELECT min(y) FROM tickets)
 UNION ALL SELECT ticket, code, state, NULL FROM tickets WHERE y <> (SELECT min(y) FROM tickets)) GROUP BY code""", "tickets")


def study(spark, sf) -> dict:
    """The whole violation study, end to end: yearly tables stacked by name,
    state code recoded, NULL and length checks of the time text, 4-hour slots, top codes
    per slot, fines collected for the top codes, seasons, and top codes per season.
    Every report is one declarative plan; nothing is collected on the way."""
    fines = literal_table(spark, FINES, "code string, fine double")
    t = reshape.union_tagged(tickets_by_year(spark, sf), ["ticket", "code", "state", "issue_date_text", "precinct"], tag="year")
    t = clean.replace_value(t, "state", "NATION_24", "NATION_0")
    t = t.withColumn("month", F.month(QF.parse_date("issue_date_text", "MM/dd/yyyy")))
    t = clean.classify(t, "month", SEASONS, "season")
    v = violations(spark, sf)
    timed = timed_violations(v)
    top_year = rank.top_k_by(t, ["year"], "code", 5)
    return {
        "rows_per_year": aggs.count_by(t, ["year"]),
        "states": profile.n_distinct(t, "state"),
        "time_nulls": profile.null_counts(v, ["time_text"]),
        "time_lengths": profile.length_profile(v, "time_text"),
        "top_codes": rank.top_k(v, "code", 5),
        "top_precincts": rank.top_k(v, "precinct", 5, exclude=F.col("precinct") == 0),
        "top_codes_per_slot": rank.top_k_by(timed, ["slot"], "code", 3),
        "fines_top_codes": joins.weight_by(top_year, fines, "code", "fine", "n", "collected"),
        "season_counts": aggs.count_by(t, ["year", "season"]),
        "top_codes_per_season": rank.top_k_by(t, ["year", "season"], "code", 3),
    }


QUERIES = {
    "top_k_by_group": q_top_k_by_group, "top_k": q_top_k, "nth_by": q_nth_by, "count_by": q_count_by,
    "length_profile": q_length_profile, "drop_nulls": q_drop_nulls, "to_int": q_to_int,
    "bucketize": q_bucketize, "where": q_where, "replace_value": q_replace_value,
    "union_tagged": q_union_tagged, "classify": q_classify, "weight_by": q_weight_by,
    "distinct_values": q_distinct_values, "n_distinct": q_n_distinct, "append_rows": q_append_rows,
}
ORACLE = {
    "top_k_by_group": SQL_TOP_K_BY_GROUP, "top_k": SQL_TOP_K, "nth_by": SQL_NTH_BY, "count_by": SQL_COUNT_BY,
    "length_profile": SQL_LENGTH_PROFILE, "drop_nulls": SQL_DROP_NULLS, "to_int": SQL_TO_INT,
    "bucketize": SQL_BUCKETIZE, "where": SQL_WHERE, "replace_value": SQL_REPLACE_VALUE,
    "union_tagged": SQL_UNION_TAGGED, "classify": SQL_CLASSIFY, "weight_by": SQL_WEIGHT_BY,
    "distinct_values": SQL_DISTINCT_VALUES, "n_distinct": SQL_N_DISTINCT, "append_rows": SQL_APPEND_ROWS,
}
