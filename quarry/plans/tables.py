"""Bindings of the reference's data families to the driver tables (FIXTURES.md §2).

Each family has a Spark side (a DataFrame built from the parquet tables) and a
DuckDB side (the same rows as a SQL common table expression), so every query
in :mod:`quarry.plans` can be checked against an independent engine.  All
derived values are deterministic functions of columns (no rand, no clock).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_ctes(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named binding CTEs (in dependency order)."""
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in names) + "\n" + sql


CTE: dict[str, str] = {}

# --------------------------------------------------------------------------
# violations: events as parking tickets
# code = event_type, precinct = user_id % 25 (0 = erroneous), time text hhmm + A/P


def violations(spark, sf):
    e = read(spark, sf, "events")
    hhmm = F.concat(F.date_format("ts", "hhmm"), F.when(F.hour("ts") < 12, F.lit("A")).otherwise(F.lit("P")))
    t = (F.when(F.col("event_id") % 97 == 0, F.lit("9930P"))
         .when(F.col("event_id") % 89 == 0, F.lit("xx30A"))
         .when(F.col("event_id") % 83 == 0, F.lit(None).cast("string"))
         .otherwise(hhmm))
    return e.select("event_id", F.col("event_type").alias("code"), (F.col("user_id") % 25).alias("precinct"),
                    t.alias("time_text"), F.date_format("ts", "MM/dd/yyyy").alias("issue_date_text"),
                    "ts", "user_id", "value")


CTE["violations"] = """
SELECT event_id, event_type AS code, user_id % 25 AS precinct,
       CASE WHEN event_id % 97 = 0 THEN '9930P'
            WHEN event_id % 89 = 0 THEN 'xx30A'
            WHEN event_id % 83 = 0 THEN NULL
            ELSE strftime(ts, '%I%M') || CASE WHEN hour(ts) < 12 THEN 'A' ELSE 'P' END END AS time_text,
       strftime(ts, '%m/%d/%Y') AS issue_date_text, ts, user_id, value
FROM events"""

# violations by year: orders x customer x nation


def tickets(spark, sf):
    """All tickets with their year."""
    o, c, n = read(spark, sf, "orders"), read(spark, sf, "customer"), read(spark, sf, "nation")
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .select(F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("ticket"),
                    F.col("o_orderpriority").alias("code"), F.col("n_name").alias("state"),
                    F.date_format("o_orderdate", "MM/dd/yyyy").alias("issue_date_text"),
                    (F.col("o_custkey") % 25).alias("precinct"), F.col("o_totalprice").alias("amount")))


def tickets_by_year(spark, sf) -> dict:
    """One table for each year that the orders hold (the reference's yearly files)."""
    years = [r[0] for r in read(spark, sf, "orders").select(F.year("o_orderdate")).distinct().collect()]
    whole = tickets(spark, sf)
    return {y: whole.where(F.col("year").eqNullSafe(F.lit(y))).drop("year") for y in sorted(years, key=str)}


CTE["tickets"] = """
SELECT year(o_orderdate) AS y, o_orderkey AS ticket, o_orderpriority AS code, n_name AS state,
       strftime(o_orderdate, '%m/%d/%Y') AS issue_date_text, o_custkey % 25 AS precinct, o_totalprice AS amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

# fixed values: fine per violation code (priority), in currency units
FINES = [("1-URGENT", 115.0), ("2-HIGH", 115.0), ("3-MEDIUM", 60.0), ("4-NOT SPECIFIED", 55.0), ("5-LOW", 45.0)]
CTE["fines"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in FINES) + ") AS t(code, fine)"

# --------------------------------------------------------------------------
# trips: lineitem x orders as taxi trips


def trips(spark, sf):
    li, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("l_orderkey").alias("trip_order"), F.col("l_linenumber").alias("line"),
        F.col("l_linestatus").alias("vendor"), F.col("o_orderdate").alias("pickup"),
        F.col("l_shipdate").alias("dropoff"), F.col("l_linenumber").alias("passengers"),
        F.col("l_quantity").alias("distance"), F.col("l_extendedprice").alias("fare"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("tip"), F.col("l_returnflag").alias("payment"),
        F.col("l_tax").alias("extra"), F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mnth"))


CTE["trips"] = """
SELECT l_orderkey AS trip_order, l_linenumber AS line, l_linestatus AS vendor, o_orderdate AS pickup,
       l_shipdate AS dropoff, l_linenumber AS passengers, l_quantity AS distance, l_extendedprice AS fare,
       l_extendedprice * l_discount AS tip, l_returnflag AS payment, l_tax AS extra,
       CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mnth
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

# --------------------------------------------------------------------------
# funding: rounds (lineitem x part x supplier x nation) and companies (part)


def rounds(spark, sf):
    li, p = read(spark, sf, "lineitem"), read(spark, sf, "part")
    s, n = read(spark, sf, "supplier"), read(spark, sf, "nation")
    j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey) \
        .join(n, s.s_nationkey == n.n_nationkey)
    return j.select(
        F.concat(F.lit("/Org/"), F.col("p_partkey").cast("string")).alias("company_permalink"),
        F.col("l_returnflag").alias("round_type"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double")).otherwise(F.col("l_extendedprice"))
        .alias("raised_amount"),
        F.when(F.col("n_nationkey") == 0, F.lit("")).otherwise(F.col("n_name")).alias("country_code"),
        F.col("l_orderkey").alias("round_order"), F.col("l_linenumber").alias("round_line"))


CTE["rounds"] = """
SELECT '/Org/' || CAST(p_partkey AS VARCHAR) AS company_permalink, l_returnflag AS round_type,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS raised_amount,
       CASE WHEN n_nationkey = 0 THEN '' ELSE n_name END AS country_code,
       l_orderkey AS round_order, l_linenumber AS round_line
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
     JOIN nation ON s_nationkey = n_nationkey"""


def companies(spark, sf):
    p = read(spark, sf, "part")
    return p.select(
        F.concat(F.lit("/ORG/"), F.col("p_partkey").cast("string")).alias("permalink"),
        F.col("p_name").alias("name"), F.regexp_replace("p_name", " ", "|").alias("category_list"),
        F.col("p_brand").alias("brand"))


CTE["companies"] = """
SELECT '/ORG/' || CAST(p_partkey AS VARCHAR) AS permalink, p_name AS name,
       replace(p_name, ' ', '|') AS category_list, p_brand AS brand
FROM part"""

# fixed values: first word of a category list -> main sector
SECTORS = [("red", "Colour"), ("blue", "Colour"), ("hot", "Climate"), ("cold", "Climate"),
           ("small", "Size"), ("large", "Size"), ("old", "Age"), ("new", "Age")]
CTE["sectors"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SECTORS) + \
    ") AS t(first_word, sector)"
FLAG_WORDS = [w for w, _ in SECTORS]


def category_flags(spark, sf):
    """Wide 0/1 matrix derived from the data: one row per part, one flag column per first word."""
    p = read(spark, sf, "part")
    first = F.substring_index("p_name", " ", 1)
    return p.select(F.col("p_partkey").alias("part"),
                    F.when(F.col("p_partkey") % 50 == 0, F.lit("")).otherwise(F.col("p_name")).alias("category_list"),
                    *[(first == F.lit(w)).cast("int").alias(w) for w in FLAG_WORDS])


CTE["category_flags"] = "SELECT p_partkey AS part, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_name END " \
    "AS category_list, " + ", ".join(
        f"CAST(split_part(p_name, ' ', 1) = '{w}' AS INTEGER) AS {w}" for w in FLAG_WORDS) + " FROM part"

# --------------------------------------------------------------------------
# loans: orders x customer


def loans(spark, sf):
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(
        F.col("o_orderkey").alias("loan_id"), F.col("o_totalprice").alias("loan_amnt"),
        F.col("o_orderstatus").alias("loan_status"), F.col("o_orderpriority").alias("grade"),
        F.abs("c_acctbal").alias("annual_inc"), F.col("c_nationkey").alias("addr_state"),
        F.col("c_mktsegment").alias("home_ownership"),
        F.concat((F.col("o_orderkey") % 20).cast("string"), F.lit(".5%")).alias("int_rate"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit(" 36 months")).otherwise(F.lit(" 60 months")).alias("term"),
        F.col("o_orderdate").alias("issue_d"))


CTE["loans"] = """
SELECT o_orderkey AS loan_id, o_totalprice AS loan_amnt, o_orderstatus AS loan_status, o_orderpriority AS grade,
       abs(c_acctbal) AS annual_inc, c_nationkey AS addr_state, c_mktsegment AS home_ownership,
       CAST(o_orderkey % 20 AS VARCHAR) || '.5%' AS int_rate,
       CASE WHEN o_orderkey % 2 = 0 THEN ' 36 months' ELSE ' 60 months' END AS term,
       o_orderdate AS issue_d
FROM orders JOIN customer ON o_custkey = c_custkey"""

# --------------------------------------------------------------------------
# rides: events as ride requests


# fixed values: status texts, pickup points and the two time formats of the ride data
def rides(spark, sf):
    e = read(spark, sf, "events")
    status = (F.when(F.col("event_type") == "purchase", F.lit("Trip Completed"))
              .when(F.col("event_type") == "error", F.lit("Cancelled")).otherwise(F.lit("No Cars Available")))
    req = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "d-M-yyyy HH:mm:ss")) \
        .otherwise(F.date_format("ts", "d/M/yyyy HH:mm"))
    drop_ts = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.round(F.col("value")).cast("int"))
    drop = F.when(F.col("event_type") == "purchase", F.date_format(drop_ts, "d-M-yyyy HH:mm:ss"))
    return e.select(F.col("event_id").alias("request_id"),
                    F.when(F.col("user_id") % 2 == 0, F.lit("City")).otherwise(F.lit("Airport")).alias("pickup_point"),
                    status.alias("status"), req.alias("request_ts"), drop.alias("drop_ts"),
                    F.when(F.col("event_type") == "click", F.lit(None).cast("long"))
                    .otherwise(F.col("user_id")).alias("driver_id"))


CTE["rides"] = """
SELECT event_id AS request_id, CASE WHEN user_id % 2 = 0 THEN 'City' ELSE 'Airport' END AS pickup_point,
       CASE event_type WHEN 'purchase' THEN 'Trip Completed' WHEN 'error' THEN 'Cancelled'
            ELSE 'No Cars Available' END AS status,
       CASE WHEN event_id % 2 = 0
            THEN strftime(ts, '%-d-%-m-%Y %H:%M:%S') ELSE strftime(ts, '%-d/%-m/%Y %H:%M') END AS request_ts,
       CASE WHEN event_type = 'purchase'
            THEN strftime(ts + to_minutes(CAST(round(value) AS INTEGER)), '%-d-%-m-%Y %H:%M:%S') END AS drop_ts,
       CASE WHEN event_type = 'click' THEN NULL ELSE user_id END AS driver_id
FROM events"""

# --------------------------------------------------------------------------
# scores: orders with a label and a deterministic score column


def scores(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
                    ((F.col("o_orderkey") * 7919 % 1000).cast("double") / F.lit(1000.0)).alias("score"),
                    F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("amount"),
                    F.col("o_orderdate").alias("ordered"))


CTE["scores"] = """
SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS label,
       CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 1000.0 AS score, o_orderpriority AS priority,
       o_totalprice AS amount, o_orderdate AS ordered
FROM orders"""

# --------------------------------------------------------------------------
# holes: lineitem with NULLs made by nullif (the test tables hold none)


def holes(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.when(F.col("l_discount") != 0.0, F.col("l_discount")).alias("discount"),
                     F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("returnflag"),
                     F.when(F.col("l_tax") != 0.08, F.col("l_tax")).alias("tax"),
                     F.lit(None).cast("double").alias("empty"), F.lit("x").alias("constant"),
                     F.when(F.col("l_linenumber") != 7, F.lit("y")).alias("constant_or_null"),
                     "l_quantity")


CTE["holes"] = """
SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.0) AS discount, nullif(l_returnflag, 'N') AS returnflag,
       nullif(l_tax, 0.08) AS tax, CAST(NULL AS DOUBLE) AS empty, 'x' AS constant,
       CASE WHEN l_linenumber <> 7 THEN 'y' END AS constant_or_null, l_quantity
FROM lineitem"""

# --------------------------------------------------------------------------
# sales: monthly market x segment series from orders x customer x nation x region


def sales_lines(spark, sf):
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey) \
        .join(r, n.n_regionkey == r.r_regionkey)
    return j.select(
        F.col("r_name").alias("market"), F.col("c_mktsegment").alias("segment"),
        F.col("o_orderdate").alias("order_date"), F.col("o_totalprice").alias("sales"))


CTE["sales_lines"] = """
SELECT r_name AS market, c_mktsegment AS segment, o_orderdate AS order_date, o_totalprice AS sales
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey"""

# --------------------------------------------------------------------------
# cars: part as cars


def cars(spark, sf):
    p = read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("car_id"), F.col("p_name").alias("car_name"),
                    F.col("p_type").alias("carbody"), F.col("p_brand").alias("fuelsystem"),
                    F.col("p_size").alias("enginesize"), F.col("p_retailprice").alias("price"))


CTE["cars"] = """
SELECT p_partkey AS car_id, p_name AS car_name, p_type AS carbody, p_brand AS fuelsystem,
       p_size AS enginesize, p_retailprice AS price FROM part"""
