"""Profiling and cleaning checks shared by the studies: NULL profiles, duplicates,
constant columns, summaries, exact percentiles, box-plot numbers, caps, recodes,
correlation matrices.  Bound to `lineitem` (with NULLs made by nullif) and `part` as cars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import functions as QF
from quarry import sources
from quarry.operators import aggs, clean, profile
from quarry.plans.tables import cars, holes, read, with_ctes

HOLE_COLS = ["l_orderkey", "l_linenumber", "discount", "returnflag", "tax", "empty", "constant",
             "constant_or_null", "l_quantity"]
# fixed values: percentile grid in 1 % steps, 0 % to 100 % inclusive (R quantile)
GRID = [i / 100 for i in range(101)]
# fixed values: spelling fixes of the first word of the car name, and body -> size number
NAME_FIXES = {"red": "crimson", "blue": "navy"}
BODY_SIZE = {"SMALL": 1, "MEDIUM": 2, "LARGE": 3}


def _union(parts):
    return " UNION ALL ".join(parts)


def q_shape(spark, sf):
    """B1: rows and columns."""
    return profile.shape(holes(spark, sf))


SQL_SHAPE = with_ctes(f"SELECT count(*) AS n_rows, CAST({len(HOLE_COLS)} AS BIGINT) AS n_cols FROM holes", "holes")


def q_null_counts(spark, sf):
    """B2: NULLs per column, one pass."""
    return profile.null_counts(holes(spark, sf))


SQL_NULL_COUNTS = with_ctes(_union(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM holes" for c in HOLE_COLS), "holes")


def q_null_total(spark, sf):
    """NULL cells of the whole table."""
    return profile.null_total(holes(spark, sf))


SQL_NULL_TOTAL = with_ctes("SELECT " + " + ".join(
    f"count(*) FILTER (WHERE {c} IS NULL)" for c in HOLE_COLS) + " AS nulls FROM holes", "holes")


def q_duplicate_count(spark, sf):
    """Surplus rows on (l_orderkey, l_linenumber) -- the key is not unique in lineitem."""
    return profile.duplicate_count(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


SQL_DUPLICATE_COUNT = """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (
 SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)"""


def q_null_profile_diff(spark, sf):
    """Columns whose NULL counts differ between the table and its line-7-free part."""
    h = holes(spark, sf)
    return profile.null_profile_diff(h, h.where(F.col("l_linenumber") != 7))


SQL_NULL_PROFILE_DIFF = with_ctes("""
, a AS (""" + _union(f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM holes"
                     for c in HOLE_COLS) + """)
, b AS (""" + _union(f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM holes "
                     f"WHERE l_linenumber <> 7" for c in HOLE_COLS) + """)
SELECT a.column, a.nulls AS nulls_a, b.nulls AS nulls_b FROM a JOIN b ON a.column = b.column
WHERE a.nulls <> b.nulls""", "holes")


def q_constant_columns(spark, sf):
    """NULLs per column and constant flag (NULL counts as a value)."""
    return profile.constant_columns(holes(spark, sf))


SQL_CONSTANT_COLUMNS = with_ctes(_union(
    f"SELECT '{c}' AS column, count(*) - count({c}) AS n_null, "
    f"count(DISTINCT {c}) + max(CAST({c} IS NULL AS BIGINT)) <= 1 AS is_constant FROM holes" for c in HOLE_COLS),
    "holes")


def q_drop_constant(spark, sf):
    """B15 applied: the table without its constant columns (column list decided by one aggregate)."""
    d = profile.drop_constant(holes(spark, sf))
    return d.groupBy("returnflag").agg(F.count(F.lit(1)).alias("n"), F.lit(len(d.columns)).cast("long").alias("n_cols"))


SQL_DROP_CONSTANT = with_ctes("""SELECT returnflag, count(*) AS n, CAST(7 AS BIGINT) AS n_cols FROM holes
GROUP BY returnflag""", "holes")


def q_all_null_columns(spark, sf):
    """Non-NULL values per column; all-NULL flag."""
    return profile.all_null_columns(holes(spark, sf))


SQL_ALL_NULL_COLUMNS = with_ctes(_union(
    f"SELECT '{c}' AS column, count({c}) AS non_null, count({c}) = 0 AS all_null FROM holes" for c in HOLE_COLS),
    "holes")


def q_drop_all_null(spark, sf):
    """B16 applied + C1: all-NULL column dropped, remaining width and NULL-free rows."""
    d = profile.drop_all_null(holes(spark, sf))
    return d.agg(F.lit(len(d.columns)).cast("long").alias("n_cols"),
                 F.count_if(F.col("discount").isNotNull()).cast("long").alias("with_discount"))


SQL_DROP_ALL_NULL = with_ctes("""SELECT CAST(8 AS BIGINT) AS n_cols,
 count(*) FILTER (WHERE discount IS NOT NULL) AS with_discount FROM holes""", "holes")


def q_describe(spark, sf):
    """Count, mean, sd, min, exact quartiles, max of two car columns."""
    d = profile.describe(cars(spark, sf), ["enginesize", "price"])
    return d.select("column", "count", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "min", "p25", "p50", "p75",
                                                                           "max")])


SQL_DESCRIBE = with_ctes(_union(
    f"""SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd,
 round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
 round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM cars""" for c in ("enginesize", "price")),
    "cars")


def q_percentile_grid(spark, sf):
    """Exact type-7 percentiles of the order value at 0 %, 1 %, ..., 100 %."""
    g = profile.percentile_grid(read(spark, sf, "orders"), "o_totalprice", GRID)
    return g.select(F.round("prob", 2).alias("prob"), F.round("value", 6).alias("value"))


SQL_PERCENTILE_GRID = "SELECT round(p, 2) AS prob, round(v, 6) AS value FROM (SELECT unnest(generate_series(0, 100)) " \
    "/ 100 AS p, unnest(quantile_cont(o_totalprice, [" + ", ".join(repr(p) for p in GRID) + \
    "])) AS v FROM orders)"


def _hinge_sql(table, col, by):
    return f"""
, hs AS (SELECT {by}, {col} AS x, row_number() OVER (PARTITION BY {by} ORDER BY {col}) AS k,
         count(*) OVER (PARTITION BY {by}) AS n FROM {table} WHERE {col} IS NOT NULL)
, hd AS (SELECT DISTINCT {by}, n, floor((n + 3) / 2) / 2 AS d FROM hs)
, h AS (SELECT hd.{by}, hd.n,
    (SELECT min(x) FROM hs WHERE hs.{by} = hd.{by}) AS min,
    ((SELECT x FROM hs WHERE hs.{by} = hd.{by} AND k = floor(d)) + (SELECT x FROM hs WHERE hs.{by} = hd.{by}
       AND k = ceil(d))) / 2 AS q1,
    ((SELECT x FROM hs WHERE hs.{by} = hd.{by} AND k = floor((n + 1) / 2)) + (SELECT x FROM hs WHERE hs.{by} = hd.{by}
       AND k = ceil((n + 1) / 2))) / 2 AS median,
    ((SELECT x FROM hs WHERE hs.{by} = hd.{by} AND k = floor(n + 1 - d)) + (SELECT x FROM hs WHERE hs.{by} = hd.{by}
       AND k = ceil(n + 1 - d))) / 2 AS q3,
    (SELECT max(x) FROM hs WHERE hs.{by} = hd.{by}) AS max FROM hd)
, f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM h)"""


BOX_NUMBERS = ("min", "q1", "median", "q3", "max", "iqr", "lower_fence", "upper_fence", "lower_whisker",
               "upper_whisker")


def _round_box(df):
    """Box numbers rounded to 6 places; keys and counts as they are."""
    return df.select(*[F.round(c, 6).alias(c) if c in BOX_NUMBERS else F.col(c) for c in df.columns])


BOX_COLS_SQL = """n, round(f.min, 6) AS min, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
 round(max, 6) AS max, round(iqr, 6) AS iqr, round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence"""


def q_box_stats(spark, sf):
    """B11 (hinge rule, R boxplot.stats): per event type box numbers of the event value."""
    b = profile.box_stats(read(spark, sf, "events"), "value", ["event_type"], rule="hinge")
    return _round_box(b)


SQL_BOX_STATS = "WITH ev AS (SELECT * FROM events)" + _hinge_sql("ev", "value", "event_type") + f"""
SELECT f.event_type, f.{BOX_COLS_SQL},
 round(min(x) FILTER (WHERE x >= lower_fence AND x <= upper_fence), 6) AS lower_whisker,
 round(max(x) FILTER (WHERE x >= lower_fence AND x <= upper_fence), 6) AS upper_whisker,
 count(*) FILTER (WHERE x < lower_fence OR x > upper_fence) AS n_outliers
FROM f JOIN hs ON f.event_type = hs.event_type
GROUP BY ALL"""


def q_box_stats_linear(spark, sf):
    """B11 (linear rule, pandas/seaborn quartiles): box numbers of the order value."""
    b = profile.box_stats(read(spark, sf, "orders"), "o_totalprice", rule="linear")
    return _round_box(b)


SQL_BOX_STATS_LINEAR = f"""WITH q AS (SELECT count(o_totalprice) AS n, min(o_totalprice) AS min,
 quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
 quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS max FROM orders)
, f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT {BOX_COLS_SQL},
 round(min(o_totalprice) FILTER (WHERE o_totalprice >= lower_fence AND o_totalprice <= upper_fence), 6) AS lower_whisker,
 round(max(o_totalprice) FILTER (WHERE o_totalprice >= lower_fence AND o_totalprice <= upper_fence), 6) AS upper_whisker,
 count(*) FILTER (WHERE o_totalprice < lower_fence OR o_totalprice > upper_fence) AS n_outliers
FROM f, orders GROUP BY ALL"""


def q_outliers(spark, sf):
    """The events outside their type's hinge fences."""
    ev = read(spark, sf, "events").select("event_id", "event_type", "value")
    return profile.outliers(ev, "value", ["event_type"], rule="hinge")


SQL_OUTLIERS = "WITH ev AS (SELECT * FROM events)" + _hinge_sql("ev", "value", "event_type") + """
SELECT ev.event_id, ev.event_type, ev.value FROM ev JOIN f ON ev.event_type = f.event_type
WHERE ev.value < f.lower_fence OR ev.value > f.upper_fence"""


def q_cap(spark, sf):
    """Tax capped to [0.01, 0.06] with NULL kept (not least/greatest)."""
    c = clean.cap(holes(spark, sf), {"tax": (0.01, 0.06)})
    return c.groupBy("tax").agg(F.count(F.lit(1)).alias("n"))


SQL_CAP = with_ctes("""SELECT CASE WHEN tax < 0.01 THEN 0.01 WHEN tax > 0.06 THEN 0.06 ELSE tax END AS tax,
 count(*) AS n FROM holes GROUP BY 1""", "holes")


def q_recode(spark, sf):
    """C3 + D6: make = first word of the name with spelling fixes kept-else; body size number with NULL-else."""
    c = cars(spark, sf).withColumn("make", QF.first_token("car_name", " "))
    c = clean.recode(c, "make", NAME_FIXES, default="keep")
    c = clean.recode(c, "carbody", BODY_SIZE, default="null", out="body_size", dtype="int")
    return aggs.count_by(c, ["make", "body_size"])


SQL_RECODE = with_ctes("""SELECT CASE split_part(car_name, ' ', 1) WHEN 'red' THEN 'crimson' WHEN 'blue' THEN 'navy'
 ELSE split_part(car_name, ' ', 1) END AS make,
 CASE carbody WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LARGE' THEN 3 END AS body_size, count(*) AS n
FROM cars GROUP BY 1, 2""", "cars")


def q_corr_matrix(spark, sf):
    """correlation matrix of the numeric car columns, long form."""
    m = aggs.corr_matrix(cars(spark, sf), ["car_id", "enginesize", "price"])
    return m.withColumn("r", F.round("r", 8))


SQL_CORR_MATRIX = with_ctes(_union(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM cars"
    for a in ("car_id", "enginesize", "price") for b in ("car_id", "enginesize", "price")), "cars")


def q_min_max(spark, sf):
    """F5 + B14: first and last ship date per line status, as ISO text."""
    m = aggs.min_max(read(spark, sf, "lineitem"), "l_shipdate", ["l_linestatus"])
    return m.select("l_linestatus", F.date_format("min", "yyyy-MM-dd").alias("min"),
                    F.date_format("max", "yyyy-MM-dd").alias("max"))


SQL_MIN_MAX = """SELECT l_linestatus, strftime(min(l_shipdate), '%Y-%m-%d') AS min,
 strftime(max(l_shipdate), '%Y-%m-%d') AS max FROM lineitem GROUP BY l_linestatus"""


def q_rename(spark, sf):
    """A9 + C1: rename some columns, drop one, keep an order of columns."""
    c = sources.rename(cars(spark, sf), {"carbody": "body", "enginesize": "engine_size"})
    return clean.keep(clean.drop(c, ["fuelsystem"]), ["car_id", "body", "engine_size", "price"])


SQL_RENAME = with_ctes("SELECT car_id, carbody AS body, enginesize AS engine_size, price FROM cars", "cars")


def q_take(spark, sf):
    """First 6 rows in a stated order (price descending, id)."""
    return sources.take(cars(spark, sf), 6, [F.col("price").desc(), F.col("car_id")])


SQL_TAKE = with_ctes("SELECT * FROM cars ORDER BY price DESC, car_id LIMIT 6", "cars")


def q_with_view(spark, sf):
    """Register a view and run SQL text over it."""
    sources.with_view(cars(spark, sf), "cars_view")
    return spark.sql("SELECT carbody, count(*) AS n, round(avg(price), 4) AS avg_price FROM cars_view GROUP BY carbody")


SQL_WITH_VIEW = with_ctes("SELECT carbody, count(*) AS n, round(avg(price), 4) AS avg_price FROM cars GROUP BY carbody",
                          "cars")


def q_read_table(spark, sf):
    """A1: the cars written as CSV with a header, read back with type inference."""
    path = sources.scratch_path(spark, "cars_csv")
    sources.write_csv(cars(spark, sf), path)
    back = sources.read_table(spark, path)
    return back.groupBy("carbody").agg(F.count(F.lit(1)).alias("n"), F.sum("enginesize").cast("long").alias("engine"),
                                       F.round(F.sum("price"), 2).alias("price"))


SQL_READ_TABLE = with_ctes("""SELECT carbody, count(*) AS n, CAST(sum(enginesize) AS BIGINT) AS engine,
 round(sum(price), 2) AS price FROM cars GROUP BY carbody""", "cars")


def q_read_tsv(spark, sf):
    """A2: tab-separated text with quotes, read back with a declared schema."""
    path = sources.scratch_path(spark, "companies_tsv")
    c = cars(spark, sf).select("car_id", "car_name", "price")
    c.write.option("header", True).option("sep", "\t").csv(path)
    back = sources.read_table(spark, path, schema="car_id long, car_name string, price double", sep="\t")
    return back.groupBy("car_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("price"))


SQL_READ_TSV = with_ctes("SELECT car_name, count(*) AS n, round(sum(price), 2) AS price FROM cars GROUP BY car_name",
                         "cars")


def q_sample_rows(spark, sf):
    """C14: exact 15 % simple random sample by a seeded hash of the key (reproducible; no SQL twin:
    the hash is Spark's)."""
    s = clean.sample_rows(read(spark, sf, "orders"), ["o_orderkey"], frac=0.15, seed=7)
    return s.select("o_orderkey", "o_orderstatus")


QUERIES = {
    "shape": q_shape, "null_counts": q_null_counts, "null_total": q_null_total, "duplicate_count": q_duplicate_count,
    "null_profile_diff": q_null_profile_diff, "constant_columns": q_constant_columns, "drop_constant": q_drop_constant,
    "all_null_columns": q_all_null_columns, "drop_all_null": q_drop_all_null, "describe": q_describe,
    "percentile_grid": q_percentile_grid, "box_stats": q_box_stats, "box_stats_linear": q_box_stats_linear,
    "outliers": q_outliers, "cap": q_cap, "recode": q_recode, "corr_matrix": q_corr_matrix, "min_max": q_min_max,
    "rename": q_rename, "take": q_take, "with_view": q_with_view, "read_table": q_read_table, "read_tsv": q_read_tsv,
    "sample_rows": q_sample_rows,
}
ORACLE = {
    "shape": SQL_SHAPE, "null_counts": SQL_NULL_COUNTS, "null_total": SQL_NULL_TOTAL,
    "duplicate_count": SQL_DUPLICATE_COUNT, "null_profile_diff": SQL_NULL_PROFILE_DIFF,
    "constant_columns": SQL_CONSTANT_COLUMNS, "drop_constant": SQL_DROP_CONSTANT,
    "all_null_columns": SQL_ALL_NULL_COLUMNS, "drop_all_null": SQL_DROP_ALL_NULL, "describe": SQL_DESCRIBE,
    "percentile_grid": SQL_PERCENTILE_GRID, "box_stats": SQL_BOX_STATS, "box_stats_linear": SQL_BOX_STATS_LINEAR,
    "outliers": SQL_OUTLIERS, "cap": SQL_CAP, "recode": SQL_RECODE, "corr_matrix": SQL_CORR_MATRIX,
    "min_max": SQL_MIN_MAX, "rename": SQL_RENAME, "take": SQL_TAKE, "with_view": SQL_WITH_VIEW,
    "read_table": SQL_READ_TABLE, "read_tsv": SQL_READ_TSV,
}
