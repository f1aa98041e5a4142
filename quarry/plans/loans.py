"""Loan default EDA (R in the reference): text cleaning, means and counts above them,
cross-tabs and compositions by status.  Bound to `orders` x `customer`; dates from `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import functions as QF
from quarry.operators import aggs
from quarry.plans.tables import loans, read, with_ctes


def q_parse_suffixed(spark, sf):
    """D3: '10.5%' -> 10.5, average rate per grade."""
    l = loans(spark, sf).withColumn("rate", QF.parse_suffixed("int_rate", "%"))
    return l.groupBy("grade").agg(F.round(F.avg("rate"), 6).alias("avg_rate"))


SQL_PARSE_SUFFIXED = with_ctes("""SELECT grade, round(avg(TRY_CAST(substring(int_rate, 1, length(int_rate) - 1)
 AS DOUBLE)), 6) AS avg_rate FROM loans GROUP BY grade""", "loans")


def q_substring(spark, sf):
    """Term months from ' 36 months' (characters 2-3), loans per term."""
    l = loans(spark, sf).withColumn("term_months", QF.to_int(F.substring("term", 2, 2)))
    return aggs.count_by(l, ["term_months"])


SQL_SUBSTRING = with_ctes("""SELECT TRY_CAST(substring(term, 2, 2) AS INTEGER) AS term_months, count(*) AS n
FROM loans GROUP BY 1""", "loans")


def q_count_above_mean(spark, sf):
    """mean (rounded half-even to 2 digits) and loans above it, for three columns."""
    l = loans(spark, sf).withColumn("rate", QF.parse_suffixed("int_rate", "%"))
    return aggs.count_above_mean(l, ["loan_amnt", "annual_inc", "rate"], digits=2)


SQL_COUNT_ABOVE_MEAN = with_ctes("""
, l AS (SELECT loan_amnt, annual_inc, TRY_CAST(substring(int_rate, 1, length(int_rate) - 1) AS DOUBLE) AS rate
        FROM loans)
, m AS (SELECT round_even(avg(loan_amnt), 2) AS a, round_even(avg(annual_inc), 2) AS b,
               round_even(avg(rate), 2) AS c FROM l)
SELECT 'loan_amnt' AS column, m.a AS mean, (SELECT count(*) FROM l WHERE loan_amnt > m.a) AS above FROM m
UNION ALL SELECT 'annual_inc', m.b, (SELECT count(*) FROM l WHERE annual_inc > m.b) FROM m
UNION ALL SELECT 'rate', m.c, (SELECT count(*) FROM l WHERE rate > m.c) FROM m""", "loans")


def q_crosstab(spark, sf):
    """loans by grade x status x home ownership (the data behind a faceted bar chart)."""
    return aggs.crosstab(loans(spark, sf), "grade", "loan_status", facet="home_ownership")


SQL_CROSSTAB = with_ctes("""SELECT grade, loan_status, home_ownership, count(*) AS n FROM loans
GROUP BY grade, loan_status, home_ownership""", "loans")


def q_crosstab_wide(spark, sf):
    """F13 matrix form: one column per status."""
    return aggs.crosstab(loans(spark, sf), "grade", "loan_status", wide=True)


SQL_CROSSTAB_WIDE = with_ctes("""SELECT grade, count(*) FILTER (WHERE loan_status = 'F') AS F,
 count(*) FILTER (WHERE loan_status = 'O') AS O, count(*) FILTER (WHERE loan_status = 'P') AS P
FROM loans GROUP BY grade""", "loans")


def q_composition(spark, sf):
    """share of each status within each grade."""
    return aggs.composition(loans(spark, sf), "grade", "loan_status").withColumn("share", F.round("share", 8))


SQL_COMPOSITION = with_ctes("""SELECT grade, loan_status, n, round(n / sum(n) OVER (PARTITION BY grade), 8) AS share
FROM (SELECT grade, loan_status, count(*) AS n FROM loans GROUP BY grade, loan_status)""", "loans")


def q_histogram(spark, sf):
    """F16: 30 equal-width bins of the loan amount, min to max."""
    h = aggs.histogram(loans(spark, sf), "loan_amnt", 30)
    return h.withColumn("lo", F.round("lo", 4)).withColumn("hi", F.round("hi", 4))


SQL_HISTOGRAM = with_ctes("""
, r AS (SELECT min(loan_amnt) AS lo, max(loan_amnt) AS hi FROM loans)
, b AS (SELECT CAST(least(floor((loan_amnt - r.lo) / ((r.hi - r.lo) / 30)) + 1, 30) AS BIGINT) AS bin, count(*) AS n
        FROM loans, r GROUP BY 1)
SELECT g.bin, round(lo + (g.bin - 1) * (hi - lo) / 30, 4) AS lo, round(lo + g.bin * (hi - lo) / 30, 4) AS hi,
 coalesce(b.n, 0) AS n
FROM (SELECT unnest(range(1, 31)) AS bin) g CROSS JOIN r LEFT JOIN b ON b.bin = g.bin""", "loans")


def q_regression_line(spark, sf):
    """least-squares line of loan amount on income."""
    r = aggs.regression_line(loans(spark, sf), "loan_amnt", "annual_inc")
    return r.select(F.round("slope", 8).alias("slope"), F.round("intercept", 4).alias("intercept"),
                    F.round("r2", 10).alias("r2"), "n")


SQL_REGRESSION_LINE = with_ctes("""SELECT round(regr_slope(loan_amnt, annual_inc), 8) AS slope,
 round(regr_intercept(loan_amnt, annual_inc), 4) AS intercept, round(regr_r2(loan_amnt, annual_inc), 10) AS r2,
 regr_count(loan_amnt, annual_inc) AS n FROM loans""", "loans")


def q_round_even(spark, sf):
    """Amounts rounded half to even (x.50 goes to the even neighbour)."""
    l = loans(spark, sf)
    return l.select("loan_id", QF.round_even("loan_amnt", 0).alias("amount_rounded"))


SQL_ROUND_EVEN = with_ctes("SELECT loan_id, round_even(loan_amnt, 0) AS amount_rounded FROM loans", "loans")


def q_ratio(spark, sf):
    """D9 + D8: loan-to-income percentage (NULL on zero income), rounded half-even, mean per ownership."""
    l = loans(spark, sf).withColumn("pct", QF.round_even(QF.ratio("loan_amnt", "annual_inc", pct=True), 0))
    return l.groupBy("home_ownership").agg(F.round(F.avg("pct"), 4).alias("avg_pct"),
                                           F.count("pct").alias("n"))


SQL_RATIO = with_ctes("""SELECT home_ownership, round(avg(p), 4) AS avg_pct, count(p) AS n FROM (
 SELECT home_ownership, round_even(loan_amnt / nullif(annual_inc, 0) * 100, 0) AS p FROM loans)
GROUP BY home_ownership""", "loans")


def q_mean_by_pair(spark, sf):
    """mean rate by grade and status (the data behind a dodged bar chart)."""
    l = loans(spark, sf).withColumn("rate", QF.parse_suffixed("int_rate", "%"))
    return aggs.mean_by(l, ["grade", "loan_status"], {"avg_rate": "rate"}).withColumn("avg_rate", F.round("avg_rate", 6))


SQL_MEAN_BY_PAIR = with_ctes("""SELECT grade, loan_status,
 round(avg(TRY_CAST(substring(int_rate, 1, length(int_rate) - 1) AS DOUBLE)), 6) AS avg_rate
FROM loans GROUP BY grade, loan_status""", "loans")


def q_date_label(spark, sf):
    """D7 + D12: 'year-Qn' issue labels, loans per label."""
    l = loans(spark, sf)
    lab = F.concat_ws("-", F.year("issue_d").cast("string"), F.concat(F.lit("Q"), F.quarter("issue_d").cast("string")))
    return aggs.count_by(l.withColumn("issue_label", lab), ["issue_label"])


SQL_DATE_LABEL = with_ctes("""SELECT CAST(year(issue_d) AS VARCHAR) || '-Q' || CAST(quarter(issue_d) AS VARCHAR)
 AS issue_label, count(*) AS n FROM loans GROUP BY 1""", "loans")


def q_parse_date(spark, sf):
    """D10: 'dd-MMM-yy' text (two-digit year) parsed back; events per parsed month."""
    e = read(spark, sf, "events").select(F.date_format("ts", "dd-MMM-yy").alias("issue_text"))
    p = e.withColumn("issued", QF.parse_date("issue_text", "dd-MMM-yy"))
    return p.groupBy(F.year("issued").alias("year"), F.month("issued").alias("month"),
                     F.dayofmonth("issued").alias("day")).agg(F.count(F.lit(1)).alias("n"))


SQL_PARSE_DATE = """SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
 CAST(day(d) AS INTEGER) AS day, count(*) AS n
FROM (SELECT strptime(strftime(ts, '%d-%b-%y'), '%d-%b-%y') AS d FROM events) GROUP BY 1, 2, 3"""


QUERIES = {
    "parse_suffixed": q_parse_suffixed, "substring": q_substring, "count_above_mean": q_count_above_mean,
    "crosstab": q_crosstab, "crosstab_wide": q_crosstab_wide, "composition": q_composition,
    "histogram": q_histogram, "regression_line": q_regression_line, "round_even": q_round_even,
    "ratio": q_ratio, "mean_by_pair": q_mean_by_pair, "date_label": q_date_label, "parse_date": q_parse_date,
}
ORACLE = {
    "parse_suffixed": SQL_PARSE_SUFFIXED, "substring": SQL_SUBSTRING, "count_above_mean": SQL_COUNT_ABOVE_MEAN,
    "crosstab": SQL_CROSSTAB, "crosstab_wide": SQL_CROSSTAB_WIDE, "composition": SQL_COMPOSITION,
    "histogram": SQL_HISTOGRAM, "regression_line": SQL_REGRESSION_LINE, "round_even": SQL_ROUND_EVEN,
    "ratio": SQL_RATIO, "mean_by_pair": SQL_MEAN_BY_PAIR, "date_label": SQL_DATE_LABEL, "parse_date": SQL_PARSE_DATE,
}
