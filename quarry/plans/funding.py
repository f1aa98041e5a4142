"""Investment study (R dplyr in the reference): rounds x companies, sector mapping,
ranking of countries and companies.  Bound to `lineitem` x `part` x `supplier` x `nation`."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import functions as QF
from quarry.operators import aggs, clean, joins, profile, rank, reshape
from quarry.plans.tables import FLAG_WORDS, SECTORS, category_flags, companies, rounds, with_ctes
from quarry.session import literal_table

# fixed values: investment range of interest (inclusive), in amount units of the bound data
RANGE_LO, RANGE_HI = 20000, 60000


def _keyed_rounds(spark, sf):
    r = rounds(spark, sf)
    return r.withColumn("company_key", F.lower("company_permalink"))


def _keyed_companies(spark, sf):
    return companies(spark, sf).withColumn("company_key", F.lower("permalink"))


def master(spark, sf):
    """E1 + D5: rounds joined to companies on lower-cased permalinks (differently named keys)."""
    c = _keyed_companies(spark, sf).withColumnRenamed("company_key", "ckey")
    return joins.join_on(_keyed_rounds(spark, sf), c, "company_key", "ckey")


MASTER_SQL = """
, master AS (SELECT r.*, lower(r.company_permalink) AS company_key, c.permalink, c.name, c.category_list, c.brand
             FROM rounds r JOIN companies c ON lower(r.company_permalink) = lower(c.permalink))"""


def q_join_on(spark, sf):
    """Joined rounds per country and round type, with the amount raised."""
    m = master(spark, sf)
    return m.groupBy("country_code", "round_type").agg(F.count(F.lit(1)).alias("n"),
                                                       F.round(F.sum("raised_amount"), 2).alias("raised"))


SQL_JOIN_ON = with_ctes(MASTER_SQL + """
SELECT country_code, round_type, count(*) AS n, round(sum(raised_amount), 2) AS raised FROM master
GROUP BY country_code, round_type""", "rounds", "companies")


def _known(spark, sf):
    """A company table with gaps, for the membership test: ids ending in 3 are unknown."""
    return _keyed_companies(spark, sf).where(~F.col("permalink").like("%3"))


def q_missing_keys(spark, sf):
    """Companies in rounds that are missing from the company table, and their count."""
    return joins.missing_keys(_keyed_rounds(spark, sf), _known(spark, sf), "company_key")


SQL_MISSING_KEYS = with_ctes("""SELECT DISTINCT lower(company_permalink) AS company_key FROM rounds
WHERE lower(company_permalink) NOT IN (SELECT lower(permalink) FROM companies WHERE permalink NOT LIKE '%3')""", "rounds", "companies")


def q_present_keys(spark, sf):
    """Rounds whose company is known (semi join), per round type."""
    p = joins.present_keys(_keyed_rounds(spark, sf), _known(spark, sf), "company_key")
    return aggs.count_by(p, ["round_type"])


SQL_PRESENT_KEYS = with_ctes("""SELECT round_type, count(*) AS n FROM rounds
WHERE lower(company_permalink) IN (SELECT lower(permalink) FROM companies WHERE permalink NOT LIKE '%3') GROUP BY round_type""",
                             "rounds", "companies")


def q_is_key(spark, sf):
    """Is the lower-cased permalink a key of the company table?"""
    return profile.is_key(_keyed_companies(spark, sf), ["company_key"])


SQL_IS_KEY = with_ctes("""SELECT count(*) AS rows, count(DISTINCT lower(permalink)) AS distinct_keys,
 count(*) = count(DISTINCT lower(permalink)) AS is_key FROM companies""", "companies")


def q_fill_null(spark, sf):
    """Missing amounts filled with 0, then the total per round type."""
    r = clean.fill_null(rounds(spark, sf), {"raised_amount": 0.0})
    return r.groupBy("round_type").agg(F.round(F.sum("raised_amount"), 2).alias("raised"),
                                       F.count_if(F.col("raised_amount") == 0).alias("zeros"))


SQL_FILL_NULL = with_ctes("""SELECT round_type, round(sum(coalesce(raised_amount, 0.0)), 2) AS raised,
 count(*) FILTER (WHERE coalesce(raised_amount, 0.0) = 0) AS zeros FROM rounds GROUP BY round_type""", "rounds")


def q_drop_blank(spark, sf):
    """C11: rounds without a country dropped, per country."""
    return aggs.count_by(clean.drop_blank(rounds(spark, sf), ["country_code"]), ["country_code"])


SQL_DROP_BLANK = with_ctes("""SELECT country_code, count(*) AS n FROM rounds WHERE trim(country_code) <> ''
GROUP BY country_code""", "rounds")


def q_mean_by_type(spark, sf):
    """mean amount per round type (NULL amounts skipped), ranked."""
    m = aggs.mean_by(rounds(spark, sf), ["round_type"], {"avg_raised": "raised_amount"})
    return m.withColumn("avg_raised", F.round("avg_raised", 4))


SQL_MEAN_BY_TYPE = with_ctes("""SELECT round_type, round(avg(raised_amount), 4) AS avg_raised FROM rounds
GROUP BY round_type""", "rounds")


def q_sum_by(spark, sf):
    """F3 + C6 range: total raised per country and type inside the investment range."""
    r = rounds(spark, sf).where(F.col("raised_amount").between(RANGE_LO, RANGE_HI))
    s = aggs.sum_by(r, ["country_code", "round_type"], {"raised": "raised_amount"})
    return s.withColumn("raised", F.round("raised", 2))


SQL_SUM_BY = with_ctes(f"""SELECT country_code, round_type, round(sum(raised_amount), 2) AS raised FROM rounds
WHERE raised_amount BETWEEN {RANGE_LO} AND {RANGE_HI} GROUP BY country_code, round_type""", "rounds")


def q_top_k_sum(spark, sf):
    """G1 (measure = sum, Q21): top 9 countries by amount raised, blank countries excluded."""
    r = clean.drop_blank(rounds(spark, sf), ["country_code"])
    t = rank.top_k(r, "country_code", 9, measure="raised_amount", out="raised")
    return t.withColumn("raised", F.round("raised", 2))


SQL_TOP_K_SUM = with_ctes("""SELECT country_code, round(sum(raised_amount), 2) AS raised FROM rounds
WHERE trim(country_code) <> '' GROUP BY country_code ORDER BY sum(raised_amount) DESC, country_code LIMIT 9""",
                          "rounds")


def q_unpivot_flags(spark, sf):
    """Wide 0/1 category matrix -> long (part, category) for non-zero cells, blank keys dropped."""
    return reshape.unpivot_flags(category_flags(spark, sf), ["part", "category_list"], FLAG_WORDS)


SQL_UNPIVOT_FLAGS = with_ctes("""SELECT part, category_list, category FROM (
 UNPIVOT category_flags ON """ + ", ".join(FLAG_WORDS) + """ INTO NAME category VALUE v)
WHERE v <> 0 AND trim(category_list) <> ''""", "category_flags")


def sector_rounds(spark, sf):
    """Main sector of each joined round from the first category (unmapped dropped)."""
    mapping = literal_table(spark, SECTORS, "first_word string, sector string")
    return joins.map_category(master(spark, sf), "category_list", mapping, "first_word", "sector", "sector")


SECTOR_SQL = MASTER_SQL + """
, sector_rounds AS (SELECT m.*, s.sector FROM master m JOIN sectors s
                    ON lower(split_part(m.category_list, '|', 1)) = lower(s.first_word))"""


def q_map_category(spark, sf):
    """E6 + D6: rounds and amount per main sector and country."""
    s = sector_rounds(spark, sf)
    return s.groupBy("sector", "country_code").agg(F.count(F.lit(1)).alias("n"),
                                                   F.round(F.sum("raised_amount"), 2).alias("raised"))


SQL_MAP_CATEGORY = with_ctes(SECTOR_SQL + """
SELECT sector, country_code, count(*) AS n, round(sum(raised_amount), 2) AS raised FROM sector_rounds
GROUP BY sector, country_code""", "rounds", "companies", "sectors")


def q_lookup(spark, sf):
    """E4 + G1 per group: the company with most rounds in each sector, its name looked up."""
    s = sector_rounds(spark, sf)
    top = rank.top_k_by(s, ["sector"], "company_key", 1).drop("rank")
    names = _keyed_companies(spark, sf).select("company_key", "name")
    return joins.lookup(top, names, "company_key", ["name"])


SQL_LOOKUP = with_ctes(SECTOR_SQL + """
, c AS (SELECT sector, company_key, count(*) AS n,
        row_number() OVER (PARTITION BY sector ORDER BY count(*) DESC, company_key) AS r
        FROM sector_rounds GROUP BY sector, company_key)
SELECT c.sector, c.company_key, c.n, k.name FROM c LEFT JOIN companies k ON c.company_key = lower(k.permalink)
WHERE r = 1""", "rounds", "companies", "sectors")


def q_nth_by_sum(spark, sf):
    """G3 (measure = sum): the third-ranked sector by amount raised in each country."""
    s = clean.drop_blank(sector_rounds(spark, sf), ["country_code"])
    t = rank.nth_by(s, ["country_code"], "sector", 3, measure="raised_amount", out="raised")
    return t.withColumn("raised", F.round("raised", 2))


SQL_NTH_BY_SUM = with_ctes(SECTOR_SQL + """
SELECT country_code, sector, round(raised, 2) AS raised FROM (
 SELECT country_code, sector, sum(raised_amount) AS raised,
  row_number() OVER (PARTITION BY country_code ORDER BY sum(raised_amount) DESC, sector) AS r
 FROM sector_rounds WHERE trim(country_code) <> '' GROUP BY country_code, sector) WHERE r = 3""",
                           "rounds", "companies", "sectors")


def q_first_token(spark, sf):
    """First token of the '|' category list (whole text when there is no separator)."""
    c = companies(spark, sf)
    return aggs.count_by(c.select(QF.first_token("category_list", "|").alias("first_category")), ["first_category"])


SQL_FIRST_TOKEN = with_ctes("""SELECT split_part(category_list, '|', 1) AS first_category, count(*) AS n
FROM companies GROUP BY 1""", "companies")


QUERIES = {
    "join_on": q_join_on, "missing_keys": q_missing_keys, "present_keys": q_present_keys, "is_key": q_is_key,
    "fill_null": q_fill_null, "drop_blank": q_drop_blank, "mean_by_type": q_mean_by_type, "sum_by": q_sum_by,
    "top_k_sum": q_top_k_sum, "unpivot_flags": q_unpivot_flags, "map_category": q_map_category,
    "lookup": q_lookup, "nth_by_sum": q_nth_by_sum, "first_token": q_first_token,
}
ORACLE = {
    "join_on": SQL_JOIN_ON, "missing_keys": SQL_MISSING_KEYS, "present_keys": SQL_PRESENT_KEYS, "is_key": SQL_IS_KEY,
    "fill_null": SQL_FILL_NULL, "drop_blank": SQL_DROP_BLANK, "mean_by_type": SQL_MEAN_BY_TYPE, "sum_by": SQL_SUM_BY,
    "top_k_sum": SQL_TOP_K_SUM, "unpivot_flags": SQL_UNPIVOT_FLAGS, "map_category": SQL_MAP_CATEGORY,
    "lookup": SQL_LOOKUP, "nth_by_sum": SQL_NTH_BY_SUM, "first_token": SQL_FIRST_TOKEN,
}
