"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate.

Per line hash a HyperLogLog sketch of its sites is built in the tasks and merged by aggregation.
Lines whose estimate lies well above or below the limit are decided by it; lines near the limit
get an exact distinct count.  Native Spark SQL throughout (DataSketches aggregates).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import quoted

GAP = r"[\x20\x09-\x0D]+"


def line_key(line: Column) -> Column:
    """Hash of a normalised line: lower case, white space runs as one blank, trimmed."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), GAP, " ")))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def site_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """doc_id, site, line: the distinct lines with a word of every whole text (NULL text: none)."""
    t = docs.select(quoted(id_col).alias("doc_id"), quoted(site_col).alias("site"),
                    F.explode(F.array_distinct(F.split(quoted(text_col), "\n"))).alias("x"))
    return t.where(has_word(F.col("x"))).select("doc_id", "site", line_key(F.col("x")).alias("line"))


def boilerplate_lines(lines: DataFrame, min_sites: int, lg_k: int = 9) -> DataFrame:
    """Line hashes standing on at least ``min_sites`` distinct sites: line, n_sites, exact.

    n_sites is exact where ``exact`` is true, else the sketch's estimate, which then lies more
    than four standard errors above the limit.  NULL sites are not counted.
    """
    error = 4 * 1.04 / math.sqrt(2 ** lg_k)
    spread = (lines.where(F.col("site").isNotNull()).groupBy("line")
              .agg(F.hll_sketch_agg(F.col("site").cast("string"), lg_k).alias("sketch"))
              .select("line", F.hll_sketch_estimate("sketch").alias("estimate"))
              .where(F.col("estimate") >= math.floor(min_sites * (1 - error))))
    high = math.ceil(min_sites * (1 + error))
    sure = spread.where(F.col("estimate") > high).select("line", F.col("estimate").alias("n_sites"), F.lit(False).alias("exact"))
    near = spread.where(F.col("estimate") <= high).select("line")
    pairs = lines.where(F.col("site").isNotNull()).join(near, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one"))
    counted = pairs.groupBy("line").agg(F.count("one").alias("n_sites")).where(F.col("n_sites") >= min_sites)
    return sure.unionByName(counted.withColumn("exact", F.lit(True)))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int = 10, max_lost: float = 0.5, lg_k: int = 9) -> DataFrame:
    """``docs`` with all its columns, boilerplate lines removed from the text, plus the columns
    ``__n_lines`` and ``__n_removed`` (lines with a word, and how many of them went).

    A document that would lose more than ``max_lost`` of its words is a copy of a page, not a page
    with boilerplate: it keeps its lines and is left to near-duplicate removal.  NULL and empty
    texts stay as they are with 0 lines.  Rows that share a doc_id share their boilerplate lines
    (each row loses those it has).  Kept lines keep their order and their line breaks.
    """
    lines = site_lines(docs, id_col, text_col, site_col)
    bad = (lines.join(boilerplate_lines(lines, min_sites, lg_k).select("line"), "line")
           .groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line").alias("__bad")))
    joined = docs.join(bad, quoted(id_col).eqNullSafe(F.col("__id")), "left")
    parts = F.split(quoted(text_col), "\n")
    stays = lambda x: ~(has_word(x) & F.array_contains("__bad", line_key(x)))
    width = lambda x: F.size(F.array_remove(F.split(x, GAP), ""))
    joined = joined.withColumn("__kept", F.when(F.col("__bad").isNotNull(), F.array_join(F.filter(parts, stays), "\n")))
    words, left = width(quoted(text_col)), width(F.col("__kept"))
    joined = joined.withColumn("__cut", F.col("__kept").isNotNull() & (words - left <= max_lost * words))
    with_word = lambda t: F.size(F.filter(F.split(t, "\n"), has_word)).cast("long")
    n_lines = F.coalesce(F.when(quoted(text_col).isNotNull(), with_word(quoted(text_col))), F.lit(0).cast("long"))
    joined = joined.withColumn("__n_lines", n_lines).withColumn(
        "__n_removed", F.when(F.col("__cut"), F.col("__n_lines") - with_word(F.col("__kept"))).otherwise(F.lit(0).cast("long")))
    return joined.select(*[F.when(F.col("__cut"), F.col("__kept")).otherwise(quoted(c)).alias(c) if c == text_col
                           else quoted(c) for c in docs.columns], "__n_lines", "__n_removed")
