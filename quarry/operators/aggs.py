"""Aggregations.

All are hash aggregates with partial (map-side) combine, so a key holding a
third of the rows is reduced inside each map task before the shuffle.  Shares
use ``sum(x) over ()`` on the *aggregated* table only (a handful of rows).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import functions as QF
from quarry.operators.blocks import correlations, long_matrix
from quarry.operators.order import q


def _g(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*[q(k) for k in keys])


def count_by(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """rows per key(s)."""
    return _g(df, keys).agg(F.count(F.lit(1)).alias(out))


def share_where(df: DataFrame, cond: Column, by: Sequence[str] = ()) -> DataFrame:
    """(rows, hits, share) of rows meeting a predicate, totals computed from data."""
    return _g(df, by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(cond).cast("long").alias("hits")) \
        .withColumn("share", F.try_divide(F.col("hits").cast("double"), F.col("rows").cast("double")))


def sum_by(df: DataFrame, keys: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """sums per key(s); ``measures`` = {out: column}."""
    return _g(df, keys).agg(*[F.sum(q(c)).alias(o) for o, c in measures.items()])


def mean_by(df: DataFrame, keys: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """means per key(s) (global mean when keys is empty)."""
    return _g(df, keys).agg(*[F.avg(q(c)).alias(o) for o, c in measures.items()])


def min_max(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """(min, max) per key."""
    return _g(df, by).agg(F.min(q(c)).alias("min"), F.max(q(c)).alias("max"))


def count_above_mean(df: DataFrame, cols: Sequence[str], digits: int | None = None) -> DataFrame:
    """per column, its mean (optionally rounded half-even) and the rows above it.

    The means are uncorrelated scalar subqueries (Catalyst merges them into one
    aggregate, run once); a second aggregate counts against them.
    """
    means = []
    for c in cols:
        m = F.avg(q(c))
        means.append(df.agg(F.bround(m, digits) if digits is not None else m).scalar())
    row = df.agg(*[F.first(means[i]).alias(f"mean__{i}") for i in range(len(cols))],
                 *[F.count_if(q(c) > means[i]).cast("long").alias(f"above__{i}") for i, c in enumerate(cols)])
    stacked = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"mean__{i}").cast("double").alias("mean"),
                                 F.col(f"above__{i}").alias("above")) for i, c in enumerate(cols)])
    return row.select(F.inline(stacked))


def bucket_share(df: DataFrame, c: str, edges: Sequence, labels: Sequence[str], out: str = "bucket") -> DataFrame:
    """rows and share per bucket label (rows outside all buckets form the NULL bucket)."""
    b = df.select(QF.bucket_label(q(c), list(edges), list(labels)).alias(out))
    g = b.groupBy(out).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def rollup_to(df: DataFrame, fine_keys: Sequence[str], coarse_keys: Sequence[str],
              measures: Mapping[str, str]) -> DataFrame:
    """F8: sum to fine keys, then re-aggregate to coarse keys (sum of sums)."""
    fine = sum_by(df, fine_keys, measures)
    return sum_by(fine, coarse_keys, {o: o for o in measures})


def coef_variation(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """sample sd / mean per group (one groupBy, not one job per level)."""
    return _g(df, keys).agg(F.avg(q(c)).alias("mean"), F.stddev_samp(q(c)).alias("sd")) \
        .withColumn("cv", F.try_divide(F.col("sd"), F.col("mean")))


def corr(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of a pair."""
    return _g(df, by).agg(F.corr(q(a), q(b)).alias("r"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """all pairwise Pearson correlations -> long (a, b, r), each over the rows where both are present.

    One pass of block products after one for the means; NULL for a pair without spread or rows.
    """
    r = correlations(df, cols)
    return long_matrix(df.sparkSession, cols, r, "r")


def compare_segments(df: DataFrame, segments: Mapping[str, Column], c: str, how: str = "avg") -> DataFrame:
    """one measure over several row segments in one pass -> (segment, rows, value)."""
    fn = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[how]
    names = list(segments)
    row = df.agg(*[F.count_if(segments[n]).cast("long").alias(f"__n{i}") for i, n in enumerate(names)],
                 *[fn(F.when(segments[n], q(c))).cast("double").alias(f"__v{i}") for i, n in enumerate(names)])
    arr = F.array(*[F.struct(F.lit(n).alias("segment"), F.col(f"__n{i}").alias("rows"), F.col(f"__v{i}").alias("value"))
                    for i, n in enumerate(names)])
    return row.select(F.inline(arr))


def crosstab(df: DataFrame, x: str, fill: str, facet: str | None = None, wide: bool = False,
             levels: Sequence | None = None) -> DataFrame:
    """counts of x by fill (optionally by facet); ``wide`` pivots fill levels to columns, 0 for an
    empty cell.  Give ``levels`` to fix the columns; otherwise Spark reads them first."""
    keys = [x, fill] + ([facet] if facet else [])
    if not wide:
        return count_by(df, keys)
    by = [x] + ([facet] if facet else [])
    g = _g(df, by).pivot(fill, list(levels) if levels is not None else None).count()
    return g.select(*[q(b) for b in by], *[F.coalesce(q(c), F.lit(0)).cast("long").alias(c) for c in g.columns if c not in by])


def composition(df: DataFrame, x: str, fill: str) -> DataFrame:
    """share of each fill level within each x level."""
    g = count_by(df, [x, fill])
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(q(x))))


def histogram(df: DataFrame, c: str, bins: int = 30, fill: str | None = None) -> DataFrame:
    """F16: n equal-width bins from min to max (max lands in the last bin) -> (bin, lo, hi, n).

    Every bin has a row (per fill level), 0 where it is empty; no rows without a value.
    """
    lo = df.agg(F.min(q(c)).cast("double")).scalar()  # scalar subqueries, run once
    hi = df.agg(F.max(q(c)).cast("double")).scalar()
    width = (hi - lo) / F.lit(bins)
    b = F.when(hi == lo, F.lit(1)).otherwise(F.least(F.floor((q(c) - lo) / width).cast("long") + 1, F.lit(bins)))
    keys = ([q(fill).alias("__fill")] if fill else [F.lit(1).alias("__fill")])
    # the bin is projected first: grouping keys may not hold the scalar subqueries themselves
    binned = df.where(q(c).isNotNull()).select(*keys, b.cast("long").alias("bin"))
    g = binned.groupBy("__fill", "bin").agg(F.count(F.lit(1)).alias("n"))
    # a fill level's counts (at most ``bins``) as a map, read by a generator over the bins
    per = g.groupBy("__fill").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("__m"))
    grid = per.select("__fill", "__m", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))).alias("bin"))
    return grid.select(*([F.col("__fill").alias(fill)] if fill else []), "bin", (lo + (F.col("bin") - 1) * width).alias("lo"),
                       (lo + F.col("bin") * width).alias("hi"), F.coalesce(F.element_at("__m", F.col("bin")), F.lit(0)).alias("n"))


def regression_line(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """one-predictor least squares (slope, intercept, r2)."""
    return _g(df, by).agg(F.regr_slope(q(y), q(x)).alias("slope"), F.regr_intercept(q(y), q(x)).alias("intercept"),
                          F.regr_r2(q(y), q(x)).alias("r2"), F.regr_count(q(y), q(x)).alias("n"))


def gap_by(df: DataFrame, slot: Sequence[str], ok: Column) -> DataFrame:
    """supply-demand gap per slot = all requests - completed ones, in one pass."""
    return _g(df, slot).agg(F.count(F.lit(1)).alias("requests"), F.count_if(ok).cast("long").alias("served")) \
        .withColumn("gap", F.col("requests") - F.col("served"))
