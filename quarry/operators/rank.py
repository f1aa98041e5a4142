"""Ranking, windows, top-k.

* top-k per group: aggregate first, then ``row_number`` over the aggregated
  rows; Spark adds a partial ``WindowGroupLimit`` before the shuffle, so each
  map task forwards at most k rows per group.
* arg-max per group: ``min(struct(-measure, tie-break, ...))`` is an ordinary
  aggregate with partial combine -- no window over raw rows, skew-safe.
* ntile: the buckets' last rows by the exact selection of
  :mod:`quarry.operators.select`, then comparisons per row.
* cumulative sums: the distributed running totals of
  :mod:`quarry.operators.order`, never an unpartitioned window.
* series windows (moving average, lags) partition by series key; they run on
  series tables (one row per period), not on raw events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.order import q, running_total
from quarry.operators.select import after_bound, count_below, indexed, order_bounds


def _measure(measure: str) -> Column:
    return F.count(F.lit(1)) if measure == "count" else F.sum(q(measure))


def top_k(df: DataFrame, key: Sequence[str] | str, k: int, measure: str = "count",
          exclude: Column | None = None, out: str = "n") -> DataFrame:
    """G1: global top-k keys by count (or sum of a column); ties broken by key.

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each partition
    keeps its k best, one task merges them.
    """
    keys = [key] if isinstance(key, str) else list(key)
    src = df.where(~F.coalesce(exclude, F.lit(False))) if exclude is not None else df
    g = src.groupBy(*[q(x) for x in keys]).agg(_measure(measure).alias(out))
    return g.orderBy(F.col(out).desc(), *[q(x).asc() for x in keys]).limit(k)


def top_k_by(df: DataFrame, groups: Sequence[str], key: Sequence[str] | str, k: int, measure: str = "count",
             out: str = "n", rank: str = "rank") -> DataFrame:
    """Top-k keys per group (one window query instead of one UNION branch per group)."""
    keys = [key] if isinstance(key, str) else list(key)
    g = df.groupBy(*[q(x) for x in list(groups) + keys]).agg(_measure(measure).alias(out))
    w = Window.partitionBy(*[q(x) for x in groups]).orderBy(F.col(out).desc(), *[q(x).asc() for x in keys])
    return g.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def nth_by(df: DataFrame, groups: Sequence[str], key: Sequence[str] | str, n: int, measure: str = "count",
           out: str = "n") -> DataFrame:
    """The n-th ranked key per group."""
    return top_k_by(df, groups, key, n, measure, out).where(F.col("rank") == n).drop("rank")


def arg_max(df: DataFrame, by: Sequence[str], measure: str, tie: Sequence[str], cols: Sequence[str] | None = None,
            largest: bool = True) -> DataFrame:
    """Per group, the row with the largest (or smallest) numeric measure;
    ties go to the smallest ``tie`` values.  An aggregate, not a window."""
    cols = list(cols or [c for c in df.columns if c not in set(by)])
    m = -q(measure) if largest else q(measure)
    payload = [c for c in cols if c not in set(tie) and c != measure]
    best = F.min(F.struct(m.alias("__m"), *[q(t).alias(t) for t in tie], *[q(c).alias(c) for c in payload]
                          )).alias("__best")
    g = df.where(q(measure).isNotNull()).groupBy(*[q(b) for b in by]).agg(best)
    return g.select(*[q(b) for b in by], *[F.col("__best").getField(c).alias(c) for c in cols if c != measure]
                    + [(-F.col("__best.__m") if largest else F.col("__best.__m")).alias(measure)])


def ntile_bucket(df: DataFrame, score: str, n: int, key: Sequence[str], descending: bool = True,
                 out: str = "bucket") -> DataFrame:
    """``ntile(n)`` over the score (descending by default), ties broken by key.

    Exact SQL semantics (the first N % n buckets get one extra row).  The last row of each bucket is
    found by exact selection; a row's bucket is one more than the number of those it comes after, so
    rows are not sorted.  Rows that equal each other in score and key, with a bucket's end among
    them, get their places from the distributed row index.
    """
    order = [(score, descending), *[(k, False) for k in key]]

    def last_rows(rows: int) -> list[int]:
        ends = (i * (rows // n) + min(i, rows % n) for i in range(1, n))
        return sorted({e for e in ends if 0 < e < rows})

    ends, bounds = order_bounds(df, order, last_rows)
    if bounds is None:
        place = F.array(*[F.lit(e).cast("long") for e in ends])
        j = count_below(indexed(df, order, "__r"), F.col("__r"), place, len(ends), "__b", inclusive=False)
        return j.withColumn(out, (F.col("__b") + 1).cast("long")).drop("__r", "__b")
    b = F.lit(1).cast("long")
    for x in bounds:
        b = b + F.when(after_bound(order, x), F.lit(1)).otherwise(F.lit(0))
    return df.withColumn(out, b)


def cumulative(df: DataFrame, order: Sequence[Column | str], c: str, out: str = "cum",
               by: Sequence[str] = ()) -> DataFrame:
    """Running sum of ``c`` in ``order`` (within ``by``), distributed and exact."""
    return running_total(df, order, q(c), by, out)


def share_of_total(df: DataFrame, c: str, order: Sequence[Column | str] | None = None,
                   out: str = "share", cum_out: str = "cum_share") -> DataFrame:
    """Share of the grand total (and cumulative share in ``order``).

    The total is a scalar subquery (one aggregate, run once), so rows stay in
    their partitions.
    """
    total = df.agg(F.sum(q(c)).cast("double")).scalar()
    j = running_total(df, order, q(c), (), "__cum") if order else df
    j = j.withColumn(out, F.try_divide(q(c).cast("double"), total))
    if order:
        j = j.withColumn(cum_out, F.try_divide(F.col("__cum").cast("double"), total)).drop("__cum")
    return j


def moving_average(df: DataFrame, by: Sequence[str], order: str, c: str, w: int = 1,
                   out: str = "ma") -> DataFrame:
    """Centred moving average over 2w+1 rows; NULL where the frame is not full."""
    win = Window.partitionBy(*[q(b) for b in by]).orderBy(q(order)).rowsBetween(-w, w)
    return df.withColumn(out, F.when(F.count(q(c)).over(win) == 2 * w + 1, F.avg(q(c)).over(win)))


def lags(df: DataFrame, by: Sequence[str], order: str, c: str, ks: Sequence[int], prefix: str | None = None) -> DataFrame:
    """Lagged values within each series."""
    win = Window.partitionBy(*[q(b) for b in by]).orderBy(q(order))
    p = prefix or f"{c}_lag"
    return df.withColumns({f"{p}{k}": F.lag(q(c), k).over(win) for k in ks})
