"""Exact order-dependent primitives without a single-task window.

An unpartitioned window (``row_number() over (order by x)``) puts the whole
table in one task.  Here the table is range-partitioned by Spark (sampled
bounds, so a hot value is spread as far as the tie-breaker allows) and written
once with its range number, which from then on is data: no later stage can
renumber it.  A window per range computes the local running total, and the
totals per range -- at most (ranges + groups) rows -- give each range its
offset.  JVM only; values keep their types.  The result is exact.

Used by: global row index, cumulative sums and shares.  Quantiles and hinges
come from the exact selection of ``select``, which neither sorts nor writes rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import cut_lineage


def q(name: str) -> Column:
    """Column by name, names with blanks or dots allowed."""
    return F.col("`" + name.replace("`", "``") + "`")


def running_total(df: DataFrame, order: Sequence[Column | str], weight: Column | None = None,
                  by: Sequence[str] = (), out: str = "cum", num_partitions: int | None = None,
                  total_out: str | None = None, per_group: Callable[[Column], dict] | None = None) -> DataFrame:
    """Running (inclusive) total of ``weight`` (1 per row if None) within ``by`` in ``order``.

    Give a total order (append a key) if ties must resolve the same way every run.
    ``total_out`` adds the group's grand total; ``per_group(total)`` may add further
    columns computed once per (partition, group) on the small offsets table.
    """
    by = list(by)
    order_cols = [q(o) if isinstance(o, str) else o for o in order]
    base = df.withColumn("__w", weight if weight is not None else F.lit(1).cast("long"))
    wtype = base.schema["__w"].dataType
    if isinstance(wtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        local_type = T.LongType()
    elif isinstance(wtype, T.DecimalType):
        local_type = T.DecimalType(min(38, wtype.precision + 10), wtype.scale)
    else:
        local_type = T.DoubleType()
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [q(b) for b in by] + order_cols
    base = base.withColumn("__w", F.coalesce("__w", F.lit(0)).cast(local_type))
    ranged = cut_lineage(base.repartitionByRange(n, *keys).withColumn("__pid", F.spark_partition_id()), "ranges")
    rows = (Window.partitionBy("__pid", *[q(b) for b in by]).orderBy(*order_cols)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumn("__local", F.sum("__w").over(rows).cast(local_type))
    totals = ranged.groupBy("__pid", *[q(b) for b in by]).agg(F.sum("__w").cast(local_type).alias("__t"))
    w = Window.partitionBy(*[q(b) for b in by]).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    group_total = F.sum("__t").over(Window.partitionBy(*[q(b) for b in by]))
    extra = {}
    if total_out or per_group:
        extra["__gt"] = group_total
    offs = totals.select(F.col("__pid").alias("__opid"),
                         *[q(b).alias(f"__ob{i}") for i, b in enumerate(by)],
                         F.coalesce(F.sum("__t").over(w), F.lit(0).cast(local_type)).alias("__off"),
                         *[e.alias(k) for k, e in extra.items()])
    extra_out = []
    if per_group:
        cols = per_group(F.col("__gt"))
        offs = offs.withColumns(cols)
        extra_out += list(cols)
    if total_out:
        offs = offs.withColumnRenamed("__gt", total_out)
        extra_out.append(total_out)
    # at most one row per (partition, group): bounded by the partition count when ungrouped (hint);
    # with groups it is at most partitions + groups rows and AQE picks the join from its measured size
    offs = offs if by else F.broadcast(offs)
    cond = F.col("__pid") == F.col("__opid")
    for i, b in enumerate(by):
        cond = cond & q(b).eqNullSafe(F.col(f"__ob{i}"))
    joined = local.join(offs, cond, "inner")
    return joined.select(*[q(c) for c in df.columns], (F.col("__local") + F.col("__off")).alias(out),
                         *[F.col(c) for c in extra_out])


def row_index(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), out: str = "rn") -> DataFrame:
    """Exact 1-based ``row_number()`` over ``order`` (within ``by``), distributed."""
    return running_total(df, order, None, by, out)


def _stat_map(df: DataFrame, c: str, positions, by, m: int) -> DataFrame:
    from quarry.operators.select import order_statistics
    picks = order_statistics(df, c, positions, by, m)
    return picks.groupBy(*[q(b) for b in by]).agg(
        F.map_from_entries(F.collect_list(F.struct("__k", "__v"))).alias("__m"),
        F.coalesce(F.first("__n"), F.lit(0).cast("long")).alias("__n"))


def _probs(probs) -> Column:
    return F.array(*[F.lit(float(p)) for p in probs])


def _linear_positions(probs):
    """Ranks floor(h) and floor(h)+1 of every probability, h = (n - 1) p + 1 (type 7)."""
    def pos(n):
        lo = lambda p: F.floor((n - 1).cast("double") * p).cast("long") + 1
        return F.array_distinct(F.flatten(F.transform(_probs(probs), lambda p: F.array(lo(p), F.least(lo(p) + 1, n)))))
    return pos


def _linear_value(m: Column, n: Column, p: Column) -> Column:
    h = (n - 1).cast("double") * p
    lo = F.floor(h).cast("long") + 1
    x_lo = F.element_at(m, lo)
    x_hi = F.element_at(m, F.least(lo + 1, n))
    return x_lo + (h - F.floor(h)) * (x_hi - x_lo)


def quantiles(df: DataFrame, c: str, probs: Sequence[float], by: Sequence[str] = (),
              prob_col: str = "prob", value_col: str = "value") -> DataFrame:
    """Exact type-7 (linear interpolation) quantiles, long form (by..., prob, value).

    Equals ``percentile(c, p)`` in Spark and ``quantile_cont`` in DuckDB, but
    never gathers the values of a group into one buffer: only the 2 x len(probs)
    order statistics of each group travel.
    """
    by = list(by)
    sm = _stat_map(df, c, _linear_positions(probs), by, 2 * len(probs))
    m, n = F.col("__m"), F.col("__n")
    arr = F.transform(_probs(probs), lambda p: F.struct(
        p.alias(prob_col), _linear_value(m, n, p).cast("double").alias(value_col)))
    return sm.select(*[q(b) for b in by], F.inline(arr))


def quantiles_wide(df: DataFrame, c: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Same as :func:`quantiles`, one column per named probability, plus ``n``."""
    by = list(by)
    sm = _stat_map(df, c, _linear_positions(list(probs.values())), by, 2 * len(probs))
    return sm.select(*[q(b) for b in by], F.col("__n").alias("n"),
                     *[_linear_value(F.col("__m"), F.col("__n"), F.lit(float(p))).cast("double").alias(name)
                       for name, p in probs.items()])


def hinges(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """Tukey five numbers (R ``fivenum``): min, lower hinge, median, upper hinge, max, and n."""
    by = list(by)

    def d_of(n):
        return F.floor((n + 3).cast("double") / 2) / 2

    def positions(n):
        d = d_of(n)
        mid = (n + 1).cast("double") / 2
        ks = []
        for x in (F.lit(1.0), d, mid, (n + 1).cast("double") - d, n.cast("double")):
            ks += [F.floor(x).cast("long"), F.ceil(x).cast("long")]
        return F.array_distinct(F.array(*ks))

    sm = _stat_map(df, c, positions, by, 10)
    m, n = F.col("__m"), F.col("__n")
    d = d_of(n)

    def at(x):
        return ((F.element_at(m, F.floor(x).cast("long")) + F.element_at(m, F.ceil(x).cast("long"))) / 2
                ).cast("double")

    return sm.select(*[q(b) for b in by], n.alias("n"),
                     at(F.lit(1.0)).alias("min"), at(d).alias("q1"),
                     at((n + 1).cast("double") / 2).alias("median"),
                     at((n + 1).cast("double") - d).alias("q3"), at(n.cast("double")).alias("max"))
