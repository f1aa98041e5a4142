"""Set operations and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import functions as QF
from quarry.operators.order import q


def union_all(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """H1/H2: UNION ALL by column name (missing columns as NULL when allowed)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out


def union_tagged(frames: Mapping[object, DataFrame], cols: Sequence[str], tag: str = "year") -> DataFrame:
    """H3: the same projection over several inputs, each tagged (e.g. by year), stacked."""
    parts = [df.select(F.lit(t).alias(tag), *[q(c) for c in cols]) for t, df in frames.items()]
    return union_all(parts)


def unpivot_flags(df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str = "category",
                  drop_blank_ids: bool = True) -> DataFrame:
    """Wide 0/1 matrix -> long (ids..., var) for the non-zero cells; value dropped."""
    long = df.unpivot([q(i) for i in ids], [q(c).cast("double").alias(c) for c in cols], var, "__v")
    long = long.where(F.col("__v") != 0).drop("__v")
    if drop_blank_ids:
        for i in ids:
            long = long.where(F.trim(q(i)) != F.lit(""))
    return long


def dummy_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Sorted distinct levels of each categorical column.

    Every level becomes a column of the result, so the lists are as long as its schema; give
    ``levels`` to :func:`dummies` to choose them.
    """
    return {c: [r[0] for r in df.select(q(c)).where(q(c).isNotNull()).distinct().orderBy(q(c)).collect()] for c in cols}


def dummies(df: DataFrame, cols: Sequence[str], drop_first: bool = True, levels: Mapping[str, list] | None = None,
            keep_original: bool = False) -> DataFrame:
    """One-hot 0/1 int columns ``<col>_<level>``; the alphabetically first level dropped.

    ``levels`` may be given (e.g. fitted on the training part); otherwise they
    are read with one aggregate.
    """
    lv = dict(levels) if levels else dummy_levels(df, cols)
    out = df
    for c in cols:
        ls = lv[c][1:] if drop_first else lv[c]
        out = out.withColumns({f"{c}_{v}": (q(c) == F.lit(v)).cast("int") for v in ls})
        if not keep_original:
            out = out.drop(c)
    return out


def row_mean(df: DataFrame, key: Sequence[str], cols: Sequence[str], out: str = "row_mean") -> DataFrame:
    """Mean over many columns of each row, NULLs skipped -> (key..., out).

    Row-local (no shuffle); rows that share a key stay separate rows, a row of NULLs gives NULL.
    """
    v = F.filter(F.array(*[q(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    return df.select(*[q(k) for k in key], F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v)).alias(out))


def timesheet_hours(in_df: DataFrame, out_df: DataFrame, key: str, day_cols: Sequence[str] | None = None,
                    pattern: str | None = None) -> DataFrame:
    """Two wide timesheets (one column per day) -> mean hours per key.

    The sheets are joined once on the key; each pair of rows then sums the elapsed hours of the days
    that both sheets have (days off = NULL skip), and the sums are averaged per key.
    """
    days = list(day_cols or [c for c in in_df.columns if c != key])
    t = lambda d: QF.parse_date(q(d), pattern) if pattern else q(d).cast("timestamp")
    sheet = lambda df, name: df.select(q(key).alias(key), F.array(*[t(d) for d in days]).alias(name))
    j = sheet(in_df, "__in").join(sheet(out_df, "__out"), key, "inner")
    hours = F.filter(F.transform(F.arrays_zip("__in", "__out"), lambda x: QF.elapsed(x["__in"], x["__out"], "hour")),
                     lambda h: h.isNotNull())
    j = j.select(q(key), F.aggregate(hours, F.lit(0.0), lambda a, x: a + x).alias("__h"), F.size(hours).cast("long").alias("__n"))
    g = j.groupBy(q(key)).agg(F.sum("__h").alias("__h"), F.sum("__n").alias("days_worked"))
    return g.select(q(key), F.try_divide("__h", "days_worked").alias("mean_hours"), "days_worked")
