"""Profiling and data quality.

Every profile is one aggregate pass over the table (all columns at once),
then reshaped to a long (column, value) table with ``unpivot``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.order import hinges, q, quantiles_wide


def _long(row: DataFrame, names: Sequence[str], var: str, val: str) -> DataFrame:
    return row.unpivot([], [q(n) for n in names], var, val)


def shape(df: DataFrame) -> DataFrame:
    """B1: one row (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"))


def structure(df: DataFrame) -> DataFrame:
    """B1: (position, column, type) from the schema (no data read)."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position long, column string, type string")


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """B2: NULL count for every column, one pass -> (column, nulls)."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.count_if(q(c).isNull()).cast("long").alias(c) for c in cols])
    return _long(row, cols, "column", "nulls")


def null_total(df: DataFrame) -> DataFrame:
    """Total NULL cells of the table, one row (nulls)."""
    cols = df.columns
    total = sum((F.count_if(q(c).isNull()).cast("long") for c in cols), F.lit(0).cast("long"))
    return df.agg(total.alias("nulls"))


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row on ``cols`` (all columns by default); NULLs match NULLs.

    Partial (map-side) aggregation collapses a hot key before the shuffle.
    """
    cols = list(cols or df.columns)
    g = df.groupBy(*[q(c) for c in cols]).agg(F.count(F.lit(1)).alias("__n"))
    return g.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def null_profile_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns (present in both) whose NULL counts differ -> (column, nulls_a, nulls_b)."""
    common = [c for c in a.columns if c in set(b.columns)]
    na = null_counts(a, common).withColumnRenamed("nulls", "nulls_a")
    nb = null_counts(b, common).withColumnRenamed("nulls", "nulls_b").withColumnRenamed("column", "__col")
    return (na.join(F.broadcast(nb), na["column"] == nb["__col"])  # one row per column: bounded by the schema
            .where(F.col("nulls_a") != F.col("nulls_b")).select("column", "nulls_a", "nulls_b"))


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    """Distinct values of a column (NULL included once)."""
    return df.select(q(c)).distinct()


def n_distinct(df: DataFrame, c: str, count_null: bool = False, approx: bool = False) -> DataFrame:
    """Distinct count; SQL ignores NULL, R ``n_distinct`` counts it as a value."""
    base = F.approx_count_distinct(q(c)) if approx else F.count_distinct(q(c))
    e = base + F.max(q(c).isNull().cast("long")) if count_null else base
    return df.agg(e.cast("long").alias("n_distinct"))


def is_key(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(rows, distinct_keys, is_key) in one aggregate."""
    cols = list(cols)
    keyed = df.groupBy(*[q(c) for c in cols]).agg(F.count(F.lit(1)).alias("__n"))
    return keyed.agg(F.sum("__n").cast("long").alias("rows"), F.count(F.lit(1)).alias("distinct_keys")) \
        .withColumn("is_key", F.col("rows") == F.col("distinct_keys"))


def describe(df: DataFrame, cols: Sequence[str], probs: Mapping[str, float] | None = None) -> DataFrame:
    """Per column count, mean, sd (sample), min, exact percentiles, max -> one row per column.

    Columns are unpivoted to (column, value) so one pass serves all of them and
    the exact percentiles partition by column.
    """
    probs = dict(probs or {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    long = df.unpivot([], [q(c).cast("double").alias(c) for c in cols], "column", "value")
    # moments: one global aggregate over all columns (one row per column even for no rows)
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(q(c)).alias(f"c{i}"), F.avg(q(c).cast("double")).alias(f"m{i}"),
        F.stddev_samp(q(c).cast("double")).alias(f"s{i}"), F.min(q(c).cast("double")).alias(f"lo{i}"),
        F.max(q(c).cast("double")).alias(f"hi{i}"))])
    moments = row.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"c{i}").alias("count"), F.col(f"m{i}").alias("mean"),
        F.col(f"s{i}").alias("sd"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(cols)])))
    pct = quantiles_wide(long, "value", probs, by=["column"]).drop("n").withColumnRenamed("column", "__c")
    return (moments.join(F.broadcast(pct), moments["column"] == pct["__c"], "left")  # one row per column
            .select("column", "count", "mean", "sd", "min", *probs.keys(), "max"))


def percentile_grid(df: DataFrame, c: str, probs: Sequence[float]) -> DataFrame:
    """Exact type-7 percentiles at many probabilities -> (prob, value)."""
    from quarry.operators.order import quantiles
    return quantiles(df, c, probs)


def approx_percentiles(df: DataFrame, c: str, probs: Sequence[float], accuracy: int = 10000) -> DataFrame:
    """``percentile_approx`` (Greenwald-Khanna sketch, mergeable) -> (prob, value)."""
    arr = F.percentile_approx(q(c), [float(p) for p in probs], accuracy)
    row = df.agg(arr.alias("__a"))
    return row.select(F.posexplode("__a").alias("__i", "value")).select(
        F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("__i") + 1).alias("prob"),
        F.col("value").cast("double").alias("value"))


def quantile_sketches(df: DataFrame, c: str, by: Sequence[str] = (), k: int = 4096) -> DataFrame:
    """One mergeable KLL sketch per group, to be kept as data: (by..., sketch, n).

    A sketch holds about 3 k values whatever the group's size; its normalised rank error is about
    2.3 / k ** 0.95 (0.1 % for the default).  NULLs are not counted.
    """
    x = q(c).cast("double")
    return df.where(x.isNotNull()).groupBy(*[q(b) for b in by]).agg(
        F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged_quantiles(sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = (), k: int = 4096) -> DataFrame:
    """Quantiles of kept sketches merged within ``by``: (by..., prob, value); no pass over the values."""
    arr = F.array(*[F.lit(float(p)) for p in probs])
    merged = sketches.groupBy(*[q(b) for b in by]).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("__s"), F.sum("n").alias("__n"))
    merged = merged.where(F.col("__n") > 0)
    rows = F.arrays_zip(arr.alias("prob"), F.kll_sketch_get_quantile_double("__s", arr).alias("value"))
    return merged.select(*[q(b) for b in by], F.explode(rows).alias("__r")).select(
        *[q(b) for b in by], F.col("__r.prob").alias("prob"), F.col("__r.value").alias("value"))


def box_stats(df: DataFrame, c: str, by: Sequence[str] = (), rule: str = "hinge", coef: float = 1.5) -> DataFrame:
    """Box-plot numbers per group.

    rule='hinge'  : Tukey hinges (R ``boxplot.stats`` / ``fivenum``)
    rule='linear' : type-7 quartiles (pandas / seaborn)
    Output: by..., n, min, q1, median, q3, max, iqr, lower_fence, upper_fence,
    lower_whisker, upper_whisker (extreme data inside the fences), n_outliers.
    """
    by = list(by)
    if rule == "hinge":
        st = hinges(df, c, by)
    elif rule == "linear":
        st = quantiles_wide(df, c, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}, by)
    else:
        raise ValueError(rule)
    st = (st.withColumn("iqr", F.col("q3") - F.col("q1"))
            .withColumn("lower_fence", F.col("q1") - F.lit(coef) * F.col("iqr"))
            .withColumn("upper_fence", F.col("q3") + F.lit(coef) * F.col("iqr")))
    x = q(c)
    tagged = df.where(x.isNotNull())
    if by:  # one row per group, joined by key (AQE broadcasts it from its measured size)
        fence = st.select(*[q(b).alias(f"__fb{i}") for i, b in enumerate(by)], "lower_fence", "upper_fence")
        cond = None
        for i, b in enumerate(by):
            e = q(b).eqNullSafe(F.col(f"__fb{i}"))
            cond = e if cond is None else cond & e
        tagged = tagged.join(fence, cond, "inner")
        lf, uf = F.col("lower_fence"), F.col("upper_fence")
    else:  # one row in all: scalar subqueries
        lf, uf = st.select("lower_fence").scalar(), st.select("upper_fence").scalar()
    inside = (x >= lf) & (x <= uf)
    w = tagged.groupBy(*[q(b).alias(f"__wb{i}") for i, b in enumerate(by)]).agg(
        F.min(F.when(inside, x)).cast("double").alias("lower_whisker"),
        F.max(F.when(inside, x)).cast("double").alias("upper_whisker"),
        F.count_if(~inside).cast("long").alias("n_outliers"))
    if by:
        cond2 = None
        for i, b in enumerate(by):
            e = q(b).eqNullSafe(F.col(f"__wb{i}"))
            cond2 = e if cond2 is None else cond2 & e
        out = st.join(w, cond2, "left")
    else:
        out = st.select("*", *[w.select(k).scalar().alias(k) for k in ("lower_whisker", "upper_whisker", "n_outliers")])
    return out.select(*[q(b) for b in by], "n", "min", "q1", "median", "q3", "max", "iqr",
                      "lower_fence", "upper_fence", "lower_whisker", "upper_whisker", "n_outliers")


def outliers(df: DataFrame, c: str, by: Sequence[str] = (), rule: str = "hinge", coef: float = 1.5) -> DataFrame:
    """The rows outside the 1.5 IQR fences of their group."""
    by = list(by)
    st = box_stats(df, c, by, rule, coef).select(*[q(b).alias(f"__ob{i}") for i, b in enumerate(by)],
                                                 "lower_fence", "upper_fence")
    if not by:  # one row: scalar subqueries
        lf, uf = st.select("lower_fence").scalar(), st.select("upper_fence").scalar()
        return df.where((q(c) < lf) | (q(c) > uf))
    cond = None
    for i, b in enumerate(by):
        e = q(b).eqNullSafe(F.col(f"__ob{i}"))
        cond = e if cond is None else cond & e
    j = df.join(st, cond, "inner")  # one row per group (AQE broadcasts it from its measured size)
    return j.where((q(c) < F.col("lower_fence")) | (q(c) > F.col("upper_fence"))).select(*[q(x) for x in df.columns])


def length_profile(df: DataFrame, c: str) -> DataFrame:
    """(min_len, max_len, n_lengths) of a text column."""
    ln = F.length(q(c))
    return df.agg(F.min(ln).cast("long").alias("min_len"), F.max(ln).cast("long").alias("max_len"),
                  F.count_distinct(ln).cast("long").alias("n_lengths"))


def rule_violations(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows breaking each named rule (a rule is a Column, TRUE = broken), per key.

    One pass: a ``count_if`` per rule, grouped by ``by``, then unpivoted to
    (by..., rule, violations).  Rules should use ``try_divide`` for ratios.
    """
    by = list(by)
    names = list(rules)
    agg = df.groupBy(*[q(b) for b in by]).agg(*[F.count_if(rules[n]).cast("long").alias(n) for n in names])
    return agg.unpivot([q(b) for b in by], [q(n) for n in names], "rule", "violations")


def date_parts_seen(df: DataFrame, cols: Sequence[str], part: str = "year") -> DataFrame:
    """(column, value, rows) of a date part over several timestamp columns."""
    fn = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "quarter": F.quarter}[part]
    long = df.unpivot([], [fn(q(c)).cast("long").alias(c) for c in cols], "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null, is_constant); NULL counts as a value.

    A column is constant if it has no value, or no NULL and equal minimum and maximum: one aggregate
    of fixed size, where distinct counts would shuffle every value.
    """
    cols = list(cols or df.columns)
    one = lambda c: (F.count(q(c)) == 0) | ((F.count(q(c)) == F.count(F.lit(1))) & F.min(q(c)).eqNullSafe(F.max(q(c))))
    row = df.agg(*[F.struct((F.count(F.lit(1)) - F.count(q(c))).alias("n_null"), one(c).alias("is_constant")).alias(c) for c in cols])
    out = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(c).getField("n_null").alias("n_null"),
                                       q(c).getField("is_constant").alias("is_constant")) for c in cols])).alias("__r")
    return row.select(out).select("__r.column", "__r.n_null", "__r.is_constant")


def drop_constant(df: DataFrame) -> DataFrame:
    """Drop columns holding one value (NULL counts as a value).  One aggregate; the
    decision (a list of column names) is the only thing brought to the driver."""
    const = [r["column"] for r in constant_columns(df).where("is_constant").select("column").collect()]
    return df.drop(*const)


def all_null_columns(df: DataFrame) -> DataFrame:
    """(column, non_null, all_null)."""
    cols = df.columns
    row = df.agg(*[F.count(q(c)).alias(c) for c in cols])
    return _long(row, cols, "column", "non_null").withColumn("all_null", F.col("non_null") == 0)


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop columns with no value at all."""
    gone = [r["column"] for r in all_null_columns(df).where("all_null").select("column").collect()]
    return df.drop(*gone)
