"""Projection, filtering and cleaning.

All row-local: projections and predicates that Catalyst pushes to the scan
where it can.  The order-dependent ones (C14 exact-n sample, C15 index) use the
distributed primitives of :mod:`quarry.operators.order` or a window partitioned
by series key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import functions as QF
from quarry.operators.order import q

# hash slices of an exact sample: bounds the count table, and the share of the rows that is ranked
SLICES = 1 << 16


def keep(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep columns (by name, blanks allowed)."""
    return df.select(*[q(c) for c in cols])


def drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns by name."""
    return df.drop(*cols)


def replace_value(df: DataFrame, c: str, old, new) -> DataFrame:
    """Replace one value by another; NULL stays NULL."""
    return df.withColumn(c, F.when(q(c) == F.lit(old), F.lit(new)).otherwise(q(c)))


def recode(df: DataFrame, c: str, mapping: Mapping, default: str = "keep", out: str | None = None,
           dtype: str | None = None) -> DataFrame:
    """Dictionary recode (spelling fixes, word -> number, yes/no -> 1/0).

    The dictionary becomes a literal map inside the expression (no join).
    default='keep' keeps unmapped values, 'null' turns them into NULL.
    """
    e = QF.recode_value(q(c), dict(mapping), default)
    if dtype:
        e = e.cast(dtype)
    return df.withColumn(out or c, e)


def bucketize(df: DataFrame, c: str, edges: Sequence, labels: Sequence[str], out: str) -> DataFrame:
    """C4: half-open interval labels [e_i, e_i+1); NULL outside the edges."""
    return df.withColumn(out, QF.bucket_label(q(c), list(edges), list(labels)))


def bucket_sql(value: str, edges: Sequence, labels: Sequence[str]) -> str:
    """The CASE expression of :func:`bucketize` for SQL text, from the same edges and labels."""
    cases = " ".join(f"WHEN {value} >= {a} AND {value} < {b} THEN '{x}'" for a, b, x in zip(edges, edges[1:], labels))
    return f"CASE {cases} END"


def classify(df: DataFrame, c: str, classes: Mapping[str, Sequence], out: str, default=None) -> DataFrame:
    """Set-membership classes {label: values} -> label."""
    return df.withColumn(out, QF.class_label(q(c), dict(classes), default))


def where(df: DataFrame, cond: Column | str) -> DataFrame:
    """Filter by a predicate (Column or SQL text); rows where it is NULL are dropped."""
    return df.where(cond)


def _all_pass(rules: Mapping[str, Column]) -> Column:
    ok = F.lit(True)
    for r in rules.values():
        ok = ok & ~F.coalesce(r, F.lit(False))
    return ok


def cleanse(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Keep rows that break none of the rules (rules as in B13: TRUE = broken).

    A rule that evaluates to NULL does not count as broken.
    """
    return df.where(_all_pass(rules))


def drop_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with NULL in any (or the chosen) columns."""
    return df.dropna(how="any", subset=list(cols) if cols else None)


def fill_null(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace NULL by a constant, per column."""
    return df.withColumns({c: F.coalesce(q(c), F.lit(v)) for c, v in values.items()})


def set_where(df: DataFrame, c: str, cond: Column, value=None) -> DataFrame:
    """Set a column to a constant (NULL by default) where a condition holds."""
    lit = F.lit(value).cast(df.schema[c].dataType)
    return df.withColumn(c, F.when(F.coalesce(cond, F.lit(False)), lit).otherwise(q(c)))


def drop_blank(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C11: drop rows where any of the columns is an empty (or all-blank) string or NULL."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.trim(q(c)) != F.lit(""))
    return df.where(cond)


def cap(df: DataFrame, limits: Mapping[str, tuple]) -> DataFrame:
    """Winsorise at fixed (lo, hi) limits per column; NULL kept (not ``least``)."""
    return df.withColumns({c: QF.cap_value(q(c), lo, hi) for c, (lo, hi) in limits.items()})


def tag(df: DataFrame, c: str, value) -> DataFrame:
    """Constant tag column (source year before a union)."""
    return df.withColumn(c, F.lit(value))


def sample_rows(df: DataFrame, key: Sequence[str], frac: float | None = None, n: int | None = None,
                seed: int = 42, exact: bool = True) -> DataFrame:
    """C14: reproducible simple random sample.

    Rows are ordered by a seeded hash of the key, so the sample does not depend
    on partitioning or re-execution.  exact=True takes exactly n (or
    round(frac * rows)) rows by counts per hash slice; exact=False keeps
    rows whose hash falls below the share (no order, approximate count).
    """
    h = F.xxhash64(*[q(k) for k in key], F.lit(seed))
    if not exact:
        if frac is None:
            raise ValueError("frac required when exact=False")
        u = (F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30))
        return df.where(u < F.lit(frac))
    # rows per slice of the hash range: whole slices are in or out, and only the slice that the
    # sample ends in is ranked (1 / SLICES of the rows; no sort of the table)
    tagged = df.withColumn("__h", h).withColumn("__b", F.pmod("__h", F.lit(SLICES)))
    counts = tagged.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    want = F.lit(n).cast("long") if n is not None else F.round(total * F.lit(float(frac))).cast("long")
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("__before", before).withColumn("__left", want - F.col("__before")).where("__left > 0")
    j = tagged.join(F.broadcast(cut.select("__b", "__n", "__left")), "__b")  # at most SLICES rows
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *[q(k) for k in key]))
    last = j.where("__n > __left").withColumn("__p", place).where("__p <= __left").drop("__p")
    return j.where("__n <= __left").unionByName(last).select(*[q(c) for c in df.columns])


def add_index(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], out: str = "t") -> DataFrame:
    """1..n within each series (row_number over a window partitioned by the series key).

    Meant for series tables (one row per period per series), where a partition
    is a series, not raw events.
    """
    w = Window.partitionBy(*[q(b) for b in by]).orderBy(*[q(o) if isinstance(o, str) else o for o in order])
    return df.withColumn(out, F.row_number().over(w).cast("long"))


def split_by_index(df: DataFrame, by: Sequence[str], index: str, n_train: int | None = None,
                   n_test: int | None = None) -> tuple[DataFrame, DataFrame]:
    """First rows / last ``n_test`` rows of each series by its index column."""
    if n_test is not None:
        last = F.max(q(index)).over(Window.partitionBy(*[q(b) for b in by]))
        tagged = df.withColumn("__last", last)
        test = tagged.where(q(index) > F.col("__last") - n_test).drop("__last")
        train = tagged.where(q(index) <= F.col("__last") - n_test).drop("__last")
        return train, test
    return df.where(q(index) <= n_train), df.where(q(index) > n_train)


def sort_by_levels(df: DataFrame, c: str, levels: Sequence, out: str = "level_order") -> DataFrame:
    """C17: rank column from a stated category order (unknown levels last)."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), q(c))
    return df.withColumn(out, F.when(pos == 0, F.lit(len(levels) + 1)).otherwise(pos).cast("long"))
