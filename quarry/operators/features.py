"""Feature preparation.

Splits are functions of a seeded hash of the row key, so they do not depend
on partitioning, task order or re-execution (``randomSplit`` and ``rand`` do).
The stratified split takes exactly round(frac * n) rows of every label from
counts per hash slice and ranks one slice of each label only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.order import q

SLICE_SHIFT = 48  # the hash range in 2 ** 16 slices, in its order
_SCALE = float(1 << 30)


def unit_hash(key: Sequence[str], seed: int):
    """Uniform [0, 1) value from a seeded 64-bit hash of the key columns."""
    return F.pmod(F.xxhash64(*[q(k) for k in key], F.lit(seed)), F.lit(1 << 30)).cast("double") / F.lit(_SCALE)


def minmax_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-row table of min and max per column (fitted on training rows only, Q16)."""
    return df.agg(*[F.min(q(c)).cast("double").alias(f"{c}__min") for c in cols],
                  *[F.max(q(c)).cast("double").alias(f"{c}__max") for c in cols])


def minmax_apply(df: DataFrame, fit: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min) with the fitted bounds (scalar subqueries of the one-row fit);
    a constant column scales to 0."""
    scaled = {}
    for c in cols:
        lo, hi = fit.select(f"{c}__min").scalar(), fit.select(f"{c}__max").scalar()
        scaled[c] = F.coalesce(F.try_divide(q(c).cast("double") - lo, hi - lo), F.lit(0.0))
    return df.withColumns(scaled)


def split_random(df: DataFrame, key: Sequence[str], frac: float = 0.7, seed: int = 100) -> tuple[DataFrame, DataFrame]:
    """Reproducible random split by share (approximate sizes, like a Bernoulli draw)."""
    u = unit_hash(key, seed)
    return df.where(u < F.lit(frac)), df.where(u >= F.lit(frac))


def split_stratified(df: DataFrame, label: str, key: Sequence[str], frac: float = 0.7,
                     seed: int = 100) -> tuple[DataFrame, DataFrame]:
    """Stratified split keeping the label ratio: exactly round(frac * n_label) rows of each label
    (the first by a seeded hash of the key) go to training.

    Counts per label and slice of the hash range tell the slice in which a label's training part ends;
    only the rows of that slice are ranked.
    """
    tagged = df.withColumn("__h", F.xxhash64(*[q(k) for k in key], F.lit(seed))).withColumn("__b", F.shiftright("__h", SLICE_SHIFT))
    counts = tagged.groupBy(q(label).alias("__lab"), "__b").agg(F.count(F.lit(1)).alias("__n"))
    by_label = Window.partitionBy("__lab")  # at most one row a slice
    before = F.sum("__n").over(by_label.orderBy("__b")) - F.col("__n")
    counts = counts.withColumn("__want", F.round(F.sum("__n").over(by_label) * F.lit(frac)).cast("long")).withColumn("__before", before)
    ends = (F.col("__before") < F.col("__want")) & (F.col("__want") <= F.col("__before") + F.col("__n"))
    cut = counts.groupBy("__lab").agg(
        F.coalesce(F.max(F.when(ends, F.col("__b"))), F.lit(-(1 << 62))).alias("__end"),
        F.coalesce(F.max(F.when(ends, F.col("__want") - F.col("__before"))), F.lit(0)).alias("__left"))
    j = tagged.join(cut, q(label).eqNullSafe(F.col("__lab")))  # one row per label (AQE broadcasts it from its measured size)
    place = F.row_number().over(Window.partitionBy("__lab").orderBy("__h", *[q(k) for k in key]))
    last = j.where("__b = __end").withColumn("__p", place)
    cols = [q(c) for c in df.columns]
    return (j.where("__b < __end").select(*cols).unionByName(last.where("__p <= __left").select(*cols)),
            j.where("__b > __end").select(*cols).unionByName(last.where("__p > __left").select(*cols)))


def assemble(df: DataFrame, features: Sequence[str], label: str | None = None, out: str = "features",
             keep: Sequence[str] = ()) -> DataFrame:
    """Feature vector column (+ label as double), keeping the named key columns."""
    va = VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")
    v = va.transform(df)
    cols = [q(k) for k in keep] + [F.col(out)]
    if label:
        cols.append(q(label).cast("double").alias("label"))
    return v.select(*cols)
