"""Joins.

Equi-joins are declared and left to Catalyst/AQE (sort-merge, or broadcast
from runtime sizes; AQE splits skewed partitions).  A side is hinted for
broadcast only when its size is bounded by construction: a literal table
written in code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import functions as QF
from quarry.operators.order import q


def join_on(a: DataFrame, b: DataFrame, left: str, right: str, how: str = "inner") -> DataFrame:
    """Equi-join on differently named keys; the right key is dropped."""
    return a.join(b, a[left] == b[right], how).drop(b[right])


def join_all(tables: Sequence[DataFrame], key: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Chain of equi-joins on a common key (row-position pasting made keyed)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, on=key if isinstance(key, str) else list(key), how=how)
    return out


def missing_keys(a: DataFrame, b: DataFrame, key: str, b_key: str | None = None,
                 null_matches: bool = False) -> DataFrame:
    """Distinct keys of ``a`` with no match in ``b`` (anti join).

    SQL semantics by default (a NULL key never matches, so it is reported
    missing); ``null_matches=True`` gives R ``%in%`` semantics (NULL matches NULL).
    """
    b_key = b_key or key
    ka = a.select(q(key).alias("__k")).distinct()
    kb = b.select(q(b_key).alias("__k2"))
    cond = ka["__k"].eqNullSafe(kb["__k2"]) if null_matches else ka["__k"] == kb["__k2"]
    return ka.join(kb, cond, "left_anti").withColumnRenamed("__k", key)


def present_keys(a: DataFrame, b: DataFrame, key: str, b_key: str | None = None) -> DataFrame:
    """Rows of ``a`` whose key appears in ``b`` (semi join)."""
    b_key = b_key or key
    kb = b.select(q(b_key).alias("__k2"))
    return a.join(kb, a[key] == kb["__k2"], "left_semi")


def lookup(df: DataFrame, dim: DataFrame, key: str, attrs: Sequence[str], dim_key: str | None = None,
           how: str = "left") -> DataFrame:
    """Attach attributes of a dimension by key (AQE picks the join from the measured bytes)."""
    dim_key = dim_key or key
    d = dim.select(q(dim_key).alias("__dk"), *[q(a) for a in attrs])
    return df.join(d, df[key] == d["__dk"], how).drop("__dk")


def weight_by(df: DataFrame, rates: DataFrame, key: str, rate: str, measure: str, out: str,
              rate_key: str | None = None) -> DataFrame:
    """E5: rate look-up and weighting: out = measure * rate for the row's key.

    A literal rate table carries its own broadcast hint (``session.literal_table``).
    """
    rate_key = rate_key or key
    r = rates.select(q(rate_key).alias("__rk"), q(rate).alias("__rate"))
    return (df.join(r, df[key] == r["__rk"], "inner")
              .withColumn(out, q(measure) * F.col("__rate")).drop("__rk", "__rate"))


def map_category(df: DataFrame, c: str, mapping: DataFrame, map_key: str, map_value: str, out: str,
                 sep: str = "|") -> DataFrame:
    """First token of a delimited category list -> main category via a mapping table.

    Rows without a mapping are dropped (inner join), as in the reference.
    """
    m = mapping.select(F.lower(q(map_key)).alias("__mk"), q(map_value).alias(out))
    tokens = df.withColumn("__first", F.lower(QF.first_token(q(c), sep)))
    return tokens.join(m, tokens["__first"] == m["__mk"], "inner").drop("__first", "__mk")
