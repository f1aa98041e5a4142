"""Scans and sinks.

Delimited text in (header + inference, or a declared schema with lenient
parsing), partitioned compressed columnar out, partition-pruned scans back.
Paths may be any Hadoop file system URI; nothing is staged on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.order import q
from quarry.session import checkpoint_dir


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",",
               header: bool = True, quote: str = '"') -> DataFrame:
    """A1/A2: delimited text with a header; types inferred unless a schema is given
    (give one at scale: inference reads the data an extra time)."""
    r = spark.read.option("header", header).option("sep", sep).option("quote", quote)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_staged(spark: SparkSession, path: str, schema: T.StructType | str, key: str | None = None,
                sep: str = ",") -> DataFrame:
    """A3: staging scan -- declared schema, no header skipping, cells that do not
    parse become NULL (PERMISSIVE), blank lines vanish; rows with a NULL key are dropped."""
    df = spark.read.schema(schema).option("header", False).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    return df.where(q(key).isNotNull()) if key else df


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "orc",
                      compression: str = "snappy", mode: str = "overwrite") -> None:
    """A4: dynamic-partition overwrite to compressed columnar files.

    Only the partitions present in ``df`` are replaced; others survive.  Rows
    are clustered by the partition columns first so each task writes few files; AQE splits a large
    value over several tasks (rebalance).
    """
    (df.hint("rebalance", *[q(b) for b in by]).write.mode(mode)
       .option("partitionOverwriteMode", "dynamic").option("compression", compression)
       .partitionBy(*by).format(fmt).save(path))


def read_partitioned(spark: SparkSession, path: str, where: Column | str | None = None, fmt: str = "orc") -> DataFrame:
    """A5: scan of a partitioned table; a predicate on partition columns prunes directories."""
    df = spark.read.format(fmt).load(path)
    return df.where(where) if where is not None else df


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    """Delimited text sink of a cleaned table (one file per task)."""
    df.write.mode(mode).option("header", header).csv(path)


def with_view(df: DataFrame, name: str) -> DataFrame:
    """Register a temp view for SQL text (``spark.sql``) and pass the frame on."""
    df.createOrReplaceTempView(name)
    return df


def take(df: DataFrame, n: int = 6, order: Sequence[Column | str] | None = None) -> DataFrame:
    """First n rows (in a stated order, so the result is defined) -- still a DataFrame;
    collect only at the edge."""
    return (df.orderBy(*order) if order else df).limit(n)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename some columns."""
    return df.withColumnsRenamed(dict(mapping))


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename every column, by position."""
    return df.toDF(*names)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/quarry-tables/{name}-{uuid.uuid4().hex[:12]}"


def derive_parts(df: DataFrame, ts: str, parts: Mapping[str, str] | None = None) -> DataFrame:
    """Partition columns (yr, mnth, day ...) from a timestamp column."""
    fns = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}
    parts = dict(parts or {"yr": "year", "mnth": "month"})
    return df.withColumns({k: fns[v](q(ts)) for k, v in parts.items()})
