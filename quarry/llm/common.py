"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str):
    """Column by its exact name (names may hold dots or clash with SQL words)."""
    return F.col("`" + name.replace("`", "``") + "`")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder of ``spark.checkpoint.dir``.

    Cuts the lineage: later plans read finished files that every executor sees, so a lost
    executor costs a reread and never a recomputation.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more; later plans must not refer to them."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(t._written_path)
        path.getFileSystem(conf).delete(path, True)


def with_arrow_column(df: DataFrame, body, name: str, kind: T.DataType) -> DataFrame:
    """``df`` with a column added by an Arrow batch function, whatever the columns are called.

    ``body`` sees the columns as c0, c1, ... and yields them followed by the new one.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = plain.mapInArrow(body, T.StructType([*plain.schema.fields, T.StructField("added", kind)]))
    return out.toDF(*df.columns, name)


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type, compressed, behind a letter for the type and their size."""
    kind = next(k for k in ("B", "H", "I", "Q") if not len(x) or x.max() <= np.iinfo(k).max)
    raw = x.astype(kind).tobytes()
    return kind.encode() + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(x: bytes) -> np.ndarray:
    """The integers of ``pack``, as int64."""
    size = int.from_bytes(x[1:9], "little")
    return np.frombuffer(pa.decompress(x[9:], size, "zstd", asbytes=True), x[:1].decode()).astype(np.int64)
