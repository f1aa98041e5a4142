"""Session helpers: local session for tests and benches, lineage cuts, literal tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, app: str = "quarry", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Session for tests / bench.  On a cluster, use the session the platform gives you."""
    master = master or os.environ.get("QUARRY_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8)))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def scale_conf(input_bytes: int, partition_bytes: int = 512 << 20, min_partitions: int = 200) -> dict:
    """Spark settings sized to the data: scan splits and shuffle partitions of about
    ``partition_bytes`` (so a task's input fits in executor memory and spills rarely), AQE
    coalescing small partitions at run time and splitting skewed ones (a key holding a third
    of the rows is split into advisory-size pieces).

    For 100 TB (10^14 bytes) with the default 512 MiB target: ~186,000 scan splits, as many
    shuffle partitions before AQE coalesces them.
    """
    parts = max(min_partitions, -(-int(input_bytes) // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * partition_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in the Python workers (the pandas functions of the running
    totals and series fits refer to it): zip the package once and ``addPyFile`` it, which
    Spark distributes to every executor.  Done once per SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="quarry-pkg-"), "quarry.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    sc._quarry_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (distributed) folder and is only read; there it must be
    set.  Only a local session without it (tests) gets a private scratch folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as a Parquet table in the shared checkpoint folder and read back.

    Later plans start from finished files: executor loss costs a reread, nothing is cached and
    nothing is computed twice.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Small fixed table written in code; size bounded by construction, safe to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))
