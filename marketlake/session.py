"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import datetime as dt
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # output files near 128 MiB: REBALANCE splits and merges to this size
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # no call-site capture per column: plans with many columns are built faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "marketlake", **conf: str) -> SparkSession:
    """A session with the defaults above; the master comes from spark-submit or ``conf``."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it; where it names none, one in the warehouse,
    which they share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return folder.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """This application's part of the shared folder. It is removed when the application ends, or by ``release_scratch``."""
    root = f"{shared_folder(spark)}/marketlake-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        system.mkdirs(path)
        system.deleteOnExit(path)
    return root


def release_scratch(spark: SparkSession) -> None:
    """Removes all scratch tables written so far. For drivers that live long, once the results that read them are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def one_day(spark: SparkSession, day: dt.date) -> DataFrame:
    """A one-row table (as_of), kept out of constant folding so that joins on it stay equi-joins."""
    return spark.createDataFrame(pa.table({"as_of": pa.array([day], pa.date32())}))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used for the small side of a join with a large table when that side is itself an
    aggregate: Catalyst can only guess an aggregate's size and would plan two shuffles of the
    large table, while the written table has a known size, so Spark broadcasts it when it is
    below ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges with skew handling when not.
    The written copy also survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
