"""Spark session factory: UTC, AQE on, a shuffle width that suits the cores at hand."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "docloom", cores: int | None = None, **conf: str) -> SparkSession:
    """The active session, or a local one. On a cluster the submitted settings win."""
    if active := SparkSession.getActiveSession():
        return active
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "SPARK_MASTER" not in os.environ:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.ui.enabled", "false")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; a temporary one only on a local master without that setting."""
    if named := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return named
    if (own := spark.conf.get("docloom.shared.dir", None)) is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="spark-docloom-")
        spark.conf.set("docloom.shared.dir", own)
    return own


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to a table of its own in the shared folder and read back: what many rules look at is computed once, and their plans start from a scan."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(tables: Iterable[DataFrame], name: str) -> DataFrame:
    """The union of tables, each written by a job of its own: the driver holds the plan, and what is broadcast for it, of one at a time."""
    return reduce(DataFrame.unionByName, [settled(df, name) for df in tables])
