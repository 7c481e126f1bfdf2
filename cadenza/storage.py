"""Tables that cut lineage, in the one folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where that is unset and Spark runs in this process."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cadenza-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A small table's checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
