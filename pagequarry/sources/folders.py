"""Where intermediate tables go: below the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is
    unset in local mode. Executors of a cluster could not read it, so there it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pagequarry-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/pagequarry-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str) -> DataFrame:
    """The rows written to a folder and read back, so that what follows does not make them again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
